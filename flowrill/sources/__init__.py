"""Readers, writers and table adapters for flow data."""
