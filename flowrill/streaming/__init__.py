"""Structured Streaming jobs: tailing, scoring, refreshing and live views."""
