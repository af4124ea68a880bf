"""Operators of a training-data pipeline: filtering, de-duplication, mixing and output of documents."""
