"""Structured Streaming ingest of new CSV files (B2)."""
