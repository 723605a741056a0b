"""Readers and writers: CSV input (A1), Parquet runs (A7, A8, A11), job logs (B5)."""
