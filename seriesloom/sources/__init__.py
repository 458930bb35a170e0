"""Readers and writers: Parquet, CSV with unknown separator, JSON summaries."""
