"""Readers and writers. Everything is Parquet or JSON with a fixed schema."""
