"""Readers: parquet tables, JSONL and CSV collections, landed files."""
