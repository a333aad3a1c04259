"""Readers and writers: season CSV files, star-schema tables, result files."""
