"""Scans and sinks: driver tables, call JSON, media listings, CSV/Parquet."""
