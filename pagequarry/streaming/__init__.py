"""Streams: page ingestion and per-key admission."""
