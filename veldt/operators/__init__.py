"""Operators of the event log: ingest, dedup, tags, index, error statistics."""
