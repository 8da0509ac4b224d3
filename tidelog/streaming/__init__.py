"""Structured Streaming: the ingestion pipeline, dead letters, token buckets and expiring state."""
