"""Schemas, tables, landing folders and blobs."""
