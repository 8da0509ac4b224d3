"""Operators over DataFrames: ingestion, issues, archive, members, paging, months, control."""
