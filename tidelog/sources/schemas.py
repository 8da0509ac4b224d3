"""Schemas of the stored tables and of raw messages."""

from __future__ import annotations

RAW_FIELDS = ("logId", "projectId", "sessionId", "userId", "severity", "eventCategory", "archive", "occurredAt", "ingestedAt", "traceId", "spanId", "fingerprint", "resource", "attributes", "createdAt", "updatedAt")
#: A message of the stream: text fields only, any may be missing, with its place in the order of arrival, and how often it was tried again.
RAW_MESSAGE = ", ".join(f"{f} string" for f in RAW_FIELDS) + ", arrival_seq long, retryCount int"
GAME_LOG = (
    "log_id string, project_id string, session_id string, user_id string, severity string, event_category string, archive string, occurred_at timestamp, ingested_at timestamp, "
    "trace_id string, span_id string, fingerprint string, resource string, attributes string, created_at timestamp, updated_at timestamp, arrival_seq long"
)
#: The longest text of each bounded field.
LENGTHS = {"session_id": 128, "user_id": 128, "severity": 20, "event_category": 32, "trace_id": 32, "span_id": 16, "fingerprint": 64}
ISSUE = (
    "project_id string, fingerprint string, title string, status string, severity string, fingerprint_quality string, occurrence_count long, "
    "first_occurred_at timestamp, last_occurred_at timestamp, first_seq long, last_seq long"
)
DOCUMENT_GROUP = "group_id long, project_id string, category string, group_name string"
DOCUMENT_METADATA = "document_id long, group_id long, document_name string, extension string, major int, minor int, patch int, hash string, size long, stored_key string, is_processed boolean, uploaded_at timestamp, reuploaded_at timestamp"
MEMBER = "member_id string, company_id long, provider string, provider_id string, email string, name string, nickname string, profile_key string, position string, role string, status string, deleted_at timestamp"
