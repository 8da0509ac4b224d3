"""Parsing of raw text fields. Unknown values become null where the record is to be rejected; the caller decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, jtrim

#: Severities, categories with their Korean labels, and issue states.
SEVERITIES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
CATEGORIES = {
    "SYSTEM": "시스템",
    "ERROR": "에러",
    "PERFORMANCE": "성능",
    "NETWORK": "네트워크",
    "GAMEPLAY": "게임플레이",
    "COMBAT": "전투",
    "SKILL": "스킬",
    "ITEM": "아이템",
    "QUEST": "퀘스트",
    "STAGE": "스테이지",
    "MATCH": "매치",
    "SOCIAL": "소셜",
    "ECONOMY": "재화",
    "PAYMENT": "결제",
    "AUTH": "인증",
    "ADMIN": "관리",
    "CHEAT": "치트",
}
ISSUE_STATES = ("OPEN", "REQUIRES_REVIEW", "IN_PROGRESS", "RESOLVED", "IGNORED")
UUID_TEXT = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ISO_WITH_OFFSET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})$"


def parse_severity(c: Column) -> Column:
    """Null and blank: INFO. Case and white space at the ends do not matter. Unknown: null."""
    code = F.upper(jtrim(c))
    return F.when(is_blank(c), "INFO").when(code.isin(*SEVERITIES), code)


def parse_category(c: Column) -> Column:
    """Null and blank: SYSTEM. A code in any case, or a label as it is written. Unknown: null."""
    text = jtrim(c)
    labels = F.create_map(*(F.lit(x) for code, label in CATEGORIES.items() for x in (label, code)))
    code = F.upper(text)
    return F.when(is_blank(c), "SYSTEM").when(code.isin(*CATEGORIES), code).otherwise(F.try_element_at(labels, text))


def parse_status(c: Column) -> Column:
    """Null and unknown: OPEN. White space counts."""
    return F.when(F.upper(c).isin(*ISSUE_STATES), F.upper(c)).otherwise("OPEN")


def parse_time(c: Column, default: Column) -> Column:
    """ISO date and time with an offset; anything else: the default."""
    return F.coalesce(F.when(c.rlike(ISO_WITH_OFFSET), F.try_to_timestamp(c)), default)


def parse_uuid(c: Column) -> Column:
    """Lower case, of 8-4-4-4-12 digits; else null."""
    return F.when(c.rlike(UUID_TEXT), F.lower(c))


def uuid_or_new(c: Column) -> Column:
    """Null and empty: a new one. Malformed: null."""
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.uuid()).otherwise(parse_uuid(c))


def parse_json_object(c: Column) -> Column:
    """Null: an empty object. The text of a JSON object stays; anything else: null."""
    return F.when(c.isNull(), "{}").when(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), c)


def to_json_text(c: Column) -> Column:
    """JSON text of a map or struct; null: an empty object."""
    return F.coalesce(F.to_json(c), F.lit("{}"))
