"""Versions, file names, content types, months and other small formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import jtrim

#: Content types by extension, and what may be uploaded.
CONTENT_TYPES = {"pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png"}
UPLOAD_TYPES, UPLOAD_EXTENSIONS = ("application/pdf", "image/jpeg", "image/png"), ("pdf", "jpg", "jpeg", "png")


def pack_version(major: Column, minor: Column, patch: Column) -> Column:
    return major * 1_000_000 + minor * 1_000 + patch


def unpack_version(ordinal: Column) -> Column:
    """'v1.2.3' of a packed version; null: 'v0.0.0'."""
    n = F.coalesce(ordinal, F.lit(0)).cast("long")
    return version_text(F.floor(n / 1_000_000), F.floor(n / 1_000) % 1_000, n % 1_000)


def version_text(major: Column, minor: Column, patch: Column) -> Column:
    return F.concat(F.lit("v"), major.cast("string"), F.lit("."), minor.cast("string"), F.lit("."), patch.cast("string"))


def parse_version(c: Column) -> Column:
    """array(major, minor, patch) of 'v1.2.3' or '1.2.3'; null parts where it is none."""
    parts = F.split(F.regexp_replace(c, "^v", ""), r"\.")
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.get(parts, i).try_cast("int"))


def file_stem(c: Column) -> Column:
    """Without the extension, which follows the last dot of the base name."""
    return F.regexp_replace(c, r"\.[^./]*$", "")


def file_extension(c: Column) -> Column:
    """What follows the last dot of the base name; null if there is none."""
    return F.when(c.rlike(r"\.[^./]*$"), F.regexp_extract(c, r"\.([^./]*)$", 1))


def content_type(extension: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in CONTENT_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(extension)), F.lit("application/octet-stream"))


def may_upload(mime: Column, extension: Column) -> Column:
    return F.coalesce(F.lower(mime).isin(*UPLOAD_TYPES) & F.lower(extension).isin(*UPLOAD_EXTENSIONS), F.lit(False))


def download_name(name: Column, extension: Column) -> Column:
    return F.concat(name, F.lit("."), extension)


def stored_key(extension: Column, token: Column | None = None) -> Column:
    """A new key, or the key of a given token, with the extension."""
    return F.concat(F.uuid() if token is None else token, F.lit("."), extension)


def month_of(ts: Column) -> Column:
    return F.trunc(ts, "month")


def month_table(month: Column) -> Column:
    """The name of a month's partition."""
    return F.concat(F.lit("game_log_"), F.date_format(month, "yyyy_MM"))


def first_of_list(c: Column) -> Column:
    """The first entry of a comma-separated list, trimmed: the client of a forwarding chain."""
    return jtrim(F.split(c, ",", 2)[0])


def last_segment(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def date_display(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit("-"))


def percent(share: Column) -> Column:
    return F.format_string("%.2f%%", share)


def retry_after_seconds(nanos: Column) -> Column:
    """Whole seconds, rounded up."""
    return F.ceil(nanos / 1_000_000_000).cast("long")


def health_of(state: Column) -> Column:
    """Of a circuit breaker."""
    return F.when(state == "CLOSED", "UP").when(state == "HALF_OPEN", "RECOVERING").when(state == "OPEN", "DOWN").otherwise("UNKNOWN")


def kv_key(kind: str, c: Column) -> Column:
    """Key of a stored token: refresh, blacklist or oauth2_state."""
    return F.concat(F.lit(f"{kind}:"), c)


def token_ttl_seconds(millis: Column) -> Column:
    """Null where nothing is stored: no time is left. Else one second at least."""
    return F.when(millis > 0, F.greatest(F.lit(1), F.floor(millis / 1000)).cast("long"))
