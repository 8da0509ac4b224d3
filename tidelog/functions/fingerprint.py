"""Stack frames and the five-tier fingerprint, as Column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_line, jtrim, let, message_of_line, normalize_value, type_of_line

#: A frame (package and class, method, file, line), a numbered lambda, and the prefixes of library frames.
FRAME = r"at\s+([a-zA-Z0-9_.]+)\.([a-zA-Z0-9_<>$]+)\(([^:)]+):?(\d+)?\)"
LAMBDA = r"\$lambda\$\d+"
LIBRARY_PREFIXES = ("java.", "javax.", "jdk.", "sun.", "org.springframework.", "org.hibernate.", "org.apache.", "com.fasterxml.", "io.netty.", "reactor.", "kotlin.")
#: The packages whose frames count as the application's own; a game adds its own.
APP_PREFIXES = ("com.game", "com.studio", "com.gameco")
#: Tiers and the names of their strategies.
STRATEGIES = {"HIGH": "Full Stacktrace", "MEDIUM": "Partial Stacktrace", "LOW": "Exception Type + Message", "VERY_LOW": "Message Only", "FALLBACK": "Fallback (Severity + Category)"}
REVIEWED_TIERS = ("LOW", "VERY_LOW", "FALLBACK")
FULL_STACK_FRAMES = 3


def stack_lines(archive: Column) -> Column:
    """The trimmed lines that begin with 'at '; null where the text has none."""
    return let(_at_lines(archive), lambda lines: F.when(F.size(lines) > 0, lines))


def _at_lines(archive: Column) -> Column:
    """An empty array for a text that has none; most texts are passed over without being split."""
    lines = F.filter(F.transform(F.split(archive, "\n"), jtrim), lambda line: line.startswith("at "))
    return F.when(F.contains(archive, F.lit("at ")), lines).otherwise(F.array().cast("array<string>"))


def is_library(package: Column) -> Column:
    return _starts_with_any(package, LIBRARY_PREFIXES)


def is_app(package: Column, prefixes: Sequence[str] = APP_PREFIXES) -> Column:
    return _starts_with_any(package, prefixes)


def _starts_with_any(c: Column, prefixes: Sequence[str]) -> Column:
    found = F.lit(False)
    for prefix in prefixes:
        found = found | c.startswith(prefix)
    return found


def frame_part(line: Column, group: int) -> Column:
    """Group 1: package and class, 2: method, 3: file, 4: line number; empty where the line is no frame or has no number."""
    return F.regexp_extract(line, FRAME, group)


def line_bucket(number: Column) -> Column:
    """':' and the line number rounded down to tens; empty for no number or one beyond int."""
    n = number.try_cast("int")
    return F.coalesce(F.concat(F.lit(":"), (F.floor(n / 10) * 10).cast("string")), F.lit(""))


def clean_lambda(method: Column) -> Column:
    return F.regexp_replace(method, LAMBDA, r"\$lambda")


def format_frame(line: Column) -> Column:
    return F.concat(frame_part(line, 1), F.lit("."), clean_lambda(frame_part(line, 2)), F.lit("("), frame_part(line, 3), line_bucket(frame_part(line, 4)), F.lit(")"))


def app_frames(archive: Column, prefixes: Sequence[str] = APP_PREFIXES) -> Column:
    """The application's frames, normalised, in order; an empty array for a text without any."""
    own = lambda line: let(frame_part(line, 1), lambda package: (package != "") & ~is_library(package) & is_app(package, prefixes))
    return F.transform(F.filter(_at_lines(archive), own), format_frame)


def fingerprint(archive: Column, severity: Column, category: Column, prefixes: Sequence[str] = APP_PREFIXES) -> Column:
    """struct(fingerprint, quality, strategy). Tiers by what the text has: three frames, one, type and message, message, nothing."""
    return let(hash_and_quality(archive, severity, category, prefixes), lambda f: F.struct(f["fingerprint"].alias("fingerprint"), f["quality"].alias("quality"), strategy(f["quality"]).alias("strategy")))


def hash_and_quality(archive: Column, severity: Column, category: Column, prefixes: Sequence[str] = APP_PREFIXES) -> Column:
    """struct(fingerprint, quality): all that logs and issues keep, without the name of the strategy, which would be looked up for every row."""
    fallback = F.concat_ws("_", F.coalesce(severity, F.lit("null")), F.coalesce(category, F.lit("null")))

    def of_parts(p: Column) -> Column:
        frames, kind, said = p["frames"], p["kind"], p["said"]
        n, typed, spoken = F.size(frames), kind.isNotNull() & said.isNotNull(), F.length(said) > 0
        stack = F.concat(F.coalesce(F.concat(kind, F.lit("\n")), F.lit("")), F.array_join(frames, "\n"), F.lit("\n"))
        plain = F.concat(F.when(typed, F.concat(kind, F.lit("\n"))).otherwise(""), normalize_value(said))
        text = F.when(n >= 1, stack).when(typed | spoken, plain).otherwise(fallback)
        tier = F.when(n >= FULL_STACK_FRAMES, "HIGH").when(n >= 1, "MEDIUM").when(typed, "LOW").when(spoken, "VERY_LOW").otherwise("FALLBACK")
        return F.struct(F.sha2(text, 256).alias("fingerprint"), tier.alias("quality"))

    def of_line(line: Column) -> Column:
        said = F.when(F.length(archive) > 0, message_of_line(line))
        return F.struct(app_frames(archive, prefixes).alias("frames"), type_of_line(line).alias("kind"), said.alias("said"))

    return let(let(jtrim(first_line(archive)), of_line), of_parts)


def strategy(tier: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in STRATEGIES.items() for x in pair))[tier]


def log_fingerprint(archive: Column, severity: Column, prefixes: Sequence[str] = APP_PREFIXES) -> Column:
    """As the stream path stores it with a log: the category is not known yet, so the last tier hashes 'null' in its place."""
    return fingerprint(archive, severity, F.lit(None).cast("string"), prefixes)


def issue_fingerprint(archive: Column, severity: Column, category: Column, prefixes: Sequence[str] = APP_PREFIXES) -> Column:
    """As issues are grouped: with severity and category."""
    return fingerprint(archive, severity, category, prefixes)


def requires_review(quality: Column) -> Column:
    return quality.isin(*REVIEWED_TIERS)


def initial_status(quality: Column) -> Column:
    return F.when(requires_review(quality), "REQUIRES_REVIEW").otherwise("OPEN")
