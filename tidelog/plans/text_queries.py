"""Queries of the text functions, the fingerprint and parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fingerprint as fp
from ..functions import parsing, text
from ..operators import archive
from ..sources.tables import event_logs, table
from .registry import LOGS, query

_TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
#: The normaliser's patterns and what stands for a match, in the order of application. They are written out a second time, in the form of another regex engine, so that the SQL checks the
#: library's own patterns and does not share them.
_STEPS = [
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "UUID"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "IP"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?", "TIMESTAMP"),
    (r"""(?:[A-Za-z]:\\|/)(?:[^\\/:*?"<>|\r\n]+[\\/])*([^\\/:*?"<>|\r\n]+)""", r"PATH/\1"),
    (r"\bplayer_\d+\b", "player_N"),
    (r"\bitem_([a-zA-Z]+)_\d+\b", r"item_\1_N"),
    (r"@[0-9a-fA-F]+", "@ADDR"),
    (r"\b\d+\b", "N"),
]


def trim_sql(c: str) -> str:
    return _TRIM.format(c)


def step_sql(c: str, n: int) -> str:
    pattern, to = _STEPS[n]
    return f"regexp_replace({c}, '{pattern}', '{to}', 'g')"


def normalize_sql(c: str) -> str:
    for n in range(len(_STEPS)):
        c = step_sql(c, n)
    return c


FIRST_LINE = trim_sql(r"regexp_split_to_array(archive, '\r?\n')[1]")
#: line: the trimmed first line; kind, said: exception type and message.
PARTS = f"""{LOGS}, lined AS (SELECT *, {FIRST_LINE} AS line FROM logs),
parts AS (SELECT *,
  CASE WHEN contains(line, ':') AND contains({trim_sql("split_part(line, ':', 1)")}, '.') THEN {trim_sql("split_part(line, ':', 1)")} END AS kind,
  CASE WHEN length(archive) > 0 THEN CASE WHEN contains(line, ':') THEN {trim_sql("substr(line, instr(line, ':') + 1)")} ELSE line END END AS said FROM lined)"""
_FRAME = r"at\s+([a-zA-Z0-9_.]+)\.([a-zA-Z0-9_<>$]+)\(([^:)]+):?(\d+)?\)"
_LIBRARY = " OR ".join(f"starts_with(regexp_extract(l, '{_FRAME}', 1), '{p}')" for p in ("java.", "javax.", "jdk.", "sun.", "org.springframework.", "org.hibernate.", "org.apache.", "com.fasterxml.", "io.netty.", "reactor.", "kotlin."))
_APP = " OR ".join(f"starts_with(regexp_extract(l, '{_FRAME}', 1), '{p}')" for p in ("com.game", "com.studio", "com.gameco"))
_SPLIT = r"regexp_split_to_array(archive, '\r?\n')"
_METHOD = rf"regexp_replace(regexp_extract(l, '{_FRAME}', 2), '\$lambda\$\d+', '$lambda', 'g')"
_BUCKET = f"coalesce(':' || CAST((TRY_CAST(nullif(regexp_extract(l, '{_FRAME}', 4), '') AS INTEGER) // 10) * 10 AS VARCHAR), '')"
FRAMES = f"""{PARTS}, framed AS (SELECT *, list_transform(list_filter(list_transform({_SPLIT}, lambda x: {trim_sql('x')}),
  lambda l: starts_with(l, 'at ') AND regexp_matches(l, '{_FRAME}') AND NOT ({_LIBRARY}) AND ({_APP})),
  lambda l: concat(regexp_extract(l, '{_FRAME}', 1), '.', {_METHOD}, '(', regexp_extract(l, '{_FRAME}', 3), {_BUCKET}, ')')) AS frames FROM parts)"""


def fingerprints_sql(category: str = "event_category") -> str:
    """CTEs that end in ``printed``: the parts with fingerprint and quality."""
    return f"""{FRAMES}, printed AS (SELECT *,
  CASE WHEN len(frames) >= 3 THEN 'HIGH' WHEN len(frames) >= 1 THEN 'MEDIUM' WHEN kind IS NOT NULL AND said IS NOT NULL THEN 'LOW' WHEN length(said) > 0 THEN 'VERY_LOW' ELSE 'FALLBACK' END AS quality,
  sha256(CASE WHEN len(frames) >= 1 THEN coalesce(kind || chr(10), '') || array_to_string(frames, chr(10)) || chr(10)
    WHEN kind IS NOT NULL AND said IS NOT NULL THEN kind || chr(10) || {normalize_sql('said')}
    WHEN length(said) > 0 THEN {normalize_sql('said')} ELSE severity || '_' || {category} END) AS fingerprint FROM framed)"""


def _register_steps() -> None:
    for n, (name, step) in enumerate(zip(("f03_uuid", "f04_ip", "f05_timestamp", "f06_path", "f07_player", "f08_item", "f09_address", "f10_number"), text.STEPS, strict=True)):

        def run(spark, folder, step=step):
            logs = event_logs(spark, folder).select(F.col("arrival_seq").alias("id"), F.concat_ws(" ", "archive", F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("550e8400-e29b-41d4-a716-446655440000")).alias("t"))
            return logs.select("id", step(F.col("t")).alias("masked"))

        line = "archive || ' ' || strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') || ' 550e8400-e29b-41d4-a716-446655440000'"
        query(name, f"WITH {LOGS} SELECT arrival_seq AS id, {step_sql(line, n)} AS masked FROM logs")(run)


_register_steps()


@query("f11_normalize", f"SELECT doc_id, sha256({normalize_sql('text')}) AS masked_sha256 FROM documents")
def f11_normalize(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.sha2(text.normalize_message(F.col("text")), 256).alias("masked_sha256"))


@query("f11_normalize_chat", f"SELECT conv_id, turn, {normalize_sql('text')} AS masked FROM conversations")
def f11_normalize_chat(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", text.normalize_message(F.col("text")).alias("masked"))


@query("f01_sha256", f"WITH {LOGS} SELECT arrival_seq, sha256(archive) AS digest FROM logs")
def f01_sha256(spark, folder):
    return event_logs(spark, folder).select("arrival_seq", F.sha2("archive", 256).alias("digest"))


@query("f12_stack_lines", f"WITH {LOGS}, s AS (SELECT arrival_seq, list_filter(list_transform({_SPLIT}, lambda x: {trim_sql('x')}), lambda l: starts_with(l, 'at ')) AS ls FROM logs) SELECT arrival_seq, CASE WHEN len(ls) > 0 THEN array_to_string(ls, '|') END AS stack FROM s")
def f12_stack_lines(spark, folder):
    return event_logs(spark, folder).select("arrival_seq", F.array_join(fp.stack_lines(F.col("archive")), "|").alias("stack"))


@query("f13_exception_type", f"WITH {PARTS} SELECT arrival_seq, kind FROM parts")
def f13_exception_type(spark, folder):
    return event_logs(spark, folder).select("arrival_seq", text.exception_type(F.col("archive")).alias("kind"))


@query("f14_message", f"WITH {PARTS} SELECT arrival_seq, said FROM parts")
def f14_message(spark, folder):
    return event_logs(spark, folder).select("arrival_seq", text.message(F.col("archive")).alias("said"))


@query("f15_frames", f"WITH {FRAMES} SELECT arrival_seq, CAST(len(frames) AS INTEGER) AS n_frames, array_to_string(frames, '|') AS frames FROM framed")
def f15_frames(spark, folder):
    """Frames parsed, library ones dropped, own ones kept, lambdas cleaned, lines bucketed and formatted (f15 to f20)."""
    frames = fp.app_frames(F.col("archive"))
    return event_logs(spark, folder).select("arrival_seq", F.size(frames).alias("n_frames"), F.array_join(frames, "|").alias("frames"))


@query("f21_fingerprint", f"WITH {fingerprints_sql()} SELECT arrival_seq, fingerprint, quality FROM printed")
def f21_fingerprint(spark, folder):
    return event_logs(spark, folder).select("arrival_seq", fp.issue_fingerprint(F.col("archive"), F.col("severity"), F.col("event_category")).alias("p")).select("arrival_seq", "p.fingerprint", "p.quality")


@query("f21_log_fingerprint", f"WITH {fingerprints_sql(chr(39) + 'null' + chr(39))} SELECT arrival_seq, fingerprint, quality FROM printed")
def f21_log_fingerprint(spark, folder):
    return event_logs(spark, folder).select("arrival_seq", fp.log_fingerprint(F.col("archive"), F.col("severity")).alias("p")).select("arrival_seq", "p.fingerprint", "p.quality")


@query("f22_review", f"WITH {fingerprints_sql()} SELECT quality, CASE WHEN quality IN ('LOW', 'VERY_LOW', 'FALLBACK') THEN 'REQUIRES_REVIEW' ELSE 'OPEN' END AS status, count(*) AS logs FROM printed GROUP BY quality")
def f22_review(spark, folder):
    printed = f21_fingerprint(spark, folder)
    return printed.groupBy("quality").agg(F.count("*").alias("logs")).select("quality", fp.initial_status(F.col("quality")).alias("status"), "logs")


_TITLE_LINE = trim_sql(r"regexp_split_to_array(text, '\r?\n')[1]")


@query("f23_title", f"SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 'Unknown Error' WHEN length({_TITLE_LINE}) > 500 THEN substr({_TITLE_LINE}, 1, 497) || '...' ELSE {_TITLE_LINE} END AS title FROM documents")
def f23_title(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.issue_title(F.col("text")).alias("title"))


@query(
    "f24_severity",
    f"WITH s AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN event_type WHEN 2 THEN chr(9) || 'warn ' WHEN 3 THEN NULL ELSE 'Fatal' END AS raw FROM events) "
    f"SELECT event_id, CASE WHEN raw IS NULL OR regexp_matches(raw, '^\\s*$') THEN 'INFO' WHEN upper({trim_sql('raw')}) IN ('TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL') THEN upper({trim_sql('raw')}) END AS severity FROM s",
)
def f24_severity(spark, folder):
    case = F.col("event_id") % 5
    raw = F.when(case == 0, " ").when(case == 1, F.col("event_type")).when(case == 2, "\twarn ").when(case == 3, None).otherwise("Fatal")
    return table(spark, folder, "events").select("event_id", parsing.parse_severity(raw).alias("severity"))


#: Fixed values, written out a second time.
_CODES = "'SYSTEM', 'ERROR', 'PERFORMANCE', 'NETWORK', 'GAMEPLAY', 'COMBAT', 'SKILL', 'ITEM', 'QUEST', 'STAGE', 'MATCH', 'SOCIAL', 'ECONOMY', 'PAYMENT', 'AUTH', 'ADMIN', 'CHEAT'"
_LABELS = "WHEN '시스템' THEN 'SYSTEM' WHEN '에러' THEN 'ERROR' WHEN '성능' THEN 'PERFORMANCE' WHEN '네트워크' THEN 'NETWORK' WHEN '게임플레이' THEN 'GAMEPLAY' WHEN '전투' THEN 'COMBAT' WHEN '스킬' THEN 'SKILL' WHEN '아이템' THEN 'ITEM' WHEN '퀘스트' THEN 'QUEST' WHEN '스테이지' THEN 'STAGE' WHEN '매치' THEN 'MATCH' WHEN '소셜' THEN 'SOCIAL' WHEN '재화' THEN 'ECONOMY' WHEN '결제' THEN 'PAYMENT' WHEN '인증' THEN 'AUTH' WHEN '관리' THEN 'ADMIN' WHEN '치트' THEN 'CHEAT'"


@query(
    "f25_category",
    f"WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN event_type WHEN 2 THEN ' 전투' ELSE 'quest' END AS raw FROM events) "
    f"SELECT event_id, CASE WHEN raw IS NULL OR regexp_matches(raw, '^\\s*$') THEN 'SYSTEM' WHEN upper({trim_sql('raw')}) IN ({_CODES}) THEN upper({trim_sql('raw')}) ELSE CASE {trim_sql('raw')} {_LABELS} END END AS category FROM s",
)
def f25_category(spark, folder):
    case = F.col("event_id") % 4
    raw = F.when(case == 0, "").when(case == 1, F.col("event_type")).when(case == 2, " 전투").otherwise("quest")
    return table(spark, folder, "events").select("event_id", parsing.parse_category(raw).alias("category"))


@query("f26_status", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'RESOLVED' WHEN event_id % 3 = 1 THEN 'OPEN' ELSE 'OPEN' END AS status FROM events")
def f26_status(spark, folder):
    raw = F.when(F.col("event_id") % 3 == 0, "resolved").when(F.col("event_id") % 3 == 1, F.col("event_type"))
    return table(spark, folder, "events").select("event_id", parsing.parse_status(raw).alias("status"))


@query(
    "f27_time",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 9 HOUR ELSE TIMESTAMP '2024-02-01 00:00:00' END AS at FROM events",
)
def f27_time(spark, folder):
    """With an offset, as UTC; without one, null and unreadable: the default."""
    local, case = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_id") % 4
    raw = F.when(case == 0, F.concat(local, F.lit("Z"))).when(case == 1, F.concat(local, F.lit("+09:00"))).when(case == 2, local)
    at = parsing.parse_time(raw, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return table(spark, folder, "events").select("event_id", F.to_timestamp_ntz(F.date_format(at, "yyyy-MM-dd HH:mm:ss")).alias("at"))


@query("f28_uuid", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '550e8400-e29b-41d4-a716-' || lpad(CAST(event_id AS VARCHAR), 12, '0') END AS id FROM events")
def f28_uuid(spark, folder):
    padded = F.lpad(F.col("event_id").cast("string"), 12, "0")
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("550E8400-E29B-41D4-A716-"), padded)).otherwise(F.concat(F.lit("1-1-1-1-"), padded))
    return table(spark, folder, "events").select("event_id", parsing.parse_uuid(raw).alias("id"))


@query("f29_json", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{}' WHEN 1 THEN props END AS attributes FROM events")
def f29_json(spark, folder):
    case = F.col("event_id") % 4
    raw = F.when(case == 0, None).when(case == 1, F.col("props")).when(case == 2, "[1]").otherwise("{broken")
    return table(spark, folder, "events").select("event_id", parsing.parse_json_object(raw).alias("attributes"))


@query("f30_to_json", """SELECT event_id, concat('{"event_type":"', event_type, '","user_id":', user_id, '}') AS body FROM events""")
def f30_to_json(spark, folder):
    return table(spark, folder, "events").select("event_id", parsing.to_json_text(F.struct("event_type", "user_id")).alias("body"))


_CHOSEONG = "array_to_string(list_transform(string_split({}, ''), lambda c: CASE WHEN c BETWEEN '가' AND '힣' THEN substr('ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ', CAST((ord(c) - 44032) // 588 + 1 AS INTEGER), 1) ELSE c END), '')"
_NAMES = "n AS (SELECT doc_id, chr(CAST(44032 + doc_id * 7919 % 11172 AS INTEGER)) || chr(CAST(44032 + coalesce(length(text), 0) * 31 % 11172 AS INTEGER)) || ' ' || source AS name FROM documents)"


@query("x02_choseong", f"WITH {_NAMES}, k AS (SELECT doc_id, name, {_CHOSEONG.format('name')} AS key FROM n), w AS (SELECT DISTINCT left(key, 2) AS key FROM k UNION SELECT DISTINCT left(key, 1) FROM k) SELECT w.key, count(*) AS documents, min(doc_id) AS first, min(name) AS name FROM w JOIN k ON starts_with(k.key, w.key) GROUP BY w.key")
def x02_choseong(spark, folder):
    """Documents with names in Hangul, searched by one and two initial consonants."""
    syllable = lambda n: F.decode(F.unhex(F.lpad(F.hex(44032 + n % 11172), 4, "0")), "UTF-16BE")
    name = F.concat(syllable(F.col("doc_id") * 7919), syllable(F.coalesce(F.length("text"), F.lit(0)).cast("long") * 31), F.lit(" "), F.col("source"))
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), name.alias("document_name"))
    keys = documents.select("document_id", text.choseong(F.col("document_name")).alias("key"))
    wanted = keys.select(F.substring("key", 1, 2).alias("key")).unionAll(keys.select(F.substring("key", 1, 1).alias("key"))).distinct()
    found = archive.by_initials(documents, wanted)
    return found.groupBy("key").agg(F.count("*").alias("documents"), F.min("document_id").alias("first"), F.min("document_name").alias("name"))
