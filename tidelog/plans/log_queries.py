"""Queries of ingestion, issues, predicates on logs, months and control."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import names
from ..operators import containment, control, ingest, issues, months, paging
from ..sources.tables import event_logs, table
from .registry import LOGS, query
from .text_queries import fingerprints_sql, trim_sql

_TITLE = f"CASE WHEN length(archive) = 0 THEN 'Unknown Error' WHEN length(line) > 500 THEN substr(line, 1, 497) || '...' ELSE line END"
_STATUS = "CASE WHEN quality IN ('LOW', 'VERY_LOW', 'FALLBACK') THEN 'REQUIRES_REVIEW' ELSE 'OPEN' END"
ISSUES = f"""{fingerprints_sql()}, issues AS (SELECT project_id, fingerprint, arg_min({_TITLE}, arrival_seq) AS title, arg_min({_STATUS}, arrival_seq) AS status,
  arg_min(severity, arrival_seq) AS severity, arg_min(quality, arrival_seq) AS fingerprint_quality, count(*) AS occurrence_count, arg_min(occurred_at, arrival_seq) AS first_occurred_at,
  arg_max(occurred_at, arrival_seq) AS last_occurred_at, min(arrival_seq) AS first_seq, max(arrival_seq) AS last_seq FROM printed GROUP BY project_id, fingerprint)"""


def _raw(spark, folder, deal=lambda events: events):
    """Events as raw messages, some of them bad. deal: what is done to the events first, which are far narrower than messages."""
    seq, case = F.col("event_id"), F.col("event_id") % 11
    uid = lambda c: F.concat(F.lit("550e8400-e29b-41d4-a716-"), F.lpad(c.cast("string"), 12, "0"))
    return deal(table(spark, folder, "events")).select(
        uid(seq).alias("logId"),
        F.when(case == 1, "nonsense").when(case == 2, None).otherwise(uid(F.col("user_id") % 5)).alias("projectId"),
        F.when(case == 3, "").otherwise(F.concat(F.lit("s-"), F.col("user_id"))).alias("sessionId"),
        F.col("user_id").cast("string").alias("userId"),
        F.when(case == 4, "loud").when(case == 5, " ").otherwise("error").alias("severity"),
        F.when(case == 6, "none").when(case == 7, "에러").otherwise("system").alias("eventCategory"),
        F.when(case == 8, "\n\r\n").otherwise(F.expr("concat('Timeout after ', event_id, ' ms')")).alias("archive"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("occurredAt"),
        F.lit(None).cast("string").alias("ingestedAt"),
        F.when(case == 9, F.repeat(F.lit("t"), 33)).alias("traceId"),
        F.lit(None).cast("string").alias("spanId"),
        F.when(case == 0, "given").alias("fingerprint"),
        F.lit(None).cast("string").alias("resource"),
        F.when(case == 10, "[]").otherwise(F.col("props")).alias("attributes"),
        F.lit(None).cast("string").alias("createdAt"),
        F.lit(None).cast("string").alias("updatedAt"),
        seq.alias("arrival_seq"),
    )


def _now():
    return F.lit("2024-02-10 00:00:00").cast("timestamp")


_REASON = "CASE event_id % 11 WHEN 2 THEN 'missing_field' WHEN 1 THEN 'bad_uuid' WHEN 4 THEN 'bad_severity' WHEN 6 THEN 'bad_category' WHEN 10 THEN 'bad_json' WHEN 8 THEN 'empty_lines' WHEN 9 THEN 'too_long' END"


_UID = "'550e8400-e29b-41d4-a716-' || lpad(CAST({} AS VARCHAR), 12, '0')"
_NOW = "TIMESTAMP '2024-02-10 00:00:00'"


def _plain_times(rows):
    """Timestamps without a zone, as DuckDB has them."""
    return rows.select(*(F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c) for c, kind in rows.dtypes))


@query(
    "s05_decode",
    f"""SELECT {_UID.format("event_id")} AS log_id, {_UID.format("user_id % 5")} AS project_id, CASE WHEN event_id % 11 = 3 THEN 'unknown-session' ELSE 's-' || user_id END AS session_id, CAST(user_id AS VARCHAR) AS user_id,
  CASE WHEN event_id % 11 = 5 THEN 'INFO' ELSE 'ERROR' END AS severity, CASE WHEN event_id % 11 = 7 THEN 'ERROR' ELSE 'SYSTEM' END AS event_category, 'Timeout after ' || event_id || ' ms' AS archive, date_trunc('second', ts) AS occurred_at,
  {_NOW} AS ingested_at, CAST(NULL AS VARCHAR) AS trace_id, CAST(NULL AS VARCHAR) AS span_id, CASE WHEN event_id % 11 = 0 THEN 'given' ELSE sha256('Timeout after N ms') END AS fingerprint, '{{}}' AS resource, props AS attributes,
  {_NOW} AS created_at, {_NOW} AS updated_at, event_id AS arrival_seq
  FROM events WHERE ({_REASON}) IS NULL""",
)
def s05_decode(spark, folder):
    good, _ = ingest.split_rejected(ingest.decoded(_raw(spark, folder), _now()), _now())
    return _plain_times(good)


@query("t21_rejected", f"SELECT reason, count(*) AS logs FROM (SELECT {_REASON} AS reason FROM events) WHERE reason IS NOT NULL GROUP BY reason")
def t21_rejected(spark, folder):
    """Poison records by reason (also p09 and p10)."""
    _, bad = ingest.split_rejected(ingest.decoded(_raw(spark, folder), _now()), _now())
    return bad.groupBy("reason").agg(F.count("*").alias("logs"))


@query(
    "s06_decode_request",
    f"""WITH r AS (SELECT *, event_id % 11 AS c FROM events)
  SELECT CASE WHEN c NOT IN (1, 2) THEN {_UID.format("user_id % 5")} END AS project_id, CASE WHEN c = 3 THEN '' ELSE 's-' || user_id END AS session_id, CAST(user_id AS VARCHAR) AS user_id, CASE c WHEN 4 THEN NULL WHEN 5 THEN 'INFO' ELSE 'ERROR' END AS severity,
  CASE c WHEN 6 THEN NULL WHEN 7 THEN 'ERROR' ELSE 'SYSTEM' END AS event_category, CASE WHEN c = 8 THEN chr(10) || chr(13) || chr(10) ELSE 'Timeout after ' || event_id || ' ms' END AS archive, date_trunc('second', ts) AS occurred_at, {_NOW} AS ingested_at,
  CASE WHEN c = 9 THEN repeat('t', 33) END AS trace_id, CAST(NULL AS VARCHAR) AS span_id, CASE WHEN c = 8 THEN sha256('ERROR_SYSTEM') ELSE sha256('Timeout after N ms') END AS fingerprint, '{{}}' AS resource, CASE WHEN c <> 10 THEN props END AS attributes, event_id AS arrival_seq,
  CASE WHEN c IN (2, 3, 8) THEN 'missing_field' WHEN c = 1 THEN 'bad_uuid' WHEN c = 4 THEN 'bad_severity' WHEN c = 6 THEN 'bad_category' END AS reason FROM r""",
)
def s06_decode_request(spark, folder):
    """All columns but the new random id."""
    return _plain_times(ingest.decoded_requests(_raw(spark, folder), _now()).drop("log_id"))


@query("a06_issues", f"WITH {ISSUES} SELECT * FROM issues")
def a06_issues(spark, folder):
    return issues.rollup(event_logs(spark, folder))


@query("t10_merge", f"WITH {ISSUES} SELECT * FROM issues")
def t10_merge(spark, folder):
    """Three interleaved batches, merged one after another (also j04): the same as in one go."""
    logs = event_logs(spark, folder)
    a, b, c = (issues.rollup(logs.where(F.col("arrival_seq") % 3 == n)) for n in range(3))
    return issues.merge(issues.merge(a, b), c)


@query("a09_statistics", f"WITH {ISSUES} SELECT project_id, count(*) AS issues, CAST(sum(occurrence_count) AS BIGINT) AS occurrences, count(*) FILTER (WHERE status = 'OPEN') AS open_issues FROM issues GROUP BY project_id")
def a09_statistics(spark, folder):
    return issues.statistics(a06_issues(spark, folder))


@query("p19_search", f"WITH {ISSUES} SELECT project_id, fingerprint, last_occurred_at FROM issues WHERE project_id = 2 AND severity = 'INFO' AND first_occurred_at BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20'")
def p19_search(spark, folder):
    found = issues.search(a06_issues(spark, folder), project_id=2, severity="INFO", since=dt.datetime(2024, 1, 2), until=dt.datetime(2024, 1, 20))
    return found.select("project_id", "fingerprint", "last_occurred_at")


@query("o09_recent", f"WITH {ISSUES} SELECT project_id, fingerprint, last_occurred_at FROM issues ORDER BY last_occurred_at DESC, project_id, fingerprint LIMIT 20")
def o09_recent(spark, folder):
    """The 20 most recent issues (also o10)."""
    return issues.recent(a06_issues(spark, folder), 20).select("project_id", "fingerprint", "last_occurred_at")


@query("d10_status", f"WITH {ISSUES} SELECT status, count(*) AS issues FROM (SELECT CASE WHEN project_id = 1 THEN 'RESOLVED' ELSE status END AS status FROM issues) GROUP BY status")
def d10_status(spark, folder):
    found = a06_issues(spark, folder)
    changes = found.where("project_id = 1").select("project_id", "fingerprint", F.lit("RESOLVED").alias("new_status"))
    return issues.with_status(found, changes).groupBy("status").agg(F.count("*").alias("issues"))


_FALLBACK = "SELECT sha256('INFO_SYSTEM')"


@query("p03_find", f"WITH {ISSUES} SELECT project_id, fingerprint, occurrence_count FROM issues WHERE project_id = 3 AND fingerprint = ({_FALLBACK})")
def p03_find(spark, folder):
    import hashlib

    return issues.find_issue(a06_issues(spark, folder), hashlib.sha256(b"INFO_SYSTEM").hexdigest(), 3).select("project_id", "fingerprint", "occurrence_count")


@query("p13_exists", f"WITH {ISSUES} SELECT count(*) > 0 AS found FROM issues WHERE fingerprint = ({_FALLBACK})")
def p13_exists(spark, folder):
    return a06_issues(spark, folder).where(F.col("fingerprint") == F.sha2(F.lit("INFO_SYSTEM"), 256)).agg((F.count("*") > 0).alias("found"))


@query("p06_contains", f"WITH {LOGS} SELECT arrival_seq FROM logs WHERE json_contains(attributes, '{{\"k\": 69}}')")
def p06_contains(spark, folder):
    return event_logs(spark, folder).where(containment.contains_json(F.col("attributes"), '{"k": 69}')).select("arrival_seq")


@query("p07_contains_both", """SELECT event_id FROM events WHERE json_contains(props, '{"k": 7}') AND json_contains('{"type": "' || event_type || '"}', '{"type": "click"}')""")
def p07_contains_both(spark, folder):
    resource = F.to_json(F.struct(F.col("event_type").alias("type")))
    both = containment.contains_json(F.col("props"), {"k": 7}) & containment.contains_json(resource, {"type": "click"})
    return table(spark, folder, "events").where(both).select("event_id")


_BODIES = """bodies AS (SELECT event_id, CAST(to_json({'type': event_type, 'who': {'user': user_id % 40}, 'marks': [{'k': CAST(json_extract(props, '$.k') AS BIGINT) % 10, 'late': event_id % 2 = 0}, {'k': user_id % 3, 'late': user_id % 2 = 0}]}) AS VARCHAR) AS body FROM events)"""


@query(
    "p06_pattern_table",
    f"""WITH {_BODIES}, patterns AS (SELECT DISTINCT '{{"marks":[{{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) % 10 || ',"late":' || (event_id % 3 = 0) || '}}],"type":"' || event_type || '"}}' AS pattern FROM events
    UNION SELECT DISTINCT '{{"who":{{"user":' || user_id || '}}}}' FROM events UNION SELECT '{{"marks":[]}}')
  SELECT pattern, count(*) AS rows, min(event_id) AS first, CAST(sum(event_id) AS BIGINT) AS ids FROM patterns JOIN bodies ON json_contains(body, pattern) GROUP BY pattern""",
)
def p06_pattern_table(spark, folder):
    """Logs that hold the patterns of a table, which are made of the events too (p06, p07)."""
    events = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    mark = lambda k, late: F.struct(k.alias("k"), late.alias("late"))
    body = F.to_json(F.struct(F.col("event_type").alias("type"), F.struct((F.col("user_id") % 40).alias("user")).alias("who"), F.array(mark(k % 10, F.col("event_id") % 2 == 0), mark(F.col("user_id") % 3, F.col("user_id") % 2 == 0)).alias("marks")))
    late = F.to_json(F.struct(F.array(mark(k % 10, F.col("event_id") % 3 == 0)).alias("marks"), F.col("event_type").alias("type")))
    users = F.to_json(F.struct(F.struct(F.col("user_id").alias("user")).alias("who")))
    patterns = events.select(F.explode(F.array(late, users, F.lit('{"marks":[]}'))).alias("pattern")).distinct().withColumn("of", F.col("pattern"))
    found = containment.containing(events.select("event_id", body.alias("body")), patterns, "event_id", "body", "pattern", "of")
    return found.groupBy("pattern").agg(F.count("*").alias("rows"), F.min("event_id").alias("first"), F.sum("event_id").alias("ids"))


@query("p08_like", f"WITH {LOGS} SELECT arrival_seq FROM logs WHERE archive LIKE 'com.game.err.%' AND archive LIKE '%(Y.java:1)%'")
def p08_like(spark, folder):
    return event_logs(spark, folder).where(F.col("archive").like("com.game.err.%") & F.col("archive").like("%(Y.java:1)%")).select("arrival_seq")


@query("a07_count", f"WITH {LOGS} SELECT count(*) AS logs FROM logs WHERE severity = 'ERROR'")
def a07_count(spark, folder):
    return event_logs(spark, folder).where("severity = 'ERROR'").agg(F.count("*").alias("logs"))


@query("t18_month_window", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS orders FROM orders WHERE o_orderdate >= TIMESTAMP '1996-04-01' AND o_orderdate < TIMESTAMP '1996-08-01' GROUP BY 1")
def t18_month_window(spark, folder):
    """Rows in the accepted months; the bounds reach the scan."""
    orders = table(spark, folder, "orders")
    inside = ingest.in_month_window(F.col("o_orderdate"), F.lit("1996-05-17").cast("timestamp_ntz"))
    return months.stored_months(orders.where(inside), "o_orderdate").withColumnRenamed("rows", "orders")


@query("t17_retention", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS orders FROM orders WHERE date_trunc('month', o_orderdate) = DATE '1996-03-01' GROUP BY 1")
def t17_retention(spark, folder):
    gone = months.expired(F.col("o_orderdate"), F.lit("1996-05-17").cast("timestamp_ntz"))
    return months.stored_months(table(spark, folder, "orders").where(gone), "o_orderdate").withColumnRenamed("rows", "orders")


@query(
    "t16_months",
    """WITH n AS (SELECT date_trunc('month', max(o_orderdate)) AS m FROM orders), d AS (SELECT CAST(m + INTERVAL 1 MONTH * i AS DATE) AS starts FROM n, (SELECT unnest(range(-1, 3)) AS i)),
  s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS rows FROM orders GROUP BY 1)
  SELECT 'game_log_' || strftime(starts, '%Y_%m') AS partition, starts, CAST(starts + INTERVAL 1 MONTH AS DATE) AS ends, coalesce(rows, 0) AS stored, rows IS NOT NULL AS exists FROM d LEFT JOIN s ON month = starts""",
)
def t16_months(spark, folder):
    """The months that must exist when the newest order comes in, and what is stored of them."""
    return months.accepted_months(table(spark, folder, "orders"), "o_orderdate")


@query("f43_month", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, 'game_log_' || strftime(o_orderdate, '%Y_%m') AS partition FROM orders")
def f43_month(spark, folder):
    month = names.month_of(F.col("o_orderdate"))
    return table(spark, folder, "orders").select("o_orderkey", month.alias("month"), names.month_table(month).alias("partition"))


@query("s13_stored_months", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS rows FROM orders GROUP BY 1")
def s13_stored_months(spark, folder):
    """Months present with their rows (also a08)."""
    return months.stored_months(table(spark, folder, "orders"), "o_orderdate")


_EMA = "SELECT user_id, list_reduce(list(CAST(value AS DOUBLE) ORDER BY event_id), lambda a, x: 0.3 * x + 0.7 * a, CAST(0.0 AS DOUBLE)) AS e FROM events WHERE value IS NOT NULL GROUP BY user_id"


@query("a10_ema", f"SELECT user_id, round(e, 6) AS ema FROM ({_EMA})")
def a10_ema(spark, folder):
    rows = table(spark, folder, "events").where("value IS NOT NULL")
    return control.smoothed(rows, "user_id", "event_id", "value").select("user_id", F.round("ema", 6).alias("ema"))


@query("f49_pressure", f"SELECT user_id, CASE WHEN e >= 60 THEN 'CRITICAL' WHEN e >= 40 THEN 'WARN' ELSE 'NORMAL' END AS state FROM ({_EMA})")
def f49_pressure(spark, folder):
    rows = control.smoothed(table(spark, folder, "events").where("value IS NOT NULL"), "user_id", "event_id", "value")
    return rows.select("user_id", control.pressure_state(F.col("ema"), warn_ms=40, critical_ms=60).alias("state"))


_NUMBERED = "n AS (SELECT user_id, event_id, event_id * 1500 AS micros, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)"


@query(
    "t12_rate_limit",
    f"""WITH RECURSIVE {_NUMBERED}, f AS (
  SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS micros, CAST(2000000 AS BIGINT) AS found, CAST(2000000 AS BIGINT) AS level FROM events GROUP BY user_id
  UNION ALL
  SELECT user_id, k, event_id, micros, found, CASE WHEN found >= 1000000 THEN found - 1000000 ELSE found END FROM (
    SELECT f.user_id, n.k, n.event_id, n.micros, CASE WHEN n.k = 1 THEN 2000000 ELSE least(2000000, f.level + (n.micros - f.micros) * 2) END AS found
    FROM f JOIN n ON n.user_id = f.user_id AND n.k = f.k + 1))
SELECT event_id, found >= 1000000 AS passed, CASE WHEN found >= 1000000 THEN level // 1000000 ELSE 0 END AS remaining,
  CASE WHEN found >= 1000000 THEN 0 ELSE CAST(ceil(ceil((1000000 - found) / 2.0) / 1000000.0) AS BIGINT) END AS retry_after FROM f WHERE k > 0""",
)
def t12_rate_limit(spark, folder):
    """Two requests a second per user (also f44)."""
    rows = table(spark, folder, "events").select("user_id", "event_id", (F.col("event_id") * 1500).alias("micros"))
    return control.rate_limited(rows, "user_id", "event_id", "micros", 2).select("event_id", "passed", "remaining", "retry_after")


@query("a14_failure_share", "SELECT event_id, CASE WHEN count(*) OVER w >= 3 THEN avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) OVER w END AS share FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def a14_failure_share(spark, folder):
    """Over the last ten calls (also w03)."""
    calls = table(spark, folder, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"))
    return control.failure_share(calls, "user_id", "event_id", "failed").select("event_id", "share")


@query("t14_consume_once", "SELECT event_id, row_number() OVER (PARTITION BY props ORDER BY event_id) = 1 AS won FROM events")
def t14_consume_once(spark, folder):
    return control.consumed_once(table(spark, folder, "events"), "props", "event_id").select("event_id", "won")


@query("t13_alive", "SELECT event_id FROM events WHERE ts + INTERVAL 1 DAY * (user_id % 5) > TIMESTAMP '2024-01-15 00:00:00'")
def t13_alive(spark, folder):
    """Entries that have not expired (also s14)."""
    stored = table(spark, folder, "events").select("event_id", F.col("ts").alias("written_at"), ((F.col("user_id") % 5) * 86400).alias("ttl_seconds"))
    return control.alive_at(stored, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id")


@query("t04_dead_letters", "SELECT CASE WHEN event_id % 7 + 1 < 5 THEN 'again' ELSE 'dead' END AS fate, count(*) AS rows FROM events WHERE event_type = 'error' GROUP BY 1")
def t04_dead_letters(spark, folder):
    failed = table(spark, folder, "events").where("event_type = 'error'").withColumn("retry_count", F.col("event_id") % 7)
    again, dead = control.retried(failed)
    return again.withColumn("fate", F.lit("again")).unionByName(dead.withColumn("fate", F.lit("dead"))).groupBy("fate").agg(F.count("*").alias("rows"))


@query("t09_backoff", "SELECT event_id, least(30.0, pow(2, event_id % 8)) AS seconds FROM events")
def t09_backoff(spark, folder):
    return table(spark, folder, "events").select("event_id", control.backoff_seconds(F.col("event_id") % 8 + 1).alias("seconds"))


@query("a11_page_meta", f"WITH {ISSUES} SELECT 2 AS page, 10 AS size, count(*) AS totalElements, CAST(ceil(count(*) / 10.0) AS BIGINT) AS totalPages, false AS first, 3 >= ceil(count(*) / 10.0) AS last, 3 < ceil(count(*) / 10.0) AS hasNext, true AS hasPrevious FROM issues")
def a11_page_meta(spark, folder):
    """Totals of a page (also o04)."""
    return paging.page_meta(a06_issues(spark, folder), 2, 10)


@query("t23_transitions", "SELECT from_state, to_state, count(*) AS times FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS from_state, event_type AS to_state FROM events) WHERE from_state <> to_state GROUP BY ALL")
def t23_transitions(spark, folder):
    return control.transitions(table(spark, folder, "events"), "user_id", "event_id", "event_type")


@query(
    "o03_deep_page",
    """WITH p AS (SELECT *, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place, count(*) OVER () AS n FROM orders)
  SELECT o_orderkey, o_orderpriority, o_totalprice FROM p WHERE place > n // 50 * 40 AND place <= n // 50 * 40 + 40""",
)
def o03_deep_page(spark, folder):
    """A page of forty, after four fifths of all orders (o02, o03)."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return paging.deep_page(orders, orders.count() // 50, 40, ["o_orderpriority", "-o_totalprice"], "o_orderkey")


@query("s08_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 33")
def s08_lookup(spark, folder):
    """By primary key; the filter reaches the scan."""
    return table(spark, folder, "orders").where(F.col("o_orderkey") == 33).select("o_orderkey", "o_custkey", "o_totalprice")

