import pytest
from pyspark.sql import functions as F

from tidelog.operators import archive, containment, control, ingest, issues, members, months, paging
from tidelog.sources import schemas
from tidelog.sources.tables import event_logs

FOLDER = "/root/testdata/sf0.001"
NOW = "2024-03-15 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def message(spark, **fields):
    base = dict.fromkeys(schemas.RAW_FIELDS) | {"projectId": "550e8400-e29b-41d4-a716-446655440000", "archive": "x", "severity": "INFO", "eventCategory": "SYSTEM", "occurredAt": "2024-03-15T12:00:00Z", "arrival_seq": 1}
    return spark.createDataFrame([(*((base | fields)[c] for c in (*schemas.RAW_FIELDS, "arrival_seq")), None)], schemas.RAW_MESSAGE)


@pytest.mark.parametrize("fields, reason", [
    ({}, None), ({"archive": ""}, None), ({"sessionId": " "}, None), ({"projectId": None}, "missing_field"), ({"archive": None}, "missing_field"), ({"projectId": "1-1-1-1-1"}, "bad_uuid"), ({"logId": "zz"}, "bad_uuid"), ({"severity": "loud"}, "bad_severity"),
    ({"eventCategory": "?"}, "bad_category"), ({"attributes": "[]"}, "bad_json"), ({"archive": "\n\r\n"}, "empty_lines"), ({"spanId": "s" * 17}, "too_long"), ({"occurredAt": "2024-01-31T23:59:59Z"}, "out_of_range"), ({"occurredAt": "2024-02-01T00:00:00Z"}, None), ({"occurredAt": "2024-06-01T00:00:00Z"}, "out_of_range"),
])
def test_decode(spark, fields, reason):
    good, bad = ingest.split_rejected(ingest.decoded(message(spark, **fields), now()), now())
    assert [r["reason"] for r in bad.collect()] == ([reason] if reason else [])
    assert good.count() == (reason is None)


def test_defaults_of_a_message(spark):
    row = ingest.decoded(message(spark, severity=None, eventCategory=None, sessionId="", occurredAt="bad", fingerprint="kept"), now()).first()
    assert (row["session_id"], row["severity"], row["event_category"], row["fingerprint"], row["resource"]) == ("unknown-session", "INFO", "SYSTEM", "kept", "{}")
    assert str(row["occurred_at"]) == NOW and len(row["log_id"]) == 36


def test_empty_message_hashes_without_category(spark):
    import hashlib

    assert ingest.decoded(message(spark, archive=""), now()).first()["fingerprint"] == hashlib.sha256(b"INFO_null").hexdigest()


def test_repeats(spark):
    one = ingest.decoded(message(spark, logId="550e8400-e29b-41d4-a716-446655440001"), now())
    assert ingest.without_repeats(one.unionAll(one)).count() == 1
    assert ingest.without_repeats(one, stored=one).count() == 0


@pytest.mark.parametrize("n", [2, 5])
def test_merge_equals_one_go(spark, n):
    logs = event_logs(spark, FOLDER)
    whole = issues.rollup(logs)
    state = spark.createDataFrame([], whole.schema)
    for k in range(n):
        state = issues.merge(state, issues.rollup(logs.where((F.xxhash64("arrival_seq") % n + n) % n == k)))
    assert whole.exceptAll(state).count() == state.exceptAll(whole).count() == 0


def test_order_of_arrival_wins_and_status_stays(spark):
    row = "project_id long, archive string, severity string, event_category string, occurred_at timestamp_ntz, arrival_seq long"
    make = lambda at, seq, severity: spark.createDataFrame([(1, "boom 1", severity, "SYSTEM")], "project_id long, archive string, severity string, event_category string").withColumns({"occurred_at": F.lit(at).cast("timestamp_ntz"), "arrival_seq": F.lit(seq).cast("long")})
    assert len(row.split(", ")) == 6
    stored = issues.rollup(make("2024-01-02", 1, "WARN"))
    stored = issues.with_status(stored, stored.select("project_id", "fingerprint", F.lit("RESOLVED").alias("new_status")))
    found = issues.merge(stored, issues.rollup(make("2024-01-01", 2, "ERROR"))).first()
    assert (found["occurrence_count"], found["severity"], found["status"]) == (2, "WARN", "RESOLVED")
    assert found["last_occurred_at"] < found["first_occurred_at"]


@pytest.mark.parametrize("body, pattern, holds", [
    ('{"a": 1, "b": "x"}', '{"a": 1}', True), ('{"a": 1.0}', '{"a": 1}', True), ('{"a": "1"}', '{"a": 1}', False), ('{"a": {"b": [1, 2, 3]}}', '{"a": {"b": [3, 1]}}', True), ('{"a": {"b": [1]}}', '{"a": {"b": [2]}}', False),
    ('{"a": null}', '{"a": null}', True), ('{}', '{"a": null}', False), ('{"a": true}', '{"a": true}', True), ('{"a b": "q"}', '{"a b": "q"}', True), ("broken", '{"a": 1}', False), (None, "{}", False), ('{"x": 1}', "{}", True), ("[1]", "{}", False),
])
def test_containment(spark, body, pattern, holds):
    row = spark.createDataFrame([(body,)], "v string").select(containment.contains_json(F.col("v"), pattern).alias("h")).first()
    assert row["h"] is holds


@pytest.mark.parametrize("many", [0, 3, 100_000])
def test_table_of_patterns(spark, many):
    """Against the whole rule on all pairs; entries above ``many`` go by slices."""
    import json
    import random

    rng = random.Random(7)

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.35:
            return {rng.choice(["a", "b", "c c", "é"]): value(depth - 1) for _ in range(rng.randint(0, 3))}
        if depth and kind < 0.6:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([0, 1, 1.0, 2.5, "1", "x", True, False, None, ""])

    texts = [None, "broken", "NaN", "", "[" * 3000] + [json.dumps(value(3)) for _ in range(150)]
    patterns = [None, "{", "{}", "[]", "1", "null"] + [json.dumps(value(2)) for _ in range(60)]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, json string, entry string")
    asked = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(patterns)], "p string, pattern string")
    found = containment.containing(rows, asked, "id", "json", "p", "pattern", many=many)
    expected = {(f"p{j}", i) for i, t in enumerate(texts) for j, p in enumerate(patterns) if containment.parsed(t)[0] and containment.parsed(p)[0] and containment.holds(containment.parsed(t)[1], containment.parsed(p)[1])}
    got = [(r["p"], r["id"]) for r in found.collect()]
    assert set(got) == expected and len(got) == len(expected) > 100
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rule_of_a_table_is_that_of_a_constant(spark):
    texts = ['{"a": [1, {"b": null}], "c": "x"}', '{"a": [true]}', '{"a": {"b": 1.0}}', "[1, 2]", '"x"']
    for pattern in ('{"a": [{"b": null}]}', '{"a": [1]}', '{"a": {"b": 1}}', "[2]", "{}", "[]"):
        rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", containment.contains_json(F.col("v"), pattern).alias("h")).collect()
        assert [r["h"] for r in rows] == [containment.holds(containment.parsed(r["v"])[1], containment.parsed(pattern)[1]) for r in rows], pattern


def test_pressure(spark):
    limits = {"warn_ms": 3000, "critical_ms": 5000}
    for latencies, state in (([3500] * 15, "WARN"), ([6000] * 15, "CRITICAL"), ([6000] * 15 + [500] * 50, "NORMAL")):
        rows = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate(latencies)], "k string, i int, x double")
        assert control.smoothed(rows, "k", "i", "x").select(control.pressure_state(F.col("ema"), **limits).alias("s")).first()["s"] == state


def test_sixth_request_is_refused():
    level = last = None
    out = []
    for _ in range(6):
        level, passed, left, wait = control.take_token(level, last, 0, 5)
        last = 0
        out.append((passed, left, wait))
    assert out == [(True, 4, 0), (True, 3, 0), (True, 2, 0), (True, 1, 0), (True, 0, 0), (False, 0, 1)]


def test_tokens_are_conserved():
    level = last = None
    passed = 0
    for now_ in range(0, 10_000_000, 7_001):
        level, ok, _, _ = control.take_token(level, last, now_, 3)
        last, passed = now_, passed + ok
    assert passed <= 3 + 3 * 10 and passed >= 3 * 10


@pytest.mark.parametrize("sizes", [{"chunk": 20}, {"chunk": 10}, {}])
def test_windows_over_chunks(spark, sizes):
    """A key that holds most rows, in chunks that overlap, against one window a key."""
    rows = spark.range(500).select(F.when(F.col("id") % 9 == 0, "b").when(F.col("id") % 50 == 1, None).otherwise("a").alias("k"), (F.col("id") * 3).alias("n"), (F.xxhash64("id") % 3 == 0).alias("bad"))
    from pyspark.sql import Window

    by_key = Window.partitionBy("k").orderBy("n")
    recent = by_key.rowsBetween(-9, 0)
    expected = rows.withColumn("share", F.when(F.count("*").over(recent) >= 3, F.avg(F.col("bad").cast("int")).over(recent)))
    got = control.failure_share(rows, "k", "n", "bad", **sizes)
    assert got.columns == expected.columns and got.exceptAll(expected).count() == expected.exceptAll(got).count() == 0
    moved = rows.select(F.lag("bad").over(by_key).alias("from_state"), F.col("bad").alias("to_state")).where("from_state != to_state").groupBy("from_state", "to_state").agg(F.count("*").alias("times"))
    found = control.transitions(rows, "k", "n", "bad", **sizes)
    assert found.exceptAll(moved).count() == moved.exceptAll(found).count() == 0 < found.count()


def test_rate_limit_passes_other_columns(spark):
    rows = spark.createDataFrame([("k", n, 1000 * n, {"a": n}) for n in range(6)] + [(None, 9, 0, None)], "k string, n long, t long, other map<string,long>")
    got = {(r["k"], r["n"]): (r["passed"], r["other"]) for r in control.rate_limited(rows, "k", "n", "t", 2).collect()}
    assert got == {("k", n): (n < 2, {"a": n}) for n in range(6)} | {(None, 9): (True, None)}


def _by_one_fold(requests, capacity):
    """What a fold over each key's requests gives. requests: key, order, micros."""
    out, states = {}, {}
    for k, n, t in sorted(requests, key=lambda r: r[1]):
        level, last = states.get(k, (None, None))
        level, ok, left, wait = control.take_token(level, last, t, capacity)
        states[k] = level, t
        out[k, n] = (ok, left, wait)
    return out


@pytest.mark.parametrize("chunk", [5, 64, 10_000])
def test_segments_of_a_bucket_equal_one_fold(spark, chunk):
    import random

    rng = random.Random(chunk)
    requests, t = [], 0
    for n in range(1500):
        t += rng.choice([0, 10, 1000, 300_000, 700_000, 999_999, 1_000_000, 2_500_000]) if rng.random() < 0.9 else -rng.randint(0, 500_000)
        requests.append((rng.choice(["hot", "hot", "hot", "a", None]), n * 1_000_003, t))
    rows = spark.createDataFrame(requests, "k string, n long, t long").repartition(3)
    got = {(r["k"], r["n"]): (r["passed"], r["remaining"], r["retry_after"]) for r in control.rate_limited(rows, "k", "n", "t", 3, chunk=chunk).collect()}
    assert got == _by_one_fold(requests, 3)


def test_hot_bucket_is_dealt_over_tasks(spark):
    """A key with a third of all rows and a gap every hundred: no task has more than a few hundredths of its rows. Without gaps it stays in one, and right."""
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997 + 1).alias("k"), F.col("id").alias("n"), (F.col("id") * 10_000 + F.floor(F.col("id") / 300) * 1_000_000).alias("t"))
        spread = lambda limited: sorted(r["count"] for r in limited.where("k = 0").groupBy(F.spark_partition_id()).count().collect())
        dealt = spread(control.rate_limited(rows, "k", "n", "t", 5, chunk=1000))
        assert sum(dealt) == 20_000 and len(dealt) >= 24 and max(dealt) < 20_000 / 8
        busy = control.rate_limited(rows.withColumn("t", F.col("n") * 10), "k", "n", "t", 5, chunk=1000)
        expected = _by_one_fold([(0, n, n * 10) for n in range(0, 60_000, 3)], 5)
        assert spread(busy) == [20_000] and busy.where("k = 0 AND passed").count() == sum(ok for ok, _, _ in expected.values())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_older_rows_weigh_nothing():
    assert 0.3 * (1 - control.EMA_WEIGHT) ** control.EMA_ROWS == 0.0


def test_page_of_a_million_and_three_documents(spark):
    groups = spark.createDataFrame([(1, "p", "안내", "배포 절차")], schemas.DOCUMENT_GROUP)
    rows = spark.range(3).select(F.lit(1).cast("long").alias("group_id"), F.col("id").alias("document_id"), F.when(F.col("id") == 1, 1).otherwise(0).alias("major"), F.lit(0).alias("minor"), F.lit(0).alias("patch"))
    found = archive.group_summaries(groups, rows).first()
    assert (found["latest_version"], found["document_count"]) == ("v1.0.0", 3)
    assert paging.page_meta(rows, 0, 2).first().asDict() == {"page": 0, "size": 2, "totalElements": 3, "totalPages": 2, "first": True, "last": False, "hasNext": True, "hasPrevious": False}


def test_update_refusals(spark):
    groups = spark.createDataFrame([(1, "p", "c", "g")], schemas.DOCUMENT_GROUP)
    documents = spark.createDataFrame([(n, 1, "d", "pdf", 1, 0, n, f"h{n}", 5, "k", False, None, None) for n in (1, 2)], schemas.DOCUMENT_METADATA)
    change = "seq long, document_id long, new_major int, new_minor int, new_patch int, new_hash string, new_size long, new_file_name string, new_is_processed boolean"
    asked = {"unchanged": (1, 1, 0, 1, None, None, None, False), "version_exists": (1, 1, 0, 2, None, None, None, False), "same_content": (1, 1, 0, 1, "h2", 1, "x.png", False), "not_found": (9, 1, 0, 1, None, None, None, False)}
    for reason, row in asked.items():
        after, refused = archive.update_documents(documents, groups, spark.createDataFrame([(1, *row)], change), now().cast("timestamp"))
        assert [r["reason"] for r in refused.collect()] == [reason]
        assert after.exceptAll(documents).count() == 0
    after, refused = archive.update_documents(documents, groups, spark.createDataFrame([(1, 1, 2, 0, 0, "h9", 7, "x.v1.png", True)], change), now())
    row = after.where("document_id = 1").first()
    assert (row["major"], row["hash"], row["document_name"], row["extension"], row["is_processed"], str(row["reuploaded_at"])) == (2, "h9", "x.v1", "png", True, NOW)
    assert refused.count() == 0


def test_competing_updates(spark):
    """Two changes that ask for one version or one content: the first gets it. Those of one document follow one another."""
    groups = spark.createDataFrame([(1, "p", "c", "g"), (2, "p", "c", "h")], schemas.DOCUMENT_GROUP)
    documents = spark.createDataFrame([(n, 1 + n // 4, "d", "pdf", 1, 0, n, f"h{n}", 5, "k", False, None, None) for n in range(1, 6)], schemas.DOCUMENT_METADATA)
    change = "seq long, document_id long, new_major int, new_minor int, new_patch int, new_hash string, new_size long, new_file_name string, new_is_processed boolean"
    asked = [(5, 1, 9, 0, 0, None, None, None, False), (3, 2, 9, 0, 0, "new", 1, "x.png", False), (7, 3, 1, 0, 3, "new", 1, "y.png", False), (8, 4, 9, 0, 0, None, None, None, False), (9, 4, 9, 0, 1, None, None, None, False), (10, 5, 1, 0, 5, None, None, None, True)]
    after, refused = archive.update_documents(documents, groups, spark.createDataFrame(asked, change), now())
    assert sorted((r["seq"], r["reason"]) for r in refused.collect()) == [(5, "version_exists"), (7, "same_content")]
    assert archive.key_violations(after, "group_id", "major", "minor", "patch").count() == archive.key_violations(after, "hash").count() == 0
    assert sorted((r["document_id"], r["major"], r["hash"], r["is_processed"]) for r in after.collect()) == [(1, 1, "h1", False), (2, 9, "new", False), (3, 1, "h3", False), (4, 9, "h4", False), (5, 1, "h5", True)]
    assert after.where("document_id = 4").first()["patch"] == 1
    assert [r["patch"] for r in archive.siblings(documents, 2).collect()] == [3, 2, 1]


def test_profile_changes_keep_what_is_blank(spark):
    rows = spark.createDataFrame([("m", 1, "GOOGLE", "1", "a@x", "n", "nick", None, "JUNIOR", "CEO", "ACTIVE", None)], schemas.MEMBER)
    change = spark.createDataFrame([("m", "profile", " ", "key", None)], "member_id string, action string, new_nickname string, new_profile_key string, new_position string")
    row = members.change_members(rows, change, now()).first()
    assert (row["nickname"], row["profile_key"], row["position"], row["deleted_at"]) == ("nick", "key", "JUNIOR", None)


def test_months(spark):
    found = [r["partition"] for r in months.months_around(spark, now()).orderBy("starts").collect()]
    assert found == ["game_log_2024_02", "game_log_2024_03", "game_log_2024_04", "game_log_2024_05"]


@pytest.mark.parametrize("order", [["a"], ["-a"], ["b", "-a"], []])
def test_pages_however_far_down(spark, order, monkeypatch):
    """Against all rows in order, with nulls and ties; ranges are narrowed several times."""
    monkeypatch.setattr(paging, "CUTS", 6)
    monkeypatch.setattr(paging, "KEYS", 4)
    monkeypatch.setattr(paging, "FEW", 24)
    rows = spark.range(3000).select(F.when(F.col("id") % 11 != 0, F.xxhash64("id") % 40).alias("a"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("t"), F.col("id") % 3)).alias("b"), F.col("id").alias("k")).cache()
    keys = [(c.removeprefix("-"), c.startswith("-")) for c in (*order, "k")]
    everything = rows.orderBy(*(F.desc_nulls_last(c) if falls else F.asc_nulls_first(c) for c, falls in keys)).collect()
    for number in (0, 1, 57, 298, 299, 300, 1000):
        page = paging.deep_page(rows, number, 10, order, "k")
        assert page.collect() == everything[number * 10 : number * 10 + 10], number
        plan = page._jdf.queryExecution().executedPlan().toString()
        assert ("TakeOrderedAndProject" in plan) == (number < 300)
        if number < 300:
            assert int(plan.split("TakeOrderedAndProject(limit=")[1].split(",")[0]) <= 50
    row = everything[1499]
    after = paging.page_after(rows, [row[c] for c, _ in keys], 10, order, "k")
    assert after.collect() == everything[1500:1510] and paging.page_after(rows, None, 10, order, "k").collect() == everything[:10]


def test_layouts_of_several_ages(spark, tmp_path):
    from tidelog.plans.archive_queries import _LAYOUTS, _TODAY
    from tidelog.sources.layouts import read_layouts, write_layout

    root = f"file://{tmp_path}/logs"
    assert read_layouts(spark, root, _LAYOUTS, _TODAY).count() == 0
    write_layout(spark.sql("SELECT id AS log_id, TIMESTAMP_NTZ '2024-01-05' AS occurred_at, concat('m', id) AS body FROM range(20)"), root, _LAYOUTS[0])
    write_layout(spark.sql("SELECT CAST(id + 20 AS STRING) AS log_id, TIMESTAMP_NTZ '2024-02-05' AS occurred_at, concat('m', id + 20) AS archive, 's' AS session_id, TIMESTAMP_NTZ '2024-02-05' AS created_at FROM range(20)"), root, _LAYOUTS[1])
    whole = read_layouts(spark, root, _LAYOUTS, _TODAY)
    assert [f.simpleString() for f in whole.schema] == [f.simpleString() for f in spark.createDataFrame([], _TODAY).schema] and whole.count() == 40
    for where in ([("log_id", "=", "7")], [("log_id", "in", ["7", "27", "007"])], [("archive", ">=", "m3")], [("session_id", "=", "unknown-session"), ("log_id", "<", "15")]):
        some = read_layouts(spark, root, _LAYOUTS, _TODAY, where, ["log_id", "archive"])
        plain = whole
        for name, op, value in where:
            plain = plain.where(F.col(name).isin(value) if op == "in" else F.expr(f"{name} {op} '{value}'"))
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, plain.select("log_id", "archive").collect())), where
    plan = read_layouts(spark, root, _LAYOUTS, _TODAY, [("log_id", "in", ["7", "27"]), ("archive", ">=", "m")], ["log_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [") == plan.count("In(log_id, [") == 2
    assert "GreaterThanOrEqual(body,m)" in plan and "GreaterThanOrEqual(archive,m)" in plan
    assert "ReadSchema: struct<log_id:bigint,body:string>" in plan and "ReadSchema: struct<log_id:string,archive:string>" in plan


def test_equal_texts_are_looked_up_once(spark, monkeypatch):
    """Copies of a text are one row for index and verification, and all of them are found."""
    from pyspark.sql import functions as F

    from tidelog.operators import containment

    indexed, postings = [], containment._postings
    monkeypatch.setattr(containment, "_postings", lambda rows: indexed.append(rows.count()) or postings(rows))
    rows = spark.range(600).select("id", F.when(F.col("id") % 3 == 0, '{"a": 1}').when(F.col("id") % 3 == 1, '{"a": 2, "b": 1}').alias("body"))
    patterns = spark.createDataFrame([(1, '{"a": 2}'), (2, "{}"), (3, '{"c": 1}')], "p long, pattern string")
    got = containment.containing(rows, patterns, "id", "body", "p", "pattern").collect()
    assert sorted((r["p"], r["id"]) for r in got) == sorted([(1, n) for n in range(600) if n % 3 == 1] + [(2, n) for n in range(600) if n % 3 < 2])
    assert indexed == [2, 3]
