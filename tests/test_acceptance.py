"""Requests judged in order by rounds, against a plain loop."""

import random

import pytest

from tidelog.operators import archive
from tidelog.operators.acceptance import Slot, accept_in_order

SLOTS = [Slot("name", "name_taken"), Slot("content", "content_taken"), Slot("flag")]


def one_by_one(requests, state, slots, unchanged="unchanged"):
    """seq: (reason, changes by slot)."""
    now, out = {e: list(keys) for e, *keys in state}, {}
    for seq, entity, *keys in sorted(requests):
        held = now.get(entity)
        did = [k is not None and (held is None or k != held[i]) for i, k in enumerate(keys)]
        asks = [k is not None if s.strict else d for s, k, d in zip(slots, keys, did, strict=True)]
        reason = None if unchanged is None or any(did) or any(a and s.strict for s, a in zip(slots, asks, strict=True)) else unchanged
        if reason is None:
            reason = next((s.reason for i, s in enumerate(slots) if s.reason and asks[i] and any(h[i] == keys[i] for h in now.values())), None)
        if reason is None:
            now[entity or f"+{seq}"] = [k if k is not None else held[i] if held else None for i, k in enumerate(keys)]
        out[seq] = (reason, did)
    return out


def judged(spark, requests, state, slots, unchanged="unchanged"):
    names = [s.name for s in slots]
    kinds = "".join(f", {n} string" for n in names)
    decided, rounds = accept_in_order(spark.createDataFrame(requests, "seq long, entity string" + kinds), spark.createDataFrame(state, "entity string" + kinds), slots, unchanged)
    return {r["seq"]: (r["reason"], [r[f"did_{n}"] for n in names]) for r in decided.collect()}, rounds


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    keys = lambda p, n: rng.choice([None, *(f"{p}{rng.randint(0, n)}" for _ in range(3))])
    state = [(f"e{i}", f"n{i}", f"c{i // 2}" if seed % 2 else f"c{i}", rng.choice("tf")) for i in range(12)]
    requests = [(seq, rng.choice([None, *(f"e{rng.randint(0, 11)}" for _ in range(2))]), keys("n", 18), keys("c", 18), rng.choice(["t", "f", None])) for seq in rng.sample(range(1000), 90)]
    got, rounds = judged(spark, requests, state, SLOTS)
    assert got == one_by_one(requests, state, SLOTS)
    assert 1 <= rounds <= 90


def test_refused_requests_take_nothing(spark):
    requests = [(1, None, "g", "h1", None), (2, None, "G", "h1", None), (3, None, "G", "h2", None)]
    got, rounds = judged(spark, requests, [], SLOTS)
    assert {seq: reason for seq, (reason, _) in got.items()} == {1: None, 2: "content_taken", 3: None}
    assert rounds == 3


def test_rounds_go_by_the_chain_not_by_the_number(spark):
    chain = [(i, None, f"n{i // 2}", f"c{(i + 1) // 2}", None) for i in range(12)]  # each shares a key with the one before it
    crowd = [(100 + i, None, "n0", f"x{i}", None) for i in range(300)] + [(1000 + i, None, f"y{i}", "c0", None) for i in range(300)]
    requests = chain + crowd
    got, rounds = judged(spark, requests, [], SLOTS)
    assert got == one_by_one(requests, [], SLOTS) and rounds <= 13


def test_what_is_freed_can_be_taken(spark):
    state = [("a", "1", "h", None), ("b", "2", "k", None)]
    requests = [(1, "b", "1", None, None), (2, "a", "3", None, None), (3, "b", "1", None, None), (4, "a", "2", "k", None), (5, "b", None, "m", None), (6, "a", None, "k", None), (7, "a", None, "k", None)]
    got, _ = judged(spark, requests, state, SLOTS)
    assert [got[i][0] for i in range(1, 8)] == ["name_taken", None, None, "content_taken", None, None, "unchanged"]


def test_strict_slots_and_no_rows(spark):
    slots = [Slot("name", "taken", strict=True)]
    state = [("a", "x"), ("b", "y")]
    requests = [(1, "a", "x"), (2, "a", "z"), (3, "b", "x"), (4, "a", "y")]
    got, _ = judged(spark, requests, state, slots)
    assert got == one_by_one(requests, state, slots) and [got[i][0] for i in range(1, 5)] == ["taken", None, None, None]
    assert judged(spark, [], state, slots) == ({}, 0)


def test_uploads_in_order(spark):
    """The second is refused for its content, so its group is not made and the third may make it."""
    groups = spark.createDataFrame([], "group_id long, project_id string, category string, group_name string")
    documents = spark.createDataFrame([], "document_id long, group_id long, hash string")
    requests = spark.createDataFrame([(1, "p", "c", "g", 1, 0, 0, "a.pdf", "h1", 5), (2, "p", "c", "G", 1, 0, 0, "a.pdf", "h1", 5), (3, "p", "c", "G", 1, 0, 0, "a.pdf", "h2", 5), (4, "q", "c", "G", 1, 0, 0, "a.pdf", "h3", 5), (5, "p", "c", "g", 1, 0, 0, "", "h1", 5)], "seq long, project_id string, category string, group_name string, major int, minor int, patch int, file_name string, hash string, size long")
    added, refused = archive.upload_documents(requests, groups, documents, spark.createDataFrame([("p",)], "project_id string"))
    assert sorted(r["seq"] for r in added.collect()) == [1, 3]
    assert sorted((r["seq"], r["reason"]) for r in refused.collect()) == [(2, "same_content"), (4, "no_project"), (5, "no_file")]


def test_renames_in_order(spark):
    groups = spark.createDataFrame([(1, "p", "c", "a"), (2, "p", "c", "b")], "group_id long, project_id string, category string, group_name string")
    changes = spark.createDataFrame([(1, 2, "a"), (2, 1, "z"), (3, 2, "a"), (4, 1, "z"), (5, 9, "q")], "seq long, group_id long, new_value string")
    rows, refused = archive.relabel_groups(groups, changes, "group_name")
    assert sorted((r["group_id"], r["group_name"]) for r in rows.collect()) == [(1, "z"), (2, "a")]
    assert sorted((r["seq"], r["reason"]) for r in refused.collect()) == [(1, "group_exists"), (4, "group_exists"), (5, "not_found")]
