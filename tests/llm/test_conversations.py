"""Repair of conversations against all sequences of edits, and against a plain search."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidelog.llm.conversations import damaged, digests, repair, repaired_conversations

NAMES = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\x0c\r"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        core = text.rstrip(WHITE)
        out.append("blank" if not core.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def legal(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (rest != "" and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def all_edits(rows):
    """Cost, audit and lines of the best of all sequences with at most two inserts in a gap."""
    faults, best = faults_of(rows), None
    gaps = [g for n in range(3) for g in itertools.product("ua", repeat=n)]
    choices = [[("D", None)] + ([] if f in ("blank", "duplicate") else [("K", role[:1] or "?"), ("R", "u"), ("R", "a")]) for (role, _), f in zip(rows, faults, strict=True)]
    for chosen in itertools.product(*choices):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            initials, audit, cost, lines = "", "", 0, []
            for at in range(len(rows) + 1):
                for r in inserted[at]:
                    initials, audit, cost, lines = initials + r, audit + "I", cost + 2, [*lines, f"{NAMES[r]}:"]
                if at < len(rows):
                    edit, r = chosen[at]
                    audit += edit
                    cost += {"D": 3, "K": 0, "R": 2}[edit] + (edit != "D" and faults[at] == "truncated")
                    if edit != "D":
                        initials += r
                        lines = [*lines, f"{NAMES[r] if edit == 'R' else rows[at][0]}:{rows[at][1]}"]
            if legal(initials) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best


MOVES = {("", "s"): "", ("", "u"): "", ("", "a"): "u", ("s", "u"): "", ("s", "a"): "u", ("u", "u"): "a", ("u", "a"): "", ("a", "u"): "", ("a", "a"): "u"}


def plain_search(rows):
    """Row by row, the best way to each role that the turns end with."""
    states = {"": (0, "", [])}
    for (role, text), fault in zip(rows, faults_of(rows), strict=True):
        ways = [(s, (c + 3, a + "D", lines)) for s, (c, a, lines) in states.items()]
        if fault not in ("blank", "duplicate"):
            for s, (c, a, lines) in states.items():
                for edit, r in [("K", role[:1]), ("R", "u"), ("R", "a")]:
                    if (s, r) in MOVES:
                        ins = MOVES[s, r]
                        line = f"{role if edit == 'K' else NAMES[r]}:{text}"
                        ways.append((r, (c + 2 * len(ins) + (edit == "R") * 2 + (fault == "truncated"), a + "I" * len(ins) + edit, [*lines, *(f"{NAMES[i]}:" for i in ins), line])))
        states = {}
        for s, way in ways:
            if s not in states or way[:2] < states[s][:2]:
                states[s] = way
    ends = {"": [], "s": ["user:", "assistant:"], "u": ["assistant:"], "a": []}
    return min((c + 2 * len(ends[s]), a + "I" * len(ends[s]), lines + ends[s]) for s, (c, a, lines) in states.items())


def expected_of(rows, search):
    """By conversation what the summary and the hash should be. rows: conv_id, turn, role, text."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        turns, pairs = [t for t, _, _ in own if t is not None], [(r, x) for _, r, x in own]
        faults = faults_of(pairs)
        cost, audit, lines = search(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found_by(spark, rows):
    turns, summary = repair(spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn int, role string, text string, part string, rows int").repartition(3))
    hashes = {r["conv_id"]: r["sha256"] for r in digests(turns).collect()}
    return {r["conv_id"]: (*(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), hashes.get(r["conv_id"], hashlib.sha256().hexdigest())) for r in summary.collect()}


ROLES, TEXTS = ["system", "user", "assistant", "user", "assistant", "tool", "", None], ["Yes.", "No!", "cut", " ", "", "end. \n", None, "a.b"]


def test_all_sequences_of_edits(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(ROLES), rng.choice(TEXTS)) for c in range(40) for t in range(rng.randint(1, 3))]
    assert found_by(spark, rows) == expected_of(rows, all_edits)


@pytest.mark.parametrize("parts", [4, 23])
def test_long_conversations_are_dealt_in_pieces(spark, parts):
    rng = random.Random(parts)
    rows = [(c, rng.choice([t, t, t, t // 2, None]), rng.choice(ROLES), rng.choice([*TEXTS, f"own {rng.randint(0, 999)}."])) for c, n in ((1, 400), (2, 3), (3, 90), (None, 40), (5, 1)) for t in range(n)]
    rows += [(9, 1, "user", "Hi."), (9, 1, "user", "Hi."), (9, 1, "user", "Hi."), (9, None, "assistant", "Hi.")]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert found_by(spark, rows) == expected_of(rows, plain_search)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_damage_and_lost_conversations(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}. Yes!") for c in range(60) for t in range(c % 4 + 1)] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    harmed = []
    for c, t, r, x in rows:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        r, x = "user" if hit == 4 else r, "" if hit == 1 else x.translate({46: None, 33: None, 63: None}) if hit == 2 else x
        harmed += [(c, t, r, x)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    assert sorted((tuple(r) for r in damaged(frame).collect()), key=str) == sorted(harmed, key=str)
    expected = expected_of(harmed, plain_search)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    got = {r[0]: tuple(r)[1:] for r in repaired_conversations(frame).collect()}
    assert got == {c: expected.get(c, nothing) for c in {r[0] for r in rows}}


def test_empty_table_and_turns(spark):
    frame = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert repaired_conversations(frame).count() == 0
    turns, _ = repair(spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Well?"), (1, 2, "assistant", "Yes."), (1, 3, "user", "Ah.")], frame.schema))
    kept = turns.orderBy("part", "pos", "sub").select(F.concat_ws(":", "edit", "role", "text").alias("line")).collect()
    assert [r["line"] for r in kept] == ["K:user:Hi.", "I:assistant:", "K:user:Well?", "K:assistant:Yes.", "K:user:Ah.", "I:assistant:"]
