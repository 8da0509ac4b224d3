"""Repair of the structure of conversations: the cheapest edits that bring roles into the order ``(s?(ua)+)?``.

Edits: Keep (0), Rerole to user or assistant (2), Delete (3; a must for blank and duplicate rows), Insert an empty turn of user or assistant (2); a truncated row that is not deleted adds 1. Of equally
cheap edits, those whose initials in order (the audit) are least in ASCII.

The search runs over the subsequence of retained (kept or reroled) turns. What lies between two of them is deleted, at a difference of prefix sums of deletions; how many turns must be inserted there
follows from the pair of their roles. So for each role of the last retained turn one running minimum is enough: of its cost less the deletions up to it. A row looks at the four minima (nothing retained
yet, s, u, a), and no earlier row again. Ties go by the rank of the minima's audits: an audit up to a row ends with that row's own edit, none is the start of another, and inserts stand behind the
deletions of their gap as D < I, so the rank of what comes before and the row's own edits decide. Costs are constant per row, whatever the length.

The search needs a row's initial and fault only, so texts stay behind: equal rows are counted up, and narrow rows (a digest in place of the text) are dealt by ranges of (conversation, turn). A conversation of any length is thus cut
into pieces over many tasks. A piece at the edge of a range is searched from each of the four states it may begin in; pieces are then chained by their 4 x 4 costs and ranks, and read back from
there. The texts of retained rows join last.

Defined results: null role or text: one space. Rows of one turn are taken by role, then by the MD5 of the text; null turns come first; equal rows are adjacent, all but the first are duplicates. A null conv_id is a
conversation of its own. An empty role has no initial, so such a row is not kept as it is. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .shared import Scratch, shuffle_partitions

#: States: nothing retained yet, or the role of the last retained turn.
START, S, U, A = range(4)
STATES = {"s": S, "u": U, "a": A}
NAMES = {U: "user", A: "assistant"}
#: Turns to insert between a state and the next role (None: not possible), and at the end.
INSERTS = {(START, S): 0, (START, U): 0, (START, A): 1, (S, U): 0, (S, A): 1, (U, U): 1, (U, A): 0, (A, U): 0, (A, A): 1}
AT_END = {START: 0, S: 2, U: 1, A: 0}
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
WHITE = " \t\n\x0b\x0c\r"
NEVER = 1 << 60
#: Place of what is inserted at the end of a conversation.
LAST = 2**31 - 1


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: rows with faults put in by the CRC-32 of conv_id:turn, modulo 20 (0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes its role user)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "UTF-8")) % 20
    rows = df.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), hit.alias("hit")).where("hit != 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _fault(text: Column) -> Column:
    """Of the text by itself."""
    core = F.rtrim(text, F.lit(WHITE))
    return F.when(core == "", BLANK).when(F.right(core, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)


class Minimum(NamedTuple):
    """A running minimum: the cost less the deletions so far, and the place of its audit among those of the four."""

    cost: int
    rank: int


class Search:
    """The search over one piece, from one state at its begin."""

    def __init__(self, entry: int):
        self.best: list[Minimum | None] = [Minimum(0, 0) if s == entry else None for s in range(4)]
        self.back = bytearray()

    def row(self, initial: str, fault: int) -> None:
        """Each state goes on from itself by deleting the row, or from another by retaining it: a byte each to read back."""
        if fault in (BLANK, DUPLICATE):
            self.back += b"\0\0\0\0"
            return
        found: list[tuple[int, tuple[int, str], int] | None] = [None if m is None else (m.cost, (m.rank, "D"), 0) for m in self.best]
        for role in (S, U, A):
            kept = STATES.get(initial) == role
            if not kept and role == S:
                continue
            own = (KEEP if kept else REROLE) + (fault == TRUNCATED) - DELETE
            for state in range(4):
                inserts, before = INSERTS.get((state, role)), self.best[state]
                if inserts is not None and before is not None:
                    edits = "I" * inserts + ("K" if kept else "R")
                    way = before.cost + INSERT * inserts + own, (before.rank, edits), 1 | state << 1 | inserts << 3 | (not kept) << 4
                    if found[role] is None or way < found[role]:
                        found[role] = way
        ranks = {key: n for n, key in enumerate(sorted(way[1] for way in found if way))}
        self.best = [Minimum(way[0], ranks[way[1]]) if way else None for way in found]
        self.back += bytes(way[2] if way else 0 for way in found)

    def finish(self) -> int | None:
        """The state at the end of the whole conversation's cheapest edits."""
        return ending([m and (m.cost, m.rank) for m in self.best])


def ending(best: list[tuple[int, int] | None]) -> int:
    return min((m[0] + INSERT * AT_END[s], m[1], s) for s, m in enumerate(best) if m)[2]


def read_back(back: bytes, state: int) -> list[tuple[str, int, int]]:
    """By row: edit (K, R or D), role (a state), turns inserted before."""
    edits = []
    for at in range(len(back) - 4, -1, -4):
        way = back[at + state]
        if way & 1:
            edits.append(("R" if way >> 4 & 1 else "K", state, way >> 3 & 1))
            state = way >> 1 & 3
        else:
            edits.append(("D", state, 0))
    return edits[::-1]


def audit_of(edits: list[tuple[str, int, int]], copies: list[int]) -> str:
    return "".join("I" * inserts + edit + "D" * (n - 1) for (edit, _, inserts), n in zip(edits, copies, strict=True))


class Piece:
    """The rows of a conversation in one range, and what is counted of them."""

    def __init__(self, conv, entries: tuple[int, ...]):
        self.conv, self.searches = conv, {e: Search(e) for e in entries}
        self.keys: list[tuple] = []
        self.copies: list[int] = []
        self.count = [0, 0, 0, 0]
        self.illegal = self.distinct = 0
        self.first = self.last = None  # initials
        self.turns: list = [None, None]  # first and last turn that is not null

    def add(self, turn, role: str, digest: str, fault: int, n: int) -> None:
        initial = role[:1]
        for search in self.searches.values():
            search.row(initial, fault)
        self.keys.append((turn, role, digest))
        self.copies.append(n)
        self.count[fault] += 1
        self.count[fault if fault == BLANK else DUPLICATE] += n - 1
        same = initial + initial not in ("su", "ua", "au")
        self.illegal += (n - 1) * same + (self.first is not None and self.last + initial not in ("su", "ua", "au"))
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None and turn != self.turns[1]:
            self.distinct += 1
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn]


def _fields(conv, turn) -> StructType:
    """Rows and summaries of pieces, in one table: a summary has pos -1."""
    plain = StructType.fromDDL("part int, pos int, role string, digest string, copies long, done boolean, edit string, to int, inserts int, back binary, rows long, blank long, duplicate long, truncated long, illegal long, distinct_turns long, first string, last string, costs array<long>, ranks array<long>, cost long, audit string, exit int")
    turns = [StructField(n, turn.dataType, True) for n in ("turn", "first_turn", "last_turn")]
    return StructType([StructField("conv_id", conv.dataType, True), *turns, *plain.fields])


def _folded(names: list[str], kinds: pa.Schema):
    """Searches the sorted rows of a range. Pieces that lie within it are decided at once; the first and the last one may go on in other ranges."""

    def out_of(piece: Piece, part: int, open_: bool) -> Iterator[dict]:
        cost = audit = exit_ = edits = None
        rows = sum(piece.copies)
        if not open_:
            search = piece.searches[START]
            exit_ = search.finish()
            edits = read_back(bytes(search.back), exit_)
            audit = audit_of(edits, piece.copies) + "I" * AT_END[exit_]
            cost = search.best[exit_].cost + DELETE * rows + INSERT * AT_END[exit_]
        for pos, ((turn, role, digest), n) in enumerate(zip(piece.keys, piece.copies, strict=True)):
            row = {"conv_id": piece.conv, "turn": turn, "part": part, "pos": pos, "role": role, "digest": digest, "copies": n, "done": not open_}
            if edits:
                row |= {"edit": edits[pos][0], "to": edits[pos][1], "inserts": edits[pos][2]}
            else:
                row |= {"back": b"".join(bytes(piece.searches[e].back[4 * pos : 4 * pos + 4]) if e in piece.searches else b"\0\0\0\0" for e in range(4))}
            yield row
        best = [piece.searches[e].best if e in piece.searches else [None] * 4 for e in range(4)]
        yield {
            "conv_id": piece.conv, "first_turn": piece.turns[0], "last_turn": piece.turns[1], "part": part, "pos": -1, "done": not open_, "rows": rows, "blank": piece.count[BLANK], "duplicate": piece.count[DUPLICATE], "truncated": piece.count[TRUNCATED],
            "illegal": piece.illegal, "distinct_turns": piece.distinct, "first": piece.first, "last": piece.last, "cost": cost, "audit": audit, "exit": exit_,
            "costs": [m.cost if m else NEVER for b in best for m in b], "ranks": [m.rank if m else 0 for b in best for m in b],
        }

    def batches_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.field(n).type) for n in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, n_pieces, out = TaskContext.get().partitionId(), None, 0, []
        for batch in batches:
            for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "fault", "copies")), strict=True):
                if piece is None or piece.conv != conv:
                    if piece is not None:
                        out += out_of(piece, part, n_pieces == 1)
                    # A conversation behind another one begins here.
                    piece, n_pieces = Piece(conv, (START,) if n_pieces else (START, S, U, A)), n_pieces + 1
                    if len(out) >= 4096:
                        yield batches_of(out)
                        out = []
                piece.add(*row)
        if piece is not None:
            out += out_of(piece, part, True)
        if out:
            yield batches_of(out)

    return run


def _chained(kinds: pa.Schema, names: list[str]):
    """For one conversation, its open pieces: by piece the states at its begin and end, and the whole conversation's cost (with its last piece)."""

    def run(pieces: pa.Table) -> pa.Table:
        rows = sorted(pieces.select(["conv_id", "part", "costs", "ranks", "rows"]).to_pylist(), key=lambda r: r["part"])
        best: list[tuple[int, int] | None] = [(0, 0), None, None, None]
        ways: list[list[int]] = []
        for piece in rows:
            found: list[tuple | None] = [None] * 4
            for exit_ in range(4):
                for entry, m in enumerate(best):
                    at = 4 * entry + exit_
                    if m and piece["costs"][at] < NEVER:
                        way = m[0] + piece["costs"][at], (m[1], piece["ranks"][at]), entry
                        found[exit_] = way if found[exit_] is None else min(found[exit_], way)
            ranks = {key: n for n, key in enumerate(sorted({w[1] for w in found if w}))}
            best = [w and (w[0], ranks[w[1]]) for w in found]
            ways.append([w[2] if w else START for w in found])
        state = ending(best)
        cost = best[state][0] + DELETE * sum(r["rows"] for r in rows) + INSERT * AT_END[state]
        out = []
        for n in range(len(rows) - 1, -1, -1):
            out.append({"conv_id": rows[n]["conv_id"], "part": rows[n]["part"], "entry": ways[n][state], "exit": state, "cost": cost if n == len(rows) - 1 else None})
            state = ways[n][state]
        return pa.Table.from_arrays([pa.array([r[c] for r in out], kinds.field(c).type) for c in names], names)

    return run


def _decided(kinds: pa.Schema, names: list[str]):
    """The rows of one open piece with their edits, and the piece's audit in a row with pos -1."""

    def run(piece: pa.Table) -> pa.Table:
        rows = sorted(piece.to_pylist(), key=lambda r: r["pos"])
        entry, exit_ = rows[0]["entry"], rows[0]["exit"]
        edits = read_back(b"".join(r["back"][4 * entry : 4 * entry + 4] for r in rows), exit_)
        out = [r | {"edit": e, "to": to, "inserts": n} for r, (e, to, n) in zip(rows, edits, strict=True)]
        out.append({"conv_id": rows[0]["conv_id"], "part": rows[0]["part"], "pos": -1, "audit": audit_of(edits, [r["copies"] for r in rows])})
        return pa.Table.from_arrays([pa.array([r.get(c) for r in out], kinds.field(c).type) for c in names], names)

    return run


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def repair(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired turns and a summary of each conversation that has rows. df: conv_id, turn, role, text.

    Turns: conv_id, part, pos, sub (in this order), role, text, edit (K, R or I). Summary: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    """
    scratch = Scratch(df.sparkSession, "conversations")
    text_of = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = df.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text")).withColumn("digest", F.md5(F.encode("text", "UTF-8")))
    key = ["conv_id", "turn", "role", "digest"]
    narrow = scratch.save(rows.select(*key, _fault(F.col("text")).alias("fault")).groupBy(*key).agg(F.max("fault").alias("fault"), F.count("*").alias("copies")), "narrow")
    again = narrow.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    again = again.select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest")), "first")
    same = narrow["conv_id"].eqNullSafe(again["_conv_id"]) & (narrow["role"] == again["_role"]) & (narrow["digest"] == again["_digest"])
    repeats = (F.col("first.has") & (F.col("turn") > F.col("first.turn"))) | (~F.col("first.has") & F.col("turn").isNotNull())
    fault = F.when((F.col("fault") != BLANK) & F.coalesce(repeats, F.lit(False)), DUPLICATE).otherwise(F.col("fault"))
    marked = scratch.save(narrow.join(again, same, "left").select(*key, fault.alias("fault"), "copies"), "marked")
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    schema = _fields(df.schema["conv_id"], df.schema["turn"])
    ranged = marked.repartitionByRange(max(1, shuffle_partitions(df.sparkSession)), *order).sortWithinPartitions(*order)
    folded = scratch.save(ranged.mapInArrow(_folded(schema.names, _arrow(schema)), schema), "folded")
    scratch.drop("narrow", "marked")

    pieces = folded.where("pos = -1")
    chain = StructType([schema["conv_id"], *StructType.fromDDL("part int, entry int, exit int, cost long").fields])
    chained = scratch.save(pieces.where("NOT done").groupBy("conv_id").applyInArrow(_chained(_arrow(chain), chain.names), chain), "chained")
    named = chained.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "entry", F.col("exit").alias("_exit"), F.col("cost").alias("_cost"))
    here = lambda rows: rows["conv_id"].eqNullSafe(named["_conv"]) & (rows["part"] == named["_part"])
    row = ["conv_id", "turn", "part", "pos", "role", "digest", "copies", "edit", "to", "inserts", "audit"]
    row_schema = StructType([schema[c] for c in row])
    open_rows = folded.where("pos >= 0 AND NOT done")
    asked = open_rows.join(named, here(open_rows)).select("conv_id", "turn", "part", "pos", "role", "digest", "copies", "back", "entry", F.col("_exit").alias("exit"))
    late = scratch.save(asked.groupBy("conv_id", "part").applyInArrow(_decided(_arrow(row_schema), row), row_schema), "late")

    open_pieces = pieces.where("NOT done")
    audits = late.where("pos = -1").select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.col("audit").alias("_audit"))
    open_pieces = open_pieces.drop("exit", "cost", "audit").join(named, here(open_pieces))
    open_pieces = open_pieces.join(audits, open_pieces["conv_id"].eqNullSafe(audits["_c"]) & (open_pieces["part"] == audits["_p"]))
    counts = ["rows", "blank", "duplicate", "truncated", "illegal", "distinct_turns"]
    before = Window.partitionBy("conv_id").orderBy("part")
    of_turns = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    met = F.concat(F.lag("last").over(before), F.col("first"))
    linked = open_pieces.withColumns({"clash": F.coalesce((~met.isin("su", "ua", "au")).cast("long"), F.lit(0)), "shared": F.coalesce((F.max("last_turn").over(of_turns) == F.col("first_turn")).cast("long"), F.lit(0))})
    joined = linked.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in counts if c not in ("illegal", "distinct_turns")), F.sum(F.col("illegal") + F.col("clash")).alias("illegal"), F.sum(F.col("distinct_turns") - F.col("shared")).alias("distinct_turns"),
        F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"), F.max("_cost").alias("cost"), F.max(F.struct("part", "_exit"))["_exit"].alias("exit"), F.max("part").alias("part"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "_audit"))), lambda a: a["_audit"]), "").alias("audit"),
    )
    ends = F.element_at(F.array(*(F.lit("I" * AT_END[s]) for s in range(4))), F.col("exit") + 1)
    columns = ["conv_id", *counts, "first_turn", "last_turn", "cost", "exit", "part", "audit"]
    whole = scratch.save(pieces.where("done").select(*columns).unionByName(joined.withColumn("audit", F.concat("audit", ends)).select(*columns)), "whole")
    gaps = F.coalesce(F.col("last_turn").cast("long") - F.col("first_turn").cast("long") + 1 - F.col("distinct_turns"), F.lit(0))
    summary = whole.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    retained = folded.where("pos >= 0 AND done").select(*row).unionByName(late.where("pos >= 0")).where("edit != 'D'").select(*(F.col(c).alias(f"_{c}") for c in key), "part", "pos", "edit", "to", "inserts")
    texts = rows.dropDuplicates(key)
    of_row = texts["conv_id"].eqNullSafe(retained["_conv_id"]) & texts["turn"].eqNullSafe(retained["_turn"]) & (texts["role"] == retained["_role"]) & (texts["digest"] == retained["_digest"])
    turn_of = lambda sub, role, text, edit: F.struct(F.lit(sub).alias("sub"), role.alias("role"), text.alias("text"), F.lit(edit).alias("edit") if isinstance(edit, str) else edit.alias("edit"))
    user, assistant, nothing = F.lit(NAMES[U]), F.lit(NAMES[A]), F.lit("")
    new_role = F.when(F.col("edit") == "K", F.col("role")).when(F.col("to") == U, user).otherwise(assistant)
    own = turn_of(1, new_role, F.col("text"), F.col("edit"))
    inserted = turn_of(0, F.when(F.col("to") == U, assistant).otherwise(user), nothing, "I")
    kept = texts.join(retained, of_row).select("conv_id", "part", "pos", F.explode(F.when(F.col("inserts") > 0, F.array(inserted, own)).otherwise(F.array(own))).alias("turn"))
    last = F.when(F.col("exit") == S, F.array(turn_of(0, user, nothing, "I"), turn_of(1, assistant, nothing, "I"))).otherwise(F.array(turn_of(0, assistant, nothing, "I")))
    added = whole.where(F.col("exit").isin(S, U)).select("conv_id", "part", F.lit(LAST).alias("pos"), F.explode(last).alias("turn"))
    turns = kept.unionByName(added).select("conv_id", "part", "pos", "turn.sub", "turn.role", "turn.text", "turn.edit")
    return turns, summary


def digests(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """conv_id, sha256: of ``role:text`` of the turns in order, joined by newlines.

    A hash of that kind is computed from front to back, so the turns of one conversation pass through one task, one batch at a time; nothing of them is held.
    """
    kind = StructType([turns.schema["conv_id"], *StructType.fromDDL("sha256 string").fields])
    arrow = _arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, state = False, None, None
        for batch in batches:
            done = []
            for of, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if begun and of == conv:
                    state.update(b"\n")
                else:
                    if begun:
                        done.append((conv, state.hexdigest()))
                    begun, conv, state = True, of, hashlib.sha256()
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], arrow.field(i).type) for i in range(2)], arrow.names)
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([v], arrow.field(i).type) for i, v in enumerate((conv, state.hexdigest()))], arrow.names)

    dealt = turns.repartition(partitions or shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "pos", "sub")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, kind)


def repaired_conversations(df: DataFrame, harm=damaged) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conv_id of df, after ``harm``; conversations that lose all rows have zeros, an empty audit and the hash of nothing."""
    turns, summary = repair(harm(df))
    hashes = digests(turns)
    ids = df.select("conv_id").distinct()
    summary = summary.select(F.col("conv_id").alias("_conv"), *summary.columns[1:])
    hashes = hashes.select(F.col("conv_id").alias("_of"), "sha256")
    rows = ids.join(summary, ids["conv_id"].eqNullSafe(summary["_conv"]), "left").join(hashes, ids["conv_id"].eqNullSafe(hashes["_of"]), "left")
    numbers = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return rows.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
