"""Requests that compete for keys, judged in their order, by rounds.

A request is of an entity or makes a new one, and asks for keys in slots (a group's version, a project's content, ...). One by one, it is refused if an entity holds a key that it asks for, and else takes
its keys and frees those that it held. A request that is refused takes and frees nothing, so whether one clashes may depend on all that came before.

In a round, a request knows enough about a slot if no undecided request before it asks for the same key and none before it is of an entity that holds it. One that will clash for sure (a holder has nothing undecided before it) is
doomed: whatever its reason will be, it takes nothing, and others need not wait for what becomes of it. A request is accepted if it knows enough about all slots, and no undecided one before it, doomed or not, asks for a key that it would
take or free: that one must still see the key as it was. The first undecided request is always decided, so rounds end; how many they are goes by the longest chain of requests that depend on one another. Rounds are joins and partial minima by key, so a key that very many ask for is no single task's work, and every round's tables are written.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Steps

#: Later than every request.
NEVER = 2**63 - 1


@dataclass(frozen=True)
class Slot:
    """A column of keys (text; null asks for nothing). reason: of the refusal where the key is held; None: it never is. strict: asking for the key that one holds oneself is a clash too."""

    name: str
    reason: str | None = None
    strict: bool = False


def key_of(*columns: str) -> Column:
    """The columns' values as one text."""
    return F.to_json(F.array(*(F.col(c).cast("string") for c in columns)), {"ignoreNullFields": "false"})


def accept_in_order(requests: DataFrame, state: DataFrame, slots: list[Slot], unchanged: str | None = "unchanged") -> tuple[DataFrame, int]:
    """seq, reason (null: accepted) and did_<slot> (whether the request changes it) of each request, and the number of rounds.

    requests: seq (unique, it is their order), entity (null: a new one), and the slots' columns; state: entity and the slots' columns. unchanged: the reason of requests that change no slot.
    """
    steps = Steps(requests.sparkSession, "acceptance")
    names, unique = [s.name for s in slots], [s for s in slots if s.reason is not None]
    undecided = steps.save(requests.select(F.col("seq").cast("long").alias("seq"), F.col("entity").cast("string").alias("entity"), *names, F.lit(False).alias("doomed")), "undecided0")
    state = state.select(F.col("entity").cast("string").alias("entity"), *names)
    # Only entities that have requests, or hold a key that is asked for, count.
    wanted = [state.join(undecided.select("entity").distinct(), "entity", "left_semi")]
    wanted += [state.where(F.col(s.name).isNotNull()).join(undecided.select(s.name).distinct(), s.name, "left_semi").select(state.columns) for s in unique]
    state = steps.save(reduce(DataFrame.unionByName, wanted).distinct(), "state0")
    n = 0
    while not undecided.isEmpty():
        judged = steps.save(_judged(undecided, state, slots, unique, unchanged), f"judged{n}")
        decided = judged.where("decided").select("seq", "reason", *(f"did_{c}" for c in names))
        steps.append(decided, "decided")
        accepted = judged.where("decided AND reason IS NULL").select(F.col("seq").alias("_seq"), F.col("entity").alias("_entity"), *(F.col(c).alias(f"_{c}") for c in names))
        moved = state.join(accepted.where("_entity IS NOT NULL"), F.col("entity") == F.col("_entity"), "left").select("entity", *(F.coalesce(f"_{c}", c).alias(c) for c in names))
        made = accepted.where("_entity IS NULL").select(F.concat(F.lit("+"), F.col("_seq").cast("string")).alias("entity"), *(F.col(f"_{c}").alias(c) for c in names))
        state = steps.save(moved.unionByName(made), f"state{n + 1}")
        undecided = steps.save(judged.where("NOT decided").select("seq", "entity", *names, "doomed"), f"undecided{n + 1}")
        steps.drop(f"state{n}", f"undecided{n}", f"judged{n}")
        n += 1
    steps.drop(f"state{n}", f"undecided{n}")
    schema = "seq long, reason string" + "".join(f", did_{c} boolean" for c in names)
    return steps.read("decided", schema), n


def _judged(undecided: DataFrame, state: DataFrame, slots: list[Slot], unique: list[Slot], unchanged: str | None) -> DataFrame:
    """Undecided requests with decided, reason, doomed and did_<slot>."""
    live = undecided.where("NOT doomed")
    own = live.where("entity IS NOT NULL").groupBy(F.col("entity").alias("_of")).agg(F.min("seq").alias("_own"))
    rows = undecided.join(own, F.col("entity") == F.col("_of"), "left").drop("_of")
    current = state.select(F.col("entity").alias("_of"), *(F.col(s.name).alias(f"_now_{s.name}") for s in slots))
    rows = rows.join(current, F.col("entity") == F.col("_of"), "left").drop("_of")
    holding = state.join(own, F.col("entity") == F.col("_of"), "left").withColumn("_own", F.coalesce("_own", F.lit(NEVER)))
    for s in unique:
        askers = undecided.where(F.col(s.name).isNotNull()).groupBy(F.col(s.name).alias("_key")).agg(F.min(F.when(~F.col("doomed"), F.col("seq"))).alias(f"_asked_{s.name}"), F.min("seq").alias(f"_seen_{s.name}"))
        holders = holding.where(F.col(s.name).isNotNull()).groupBy(F.col(s.name).alias("_key")).agg(F.max("_own").alias(f"_firm_{s.name}"), F.min("_own").alias(f"_loose_{s.name}"))
        for side in (askers, holders):
            rows = rows.join(side, F.col(s.name) == F.col("_key"), "left").drop("_key")
        watchers = askers.select("_key", F.col(f"_seen_{s.name}").alias(f"_watched_{s.name}"))
        rows = rows.join(watchers, F.col(f"_now_{s.name}") == F.col("_key"), "left").drop("_key")
    did, clash, open_, early = {}, {}, {}, {}
    before = lambda c: F.coalesce(F.col(c) < F.col("seq"), F.lit(False))
    for s in slots:
        asks = F.col(s.name).isNotNull()
        did[s.name] = asks & (F.col("entity").isNull() | ~F.col(s.name).eqNullSafe(F.col(f"_now_{s.name}")))
        if s.reason is not None:
            counts = asks if s.strict else did[s.name]
            clash[s.name] = counts & F.coalesce(F.col(f"_firm_{s.name}") >= F.col("seq"), F.lit(False))
            open_[s.name] = counts & ~clash[s.name] & (before(f"_asked_{s.name}") | before(f"_loose_{s.name}"))
            early[s.name] = did[s.name] & (before(f"_seen_{s.name}") | before(f"_watched_{s.name}"))
    waits = before("_own")  # an earlier request of the entity may still change what it holds
    any_of = lambda columns: reduce(Column.__or__, columns, F.lit(False))
    changes = any_of([*did.values(), *(F.col(s.name).isNotNull() for s in slots if s.strict)])
    reason, pending = F.lit(None).cast("string"), F.lit(False)
    for s in reversed(unique):
        reason = F.when(clash[s.name], s.reason).when(open_[s.name], F.lit(None).cast("string")).otherwise(reason)
        pending = F.when(clash[s.name], False).when(open_[s.name], True).otherwise(pending)
    if unchanged is not None:
        reason, pending = F.when(~changes, unchanged).otherwise(reason), changes & pending
    pending = pending | (reason.isNull() & any_of(list(early.values())))
    return rows.select(
        "seq", "entity", *(s.name for s in slots), (~waits & ~pending).alias("decided"), F.when(~waits, reason).alias("reason"),
        (F.col("doomed") | (~waits & any_of(list(clash.values())))).alias("doomed"), *(c.alias(f"did_{name}") for name, c in did.items()),
    )
