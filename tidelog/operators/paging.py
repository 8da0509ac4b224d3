"""Sorted pages and their totals.

A page far down is found by counts: cuts of the order key come from a sample, the rows before each cut are counted in one pass, and the search goes on in the range that holds the page, until that is a few pages long. Only this range is
sorted. So no row before the page is sorted or moved, whatever the page; a pass reads the range's rows, and their number falls by ``CUTS`` each time. Who walks on from page to page needs no search: ``page_after`` goes on from the last key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cuts of a pass, and sampled keys for each; keys of a range that are looked at one by one.
CUTS, KEYS = 64, 20
FEW = CUTS * KEYS


def page(df: DataFrame, number: int, size: int, order: Sequence[Column | str], tie: str) -> DataFrame:
    """Page ``number`` (from 0). ``tie`` is a unique column, which makes the order total."""
    return df.orderBy(*order, tie).offset(number * size).limit(size)


def page_meta(df: DataFrame, number: int, size: int) -> DataFrame:
    """One row: page, size, totalElements, totalPages, first, last, hasNext, hasPrevious."""
    total = df.agg(F.count("*").alias("totalElements"))
    pages = F.ceil(F.col("totalElements") / size).cast("long")
    return total.select(
        F.lit(number).alias("page"),
        F.lit(size).alias("size"),
        "totalElements",
        pages.alias("totalPages"),
        F.lit(number == 0).alias("first"),
        (F.lit(number + 1) >= pages).alias("last"),
        (F.lit(number + 1) < pages).alias("hasNext"),
        F.lit(number > 0).alias("hasPrevious"),
    )


def range_text(start: int, size: int, total: Column) -> Column:
    """'11-20 / 57' of a page that begins at row ``start`` (from 1)."""
    return F.concat(F.lit(f"{start}-"), F.least(F.lit(start + size - 1), total).cast("string"), F.lit(" / "), total.cast("string"))


def _keys(order: Sequence[str], tie: str) -> list[tuple[str, bool]]:
    """(column, whether it falls) of each part of the key; a name with a minus before it falls."""
    return [(name.removeprefix("-"), name.startswith("-")) for name in (*order, tie)]


def _sorting(keys: list[tuple[str, bool]]) -> list[Column]:
    """Nulls count as the least."""
    return [F.desc_nulls_last(c) if falls else F.asc_nulls_first(c) for c, falls in keys]


def _before(keys: list[tuple[str, bool]], key: Sequence, df: DataFrame, strictly: bool = True) -> Column:
    """Whether a row stands before the key, or at it where not strictly."""
    found = F.lit(not strictly)
    for (name, falls), value in reversed(list(zip(keys, key, strict=True))):
        column, of = F.col(name), F.lit(value).cast(df.schema[name].dataType)
        if value is None:
            first, same = (column.isNotNull() if falls else F.lit(False)), column.isNull()
        else:
            first = F.coalesce(column > of, F.lit(False)) if falls else F.coalesce(column < of, F.lit(True))
            same = F.coalesce(column == of, F.lit(False))
        found = first | (same & found)
    return found


def page_after(df: DataFrame, last: Sequence | None, size: int, order: Sequence[str], tie: str) -> DataFrame:
    """The page that follows the row whose key (values of order and tie) is ``last``; None: the first page. order: names, with a minus before those that fall; nulls count as the least."""
    keys = _keys(order, tie)
    rows = df if last is None else df.where(~_before(keys, last, df, strictly=False))
    return rows.orderBy(*_sorting(keys)).limit(size)


def deep_page(df: DataFrame, number: int, size: int, order: Sequence[str], tie: str) -> DataFrame:
    """Page ``number`` (from 0), however far down. order: names, with a minus before those that fall; ``tie`` is a unique column, and nulls count as the least."""
    keys = _keys(order, tie)
    target, low, high, skipped = number * size, None, None, 0

    def between() -> DataFrame:
        rows = df if low is None else df.where(~_before(keys, low, df))
        return rows if high is None else rows.where(_before(keys, high, df))

    n, tries = df.count(), 0
    if target >= n:
        return df.limit(0)
    while n > 4 * size and n > FEW and tries < 20:
        sampled = between().select(*(c for c, _ in keys)).sample(min(1.0, 2 * FEW / n), seed=(n + tries) % 1_000_003).limit(2 * FEW + FEW).orderBy(*_sorting(keys)).collect()  # a bounded number of keys
        cuts = [tuple(r) for r in sampled[KEYS::KEYS]]
        cuts = [c for i, c in enumerate(cuts) if i == 0 or c != cuts[i - 1]]
        counts = list(between().agg(*(F.count_if(_before(keys, c, df)) for c in cuts)).first()) if cuts else []
        below = [i for i, count in enumerate(counts) if skipped + count <= target]
        above = [i for i, count in enumerate(counts) if skipped + count >= target + size]
        before = counts[below[-1]] if below else 0
        after = counts[above[0]] if above else n
        if after - before >= n:  # a sample that happened to have no cut beside the page
            tries += 1
            continue
        low, high = (cuts[below[-1]] if below else low), (cuts[above[0]] if above else high)
        skipped, n = skipped + before, after - before
    if n > 4 * size:
        at = [tuple(r) for r in between().select(*(c for c, _ in keys)).orderBy(*_sorting(keys)).limit(FEW).collect()] if n <= FEW else []
        if at:
            begin = target - skipped
            low, high, skipped = at[begin], at[begin + size] if begin + size < len(at) else high, target
    rows = between().orderBy(*_sorting(keys))
    return rows.offset(target - skipped).limit(size)
