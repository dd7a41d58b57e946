"""Overlapping and gapped time intervals: merge into continuous periods, list the gaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.operators.rangescan import PID, range_sorted
from relgraph.sources.scratch import checkpointed

#: Days that stand for an unbounded start and end; dates of years 1 to 9999 lie well between them.
OPEN_START, OPEN_END = -(2**30), 2**30


def _reach(new: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Running maximum of e, restarted where new holds."""
    shift = (np.cumsum(new) - 1) * np.int64(2**33)
    return np.maximum.accumulate(shift + (e + 2**31)) - shift - 2**31


def _merge(a: np.ndarray, b: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Islands of rows sorted by (a, b, s): a row starts one if it begins more than a day after all earlier ends."""
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    reach = _reach(new, e)
    island = new.copy()
    island[1:] |= s[1:] > reach[:-1] + 1
    at = np.flatnonzero(island)
    last = np.r_[at[1:], len(a)] - 1
    return a[at], b[at], s[at], reach[last]


def _local_islands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Islands as far as one partition can tell."""
    open_ = None
    for pdf in batches:
        if len(pdf) == 0:
            continue
        pid = int(pdf[PID].iloc[0])
        a, b, s, e = (pdf[c].to_numpy(np.int64) for c in ("a", "b", "s", "e"))
        if open_ is not None:
            a, b, s, e = (np.r_[x, y] for x, y in zip(open_, (a, b, s, e)))
        a, b, s, e = _merge(a, b, s, e)
        open_ = (a[-1], b[-1], s[-1], e[-1])
        yield pd.DataFrame({"a": a[:-1], "b": b[:-1], "s": s[:-1], "e": e[:-1], PID: pid})
    if open_ is not None:
        yield pd.DataFrame({"a": [open_[0]], "b": [open_[1]], "s": [open_[2]], "e": [open_[3]], PID: [pid]})


def _rescan(batches: Iterator[pd.DataFrame], carried: dict[int, tuple | None]) -> Iterator[pd.DataFrame]:
    """Walk the local islands again with the reach that earlier partitions carry in; label the true islands.

    A row comes out for every local island: its entity and span, the reach before it, whether it is the entity's first,
    whether a true island begins with it, and the start of its true island.
    """
    last = None
    begun = False
    for pdf in batches:
        if len(pdf) == 0:
            continue
        if not begun:
            last, begun = carried.get(int(pdf[PID].iloc[0])), True
        a, b, s, e = (pdf[c].to_numpy(np.int64) for c in ("a", "b", "s", "e"))
        if last is not None:
            a, b, s, e = (np.r_[x, y] for x, y in zip(last, (a, b, s, e)))
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        reach = _reach(new, e)
        before = np.r_[0, reach[:-1]]
        starts = new | (s > before + 1)
        island = s[np.maximum.accumulate(np.where(starts, np.arange(len(s)), 0))]
        cut = 0 if last is None else 1
        yield pd.DataFrame({"a": a, "b": b, "s": s, "e": e, "before": before, "first": new, "starts": starts, "island": island})[cut:]
        last = (a[-1], b[-1], island[-1], reach[-1])


def _scanned(df: DataFrame, a: str, b: str, start: str, end: str) -> DataFrame:
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        F.col(a).cast("long").alias("a"),
        F.col(b).cast("long").alias("b"),
        F.coalesce(F.unix_date(F.col(start).cast("date")), F.lit(OPEN_START)).alias("s"),
        F.coalesce(F.unix_date(F.col(end).cast("date")), F.lit(OPEN_END)).alias("e"),
    )
    rows = rows.where(F.col("s") <= F.col("e"))
    local = checkpointed(range_sorted(rows, "a", "b", "s", "e").mapInPandas(_local_islands, f"a long, b long, s int, e int, {PID} int"))
    # Summary of a partition: its first entity and its last local island. The local islands of an entity are disjoint
    # and in order, so of the last entity only the last one can still grow.
    ends = local.groupBy(PID).agg(F.min(F.struct("a", "b")).alias("lo"), F.max(F.struct("a", "b", "s", "e")).alias("hi"))
    carried: dict[int, tuple | None] = {}
    state: tuple | None = None
    for r in sorted(ends.collect(), key=lambda r: r[PID]):  # one row per partition
        carried[r[PID]] = state
        a1, b1, s1, e1 = r["hi"]
        if state is not None and tuple(r["lo"]) == (a1, b1) == state[:2] and s1 <= state[3] + 1:
            s1, e1 = state[2], max(e1, state[3])
        state = (a1, b1, s1, e1)
    return local.mapInPandas(
        lambda it: _rescan(it, carried), "a long, b long, s int, e int, before int, first boolean, starts boolean, island int"
    )


def interval_gaps(df: DataFrame, a: str, b: str, start: str, end: str) -> DataFrame:
    """Per entity (a, b), each longest run of days that no interval covers, between days that some interval covers.

    Both end dates belong to an interval; a null start or end is unbounded; an interval that starts after it ends is
    ignored; one that begins the day after another ends leaves no gap. Rows with a null entity id are left out.
    Repeated rows and ties change nothing; an empty table gives no rows; other columns are ignored.
    Result: a, b (long), gap_start, gap_end (date).

    The rows are range-sorted globally by entity and start; partitions merge locally, and what they reach is combined in
    partition order (one row per partition) before the local islands are scanned again with the carried reach.
    """
    scan = _scanned(df, a, b, start, end)
    return scan.where(F.col("starts") & ~F.col("first")).select(
        F.col("a").alias(a),
        F.col("b").alias(b),
        F.date_from_unix_date(F.col("before") + 1).alias("gap_start"),
        F.date_from_unix_date(F.col("s") - 1).alias("gap_end"),
    )


def interval_periods(df: DataFrame, a: str, b: str, start: str, end: str) -> DataFrame:
    """The continuous periods of each entity under the rules of interval_gaps.

    Result: a, b (long), period_start, period_end (date, null where unbounded), n_local (local islands merged into it).
    """
    scan = _scanned(df, a, b, start, end)
    out = scan.groupBy("a", "b", F.col("island").alias("s")).agg(F.max("e").alias("e"), F.count(F.lit(1)).alias("n_local"))
    return out.select(
        F.col("a").alias(a),
        F.col("b").alias(b),
        F.when(F.col("s") > OPEN_START, F.date_from_unix_date("s")).alias("period_start"),
        F.when(F.col("e") < OPEN_END, F.date_from_unix_date("e")).alias("period_end"),
        "n_local",
    )
