"""Per-key results when a few keys hold most rows, and joins that survive such keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relgraph.operators.rangescan import PID, range_sorted
from relgraph.sources.scratch import checkpointed


def _runs(keys: pd.Series) -> np.ndarray:
    """Start positions of the runs of equal neighbours; empty for no rows."""
    if len(keys) == 0:
        return np.empty(0, dtype=np.int64)
    return np.flatnonzero(np.r_[True, (keys.to_numpy()[1:] != keys.to_numpy()[:-1])])


def _partial_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One state per key and partition: rows, sum, first and last position, longest step between neighbours."""
    open_: dict | None = None
    for pdf in batches:
        starts = _runs(pdf["key"])
        if len(starts) == 0:
            continue
        at, val = pdf["at"].to_numpy(np.int64), pdf["val"].to_numpy(np.float64)
        ends = np.r_[starts[1:], len(pdf)]
        step = np.r_[0, np.diff(at)]
        step[starts] = 0
        out = pd.DataFrame(
            {
                "key": pdf["key"].to_numpy()[starts],
                PID: pdf[PID].to_numpy()[starts],
                "n": ends - starts,
                "total": np.add.reduceat(val, starts),
                "first_at": at[starts],
                "last_at": at[ends - 1],
                "max_step": np.maximum.reduceat(step, starts),
            }
        )
        if open_ is not None:
            if open_["key"] == out.at[0, "key"]:
                out.loc[0, "max_step"] = max(open_["max_step"], out.at[0, "max_step"], out.at[0, "first_at"] - open_["last_at"])
                out.loc[0, "n"] += open_["n"]
                out.loc[0, "total"] += open_["total"]
                out.loc[0, "first_at"] = open_["first_at"]
            else:
                yield pd.DataFrame([open_])
        open_ = out.iloc[-1].to_dict()
        if len(out) > 1:
            yield out.iloc[:-1]
    if open_ is not None:
        yield pd.DataFrame([open_])


def key_profile(df: DataFrame, key: str, at: str | None, tie: str, value: str | None = None) -> DataFrame:
    """Ordered per-key results without one key delaying the rest.

    Range partition on (key, at, tie), with sampled quantiles, splits heavy keys over partitions; each partition folds
    its rows to one state per key; the states of a key, at most one per partition, are then stitched in partition order.

    Result: key, n_rows, total (sum of value, nulls as 0), first_at and last_at (long), max_step (longest distance
    between neighbouring ``at`` of the key, across partition borders too; 0 for one row).
    ``at`` may be a timestamp (taken in seconds), a date (days) or a number; null ``at`` sorts first, as the smallest
    ``at`` of the whole table, so that it makes no step of its own. Without ``at``, the order is that of ``tie``.
    Rows with a null key have no key and are left out. Repeated rows count as often as they are stored. An empty table
    gives no rows. Other columns of df are ignored, whatever their names.
    """
    kind = df.schema[at].dataType if at else df.schema[tie].dataType
    col = F.col(at or tie)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        pos = F.unix_timestamp(col.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        pos = F.unix_date(col)
    else:
        pos = col.cast("long")
    val = F.coalesce(F.col(value).cast("double"), F.lit(0.0)) if value else F.lit(0.0)
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), pos.cast("long").alias("at"), F.col(tie).cast("long").alias("tie"), val.alias("val")
    )
    low = rows.agg(F.min("at")).first()[0]
    rows = rows.withColumn("at", F.coalesce("at", F.lit(low if low is not None else 0).cast("long")))
    kind_sql = rows.schema["key"].dataType.simpleString()
    states = (
        range_sorted(rows, "key", "at", "tie")
        .drop("tie")
        .mapInPandas(_partial_states, f"key {kind_sql}, {PID} int, n long, total double, first_at long, last_at long, max_step long")
    )
    part = F.struct(PID, "first_at", "last_at", "max_step")
    start = F.struct(F.lit(None).cast("long").alias("last_at"), F.lit(0).cast("long").alias("max_step"))
    return (
        states.groupBy("key")
        .agg(F.sum("n").alias("n_rows"), F.sum("total").alias("total"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.array_sort(F.collect_list(part)).alias("parts"))
        .select(
            F.col("key").alias(key),
            "n_rows",
            "total",
            "first_at",
            "last_at",
            F.aggregate(
                "parts",
                start,
                lambda acc, x: F.struct(
                    x["last_at"].alias("last_at"),
                    F.greatest(acc["max_step"], x["max_step"], x["first_at"] - acc["last_at"]).alias("max_step"),
                ),
                lambda acc: acc["max_step"],
            ).alias("max_step"),
        )
    )


def heavy_keys(df: DataFrame, key: str, tie: str, share: float) -> DataFrame:
    """Keys that hold at least ``share`` of all rows of df as stored: columns key, n_rows.

    The denominator counts every row, repeats and rows with a null key included. Empty table: no rows.
    """
    total = df.count()
    return key_profile(df, key, None, tie).where(F.col("n_rows") >= F.lit(share) * F.lit(total)).select(key, "n_rows")


def _running(batches: Iterator[pd.DataFrame], carried: dict) -> Iterator[pd.DataFrame]:
    prev_key, n0, t0 = None, 0, 0.0
    begun = False
    for pdf in batches:
        starts = _runs(pdf["key"])
        if len(starts) == 0:
            continue
        if not begun:
            prev_key, n0, t0 = carried.get(int(pdf[PID].iloc[0]), (None, 0, 0.0))
            begun = True
        key, val = pdf["key"].to_numpy(), pdf["val"].to_numpy(np.float64)
        lengths = np.diff(np.r_[starts, len(pdf)])
        first = np.repeat(starts, lengths)
        cum = np.cumsum(val)
        seq = np.arange(len(pdf)) - first + 1
        tot = cum - (cum[first] - val[first])
        if prev_key is not None and key[0] == prev_key:
            seq[: lengths[0]] += n0
            tot[: lengths[0]] += t0
        prev_key, n0, t0 = key[-1], int(seq[-1]), float(tot[-1])
        yield pd.DataFrame({"key": key, "tie": pdf["tie"].to_numpy(), "seq": seq, "running_total": tot})


def _partition_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a partition: its first and last key, and rows and sum of the last key in it."""
    pid = first = key = None
    n, t = 0, 0.0
    for pdf in batches:
        starts = _runs(pdf["key"])
        if len(starts) == 0:
            continue
        keys, val = pdf["key"].to_numpy(), pdf["val"].to_numpy(np.float64)
        if first is None:
            pid, first = pdf[PID].iloc[0], keys[0]
        if len(starts) > 1 or keys[0] != key:
            n, t = 0, 0.0
        key, n, t = keys[-1], n + len(pdf) - int(starts[-1]), t + float(val[starts[-1] :].sum())
    if first is not None:
        yield pd.DataFrame({PID: [pid], "first": [first], "key": [key], "n": [n], "t": [t]})


def running_by_key(df: DataFrame, key: str, order: str, tie: str, value: str) -> DataFrame:
    """Position and running sum of every row within its key, heavy keys split over partitions.

    Result: key, tie, seq (1, 2, ... in order of (order, tie), null order first), running_total (null values as 0).
    Rows that agree in key, order and tie are ties: they get different seq in no stated order. Null keys are left out;
    an empty table gives no rows. The state carried over partition borders is one row per partition.
    """
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.col(order).alias("at"), F.col(tie).cast("long").alias("tie"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("val")
    )
    rows = checkpointed(range_sorted(rows, "key", "at", "tie").drop("at"))
    ends = rows.mapInPandas(_partition_ends, f"{PID} int, first {rows.schema['key'].dataType.simpleString()}, key {rows.schema['key'].dataType.simpleString()}, n long, t double")
    carried, state = {}, (None, 0, 0.0)
    for r in sorted(ends.collect(), key=lambda r: r[PID]):  # one row per partition
        carried[r[PID]] = state
        same = state[0] is not None and r["first"] == r["key"] == state[0]
        state = (r["key"], r["n"] + (state[1] if same else 0), r["t"] + (state[2] if same else 0.0))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(lambda it: _running(it, carried), f"key {kind}, tie long, seq long, running_total double").select(
        F.col("key").alias(key), F.col("tie").alias(tie), "seq", "running_total"
    )


def hot_key_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", share: float = 0.001, floor: int = 20_000, counted: DataFrame | None = None) -> DataFrame:
    """Equi-join of a skewed left side with a right side that is unique on ``key``.

    Keys with more than max(floor, share of the left rows) rows are hot: there are at most 1/share of them, so their
    right rows have a proven bound and are broadcast to the left rows where they lie. All other keys shuffle.
    ``counted`` may name a cheaper DataFrame that holds at least the rows of left, to count keys on. ``how``: left or inner.
    """
    counted = left if counted is None else counted
    total = counted.count()
    counts = counted.groupBy(key).count()
    limit = max(floor, int(share * total))
    hot = [r[0] for r in counts.where((F.col("count") > limit) & F.col(key).isNotNull()).select(key).collect()]  # at most 1/share values
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    warm = left.where(~is_hot).join(right.where(~is_hot), key, how)
    return warm.unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how))
