"""References to records that do not exist, or did not exist yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgraph.operators.skew import hot_key_join
from relgraph.sources.scratch import materialize

#: Bits of the Bloom filter for each parent key, and how many of them a key sets, all in one page.
BITS_A_KEY, HASHES = 12, 4
#: Bits of a page, as numbers of 64 bits; a page is a row of the broadcast filter.
PAGE_BITS = 32_768
#: A filter of more bits than this (64 MB) is not broadcast: then every reference goes to the exact join.
MOST_BITS = 2**29


def _page(key: Column, pages: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(2)), F.lit(pages))


def _positions(key: Column) -> list[Column]:
    """Bits of a key within its page, by double hashing."""
    low = F.lit(2**31 - 1)
    h1, h2 = F.xxhash64(key).bitwiseAND(low), F.xxhash64(key, F.lit(1)).bitwiseAND(low)
    return [F.pmod(h1 + F.lit(i) * h2, F.lit(PAGE_BITS)) for i in range(HASHES)]


def bloom_pages(expected: int) -> int:
    """Pages of a filter for so many keys; 0 if it would be too large to broadcast."""
    pages = max(1, -(-expected * BITS_A_KEY // PAGE_BITS))
    return pages if pages * PAGE_BITS <= MOST_BITS else 0


def bloom_filter(keys: DataFrame, key: str, pages: int) -> DataFrame:
    """The filter over a column as (page, bits), bits being PAGE_BITS in numbers of 64; pages without a key are left out."""
    k = F.col(key).cast("long")
    set_ = keys.where(F.col(key).isNotNull()).select(_page(k, pages).alias("page"), F.explode(F.array(*_positions(k))).alias("at"))
    words = set_.groupBy("page", F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("v"))
    held = words.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("word", "v"))).alias("m"))  # PAGE_BITS / 64 entries at most
    zero = F.lit(0).cast("long")
    return held.select("page", F.transform(F.sequence(F.lit(0), F.lit(PAGE_BITS // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), zero)).alias("bits"))


def may_contain(df: DataFrame, key: Column, bloom: DataFrame, pages: int) -> DataFrame:
    """df with a column ``maybe``: whether the filter may hold the key. False is proof of absence.

    The pages are broadcast and looked up by hash; the bits are tested in generated code. Null keys give true, to be
    judged elsewhere.
    """
    k = key.cast("long")
    hit = F.lit(True)
    for at in _positions(k):
        hit = hit & (F.getbit(F.get("bits", F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)
    named = bloom.select(F.col("page").alias("__page"), "bits")
    return df.withColumn("__page", _page(k, pages)).join(F.broadcast(named), "__page", "left").withColumn("maybe", k.isNull() | F.coalesce(hit, F.lit(False))).drop("__page", "bits")


def valid_versions(parents: DataFrame, key: str, version: str, deleted: str, created: str) -> DataFrame:
    """One row per parent key: the version with the latest ``version``; columns key, deleted (boolean), born.

    Null versions lose against all others. Versions that tie are told apart by (deleted, created), greatest first.
    ``born`` is the ``created`` of the valid version. Null keys are left out.
    """
    best = F.max_by(
        F.struct(F.col(deleted).isNotNull().alias("deleted"), F.col(created).alias("born")),
        F.struct(F.col(version).isNotNull(), F.col(version), F.col(deleted).isNotNull(), F.col(created)),
    )
    out = parents.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(best.alias("v"))
    return out.select("key", "v.deleted", "v.born")


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The reason why each reference does not hold, for those that do not.

    refs: table_name, field_name, record_id, ref (long, nullable), created (nullable timestamp).
    parents: what valid_versions gives.
    Result: table_name, field_name, record_id, ref, created, reason, with the first that holds of ``missing`` (no parent
    has the key), ``deleted`` (the valid version is), ``late`` (the parent was created after the record; never if either
    time is null). Null references are no references. Repeated rows come out as often as they are stored.
    Without parents every reference is missing.

    A Bloom filter of the parent keys, sized by their number, is broadcast while it has at most MOST_BITS; what it denies
    is missing for certain. Only what it lets pass is joined, and there a key that holds a large share of the references
    is joined where its rows lie.
    """
    refs = refs.where(F.col("ref").isNotNull())
    held = materialize(parents)
    parents = held.df
    pages = bloom_pages(held.rows)
    if pages:
        bloom = materialize(bloom_filter(parents, "key", pages)).df
        probed = may_contain(refs, F.col("ref"), bloom, pages)
    else:
        probed = refs.withColumn("maybe", F.lit(True))
    sure = probed.where(~F.col("maybe")).withColumn("reason", F.lit("missing")).drop("maybe")
    known = parents.select(F.col("key").alias("ref"), "deleted", "born", F.lit(True).alias("found"))
    checked = hot_key_join(probed.where(F.col("maybe")).drop("maybe"), known, "ref", "left", counted=refs).withColumn(
        "reason",
        F.when(F.col("found").isNull(), "missing").when(F.col("deleted"), "deleted").when(F.col("born") > F.col("created"), "late"),
    )
    return sure.unionByName(checked.where(F.col("reason").isNotNull()).select(sure.columns))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, month of the record's creation (null: unknown) and reason: n_records, n_keys."""
    return orphans.groupBy("table_name", "field_name", F.date_format("created", "yyyy-MM").alias("month"), "reason").agg(
        F.count_distinct("record_id").alias("n_records"), F.count_distinct("ref").alias("n_keys")
    )
