import datetime
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from graphs import edges, groups, nodes, reach

from relgraph.operators.hierarchy import Hierarchy
from relgraph.operators.intervals import interval_gaps, interval_periods
from relgraph.operators.orphans import bloom_filter, bloom_pages, may_contain, orphan_references, orphan_report, valid_versions
from relgraph.operators.skew import heavy_keys, hot_key_join, key_profile, running_by_key
from relgraph.operators.units import linked_measures, noted_unit, pairwise_scales, ratio_groups, recorded_units, source_factors, spelled_unit, stated_measure

DAY0 = datetime.date(1970, 1, 1)


def day(n):
    return None if n is None else DAY0 + datetime.timedelta(days=n)


# Hierarchies -------------------------------------------------------------------------------------------------------


def test_hierarchy_of_shared_and_cyclic_parts(spark):
    rows = [(1, 2), (1, 2), (2, 3), (3, 2), (3, 4), (1, 4), (5, 5), (None, 6), (7, None)]
    h = Hierarchy(spark.createDataFrame([(a, b, "x") for a, b in rows], "p int, c int, node string"), "p", "c")
    assert sorted(tuple(r) for r in h.cycles().collect()) == [(2, 2), (2, 3), (5, 5)]
    assert sorted(tuple(r) for r in h.back_edges.collect()) == [(3, 2), (5, 5)]
    got = {r["node"]: r.asDict() for r in h.nodes().collect()}
    assert {k: (v["in_cycle"], v["depth"], v["max_depth"], int(v["n_paths"]), v["root"], v["path"]) for k, v in got.items()} == {
        1: (False, 0, 0, 1, 1, [1]),
        2: (True, 1, 1, 1, 1, [1, 2]),
        3: (True, 1, 1, 1, 1, [1, 2]),
        4: (False, 1, 2, 2, 1, [1, 4]),
        5: (True, 0, 0, 1, 5, [5]),
    }
    assert sorted(tuple(r) for r in h.below().collect()) == [(1, 2), (1, 3), (1, 4), (2, 2), (2, 3), (2, 4), (3, 2), (3, 3), (3, 4), (5, 5)]
    assert sorted(tuple(r) for r in h.roots().collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)]


def test_hierarchy_longest_way(spark):
    """Only what the question needs: no paths, no counts of ways."""
    rows = [(1, 2), (2, 3), (3, 2), (3, 4), (4, 5), (1, 5), (9, 5), (5, 6)]
    assert [r["longest"] for r in Hierarchy(edges(spark, rows), "src", "dst").longest().collect()] == [4]
    assert [r["longest"] for r in Hierarchy(edges(spark, []), "src", "dst").longest().collect()] == [None]


def test_depth_per_root_counts_a_node_for_each_root(spark, tmp_path):
    from relgraph.queries.catalogue import QUERIES

    rows = [(1, 2), (2, 3), (3, 2), (3, 4), (4, 5), (1, 5), (9, 5), (5, 6)]
    assert sorted(tuple(r) for r in Hierarchy(edges(spark, rows), "src", "dst").spans().collect()) == [(1, 4, 6), (9, 2, 3)]
    assert Hierarchy(edges(spark, []), "src", "dst").spans().count() == 0
    spark.createDataFrame([(5, 1), (7, 2)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(tuple(r) for r in QUERIES["q16_depth_per_root"](spark, str(tmp_path)).collect()) == [(1, 1, 2), (2, 1, 3), (3, 1, 2)]


def test_hierarchy_empty_and_random(spark):
    none = Hierarchy(spark.createDataFrame([], "p int, c int"), "p", "c")
    assert none.cycles().count() == none.nodes().count() == none.below().count() == none.roots().count() == 0
    rng = random.Random(3)
    rows = [(rng.randrange(14), rng.randrange(14)) for _ in range(22)]
    h = Hierarchy(edges(spark, rows), "src", "dst")
    found = defaultdict(list)
    for r in h.cycles().collect():
        found[r["cycle_id"]].append(r["node"])
    assert {tuple(sorted(v)) for v in found.values()} == groups(rows)
    ids = {x for e in rows for x in e}
    want = {(a, b) for a in ids for b in set().union(*[set(reach(rows, c)) for s, c in rows if s == a] or [set()])}
    assert {tuple(r) for r in h.below().collect()} == want


# Units -------------------------------------------------------------------------------------------------------------


def test_units_in_texts(spark):
    texts = [" KG ", "gr", "GRS", "gr.144", '"', "fl.oz.", "see note", "", None, "ST", "mtr", "TO"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(spelled_unit(df.t)).collect()] == ["kg", "g", "gross", "gross", "in", "floz", None, None, None, "each", "m", "t"]
    notes = ["needs 3 dozens at station 4", "qty in gross (144)", "12 fl oz per assembly", "Menge/quantity: 5kg, checked at line 2", "UoM = mm", "counted in US gallons; see 3", "amount as in (by hand)", "supplied with 9 g desiccant bag", "label 5 mm from the edge", "was 4 pcs in rev A", None, ""]
    df = spark.createDataFrame([(t,) for t in notes], "t string")
    assert [r[0] for r in df.select(noted_unit(df.t)).collect()] == ["dozen", "gross", "floz", "kg", "mm", "gal", "in", None, None, None, None, None]
    measures = ["hose DN 29 L=1273mm", "Tube, 5,19 ft length (3.2lb)", "series 12", None, "COPPER (30g)", "x" * 200_000 + " 7.5 cm"]
    df = spark.createDataFrame([(t,) for t in measures], "t string")
    n, u = stated_measure(df.t, "m")
    assert [tuple(r) for r in df.select(n, u).collect()] == [(1273.0, "mm"), (5.19, "ft"), (None, None), (None, None), (None, None), (7.5, "cm")]
    n, u = stated_measure(df.t, "kg")
    assert [tuple(r) for r in df.select(n, u).collect()][1::3] == [(3.2, "lb"), (30.0, "g")]


PARTS = "id long, description string, weight_kg double, unit_weight_kg double, unit_length_m double, base string"


def test_recorded_units(spark):
    rows = [
        (1, "a", 2.0, 2.01, None, "b"), (2, "a", 2.0, 2003.0, None, "b"), (3, "a", 0.5, 1.1023, None, "b"), (3, "a", 0.5, 1.1023, None, "b"),
        (4, "x, mass 32 oz", None, 907.2, None, "b"), (5, None, None, 5.0, None, "b"), (6, "L=120cm", None, None, 47.24, "b"), (7, "L=120cm", None, None, 1.2, "b"),
        (8, "tube", 1.0, None, 3.0, "b"), (9, "a", 1.0, 17.0, None, "b"), (10, "a", 0.0, 1.0, None, None), (11, "a", 3.0, 0.003, None, None),
    ]
    got = {(r["id"], r["base"]): r["unit"] for r in recorded_units(spark.createDataFrame(rows, PARTS)).collect()}
    assert got == {(1, "kg"): "kg", (2, "kg"): "g", (3, "kg"): "lb", (4, "kg"): "g", (5, "kg"): None, (6, "m"): "in", (7, "m"): "m", (8, "m"): None, (9, "kg"): None, (10, "kg"): None, (11, "kg"): "t"}
    assert recorded_units(spark.createDataFrame([], PARTS)).count() == 0 and pairwise_scales(linked_measures(spark.createDataFrame([], PARTS))) == []


def test_ratio_groups():
    assert ratio_groups([]) == []
    got = ratio_groups([(0, 50), (1, 40), (-2, 9), (3454, 5), (3460, 1), (400, 3)])
    assert [n for _, n in got] == [99, 6, 3] and abs(got[0][0] - 1) < 0.005 and abs(got[1][0] - 1000) < 10


def test_estimates_decide_the_unit(spark):
    """Sources whose numbers are in other units than they say, and one with an offset: the unit table stays as it is."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        kg = rng.uniform(1, 9)
        rows.append((i, f"case, {kg * 1000:.1f} oz mass", kg, kg, None, "z"))  # says ounces, means grams
        rows.append((100 + i, f"cable {kg * 100:.2f} in length", None, None, kg, "z"))  # says inches, means centimetres
        rows.append((200 + i, f"drum, {kg / 0.45359237 + 20:.3f} lb mass", kg, kg, None, "z"))  # pounds with 20 pounds of tare
    rows += [(900, "case, 700 oz mass", None, 700.0, None, "z"), (901, "cable 250 in length", None, None, 98.43, "z"), (902, "drum, 42.0462 lb mass", None, 10000.0, None, "z"), (903, "bar 30 cm length", None, None, 0.3, "z")]
    df = spark.createDataFrame(rows, PARTS)
    found = pairwise_scales(linked_measures(df))
    sizes = source_factors(found)
    assert sizes["text:oz"] == (0.001, 0.0) and sizes["text:in"] == (0.01, 0.0) and sizes["text:cm"] == (0.01, 0.0)
    assert abs(sizes["text:lb"][0] - 0.45359237) < 1e-9 and abs(sizes["text:lb"][1] - 20) < 0.5
    got = {r["id"]: r["unit"] for r in recorded_units(df).where("id >= 900").collect()}
    assert got == {900: "g", 901: "in", 902: "g", 903: "m"}


# Heavy keys --------------------------------------------------------------------------------------------------------


def test_heavy_keys_and_profile(spark, many_partitions):
    rng = random.Random(1)
    rows = [(i, 7 if rng.random() < 0.4 else rng.randrange(50), rng.choice([None, *range(100)]), rng.choice([None, 1, 2]), "z") for i in range(3000)]
    rows += [(5000, None, 3, 1, "z")] * 3 + rows[:20]
    df = spark.createDataFrame(rows, "id long, k int, at int, v int, n_rows string").repartition(5)
    counts = Counter(r[1] for r in rows)
    assert {(r["k"], r["n_rows"]) for r in heavy_keys(df, "k", "id", 0.05).collect()} == {(k, n) for k, n in counts.items() if k is not None and n >= 0.05 * len(rows)}
    low = min(r[2] for r in rows if r[1] is not None and r[2] is not None)
    want = {}
    for k in set(counts) - {None}:
        at = sorted(low if r[2] is None else r[2] for r in rows if r[1] == k)
        want[k] = (counts[k], float(sum(r[3] or 0 for r in rows if r[1] == k)), at[0], at[-1], max([b - a for a, b in zip(at, at[1:])], default=0))
    got = {r["k"]: (r["n_rows"], r["total"], r["first_at"], r["last_at"], r["max_step"]) for r in key_profile(df, "k", "at", "id", "v").collect()}
    assert got == want
    assert key_profile(df.limit(0), "k", "at", "id", "v").count() == 0 and heavy_keys(df.limit(0), "k", "id", 0.1).count() == 0


def test_running_by_key(spark, many_partitions):
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", i // 2, None if i % 7 == 0 else i) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, o int, v int").repartition(3)
    got = {r["id"]: (r["seq"], r["running_total"]) for r in running_by_key(df, "k", "o", "id", "v").collect()}
    seen, total = Counter(), Counter()
    for i, k, _, v in rows:
        seen[k] += 1
        total[k] += v or 0
        assert got[i] == (seen[k], float(total[k]))
    assert running_by_key(df.limit(0), "k", "o", "id", "v").count() == 0


def test_hot_key_join(spark):
    left = spark.createDataFrame([(i, 1 if i < 80 else i % 9) for i in range(120)] + [(500, None)], "i long, k long")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(5)], "k long, v string")
    for how in ("left", "inner"):
        want = sorted(map(tuple, left.join(right, "k", how).collect()), key=repr)
        assert sorted(map(tuple, hot_key_join(left, right, "k", how, 0.1, 10).collect()), key=repr) == want


# Intervals ---------------------------------------------------------------------------------------------------------

SPANS = "a int, b int, s date, e date, gap_start string"


def _covered(spans):
    out = set()
    for s, e in spans:
        s, e = -50 if s is None else s, 150 if e is None else e
        out |= set(range(s, e + 1))
    return out


def _runs(days):
    out = []
    for n in sorted(days):
        if out and n == out[-1][1] + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("seed", range(2))
def test_intervals(spark, seed, many_partitions):
    rng = random.Random(seed)
    rows = []
    for _ in range(700):
        a = 1 if rng.random() < 0.5 else rng.randrange(12)
        s = rng.choice([None] + list(range(100)) * 3) if rng.random() < 0.2 else rng.randrange(100)
        e = None if rng.random() < 0.01 else (s or 0) + rng.choice([-3, 0, 0, 1, 2, 5])
        rows.append((a, rng.randrange(4) if a != 1 else 0, s, e))
    rows += rows[:30] + [(None, 1, 3, 4), (2, None, 3, 4)]
    df = spark.createDataFrame([(a, b, day(s), day(e), "x") for a, b, s, e in rows], SPANS).repartition(4)
    spans = defaultdict(list)
    for a, b, s, e in rows:
        if a is not None and b is not None and (s is None or e is None or s <= e):
            spans[a, b].append((s, e))
    gaps, periods = set(), set()
    for (a, b), x in spans.items():
        c = _covered(x)
        gaps |= {(a, b, *r) for r in _runs(set(range(min(c), max(c) + 1)) - c)}
        periods |= {(a, b, None if r[0] == -50 else r[0], None if r[1] == 150 else r[1]) for r in _runs(c)}
    num = lambda d: None if d is None else (d - DAY0).days
    assert {(r["a"], r["b"], num(r["gap_start"]), num(r["gap_end"])) for r in interval_gaps(df, "a", "b", "s", "e").collect()} == gaps
    got = [(r["a"], r["b"], num(r["period_start"]), num(r["period_end"])) for r in interval_periods(df, "a", "b", "s", "e").collect()]
    assert len(got) == len(set(got)) and set(got) == periods
    from relgraph.operators.rangescan import PID, range_sorted

    assert range_sorted(df, "a", "b", "s").select(PID).distinct().count() > 3  # borders are crossed
    assert interval_gaps(df.limit(0), "a", "b", "s", "e").count() == 0 and interval_periods(df.limit(0), "a", "b", "s", "e").count() == 0


# Orphans -----------------------------------------------------------------------------------------------------------


def ts(n):
    return None if n is None else datetime.datetime(2020, 1, 1) + datetime.timedelta(days=n)


def test_orphans(spark):
    parents = [(1, ts(0), None, ts(1)), (1, ts(0), None, ts(1)), (2, ts(0), ts(5), ts(2)), (2, ts(0), None, ts(3)), (3, ts(0), None, ts(2)), (3, ts(0), ts(5), ts(3)), (4, ts(9), None, None), (None, ts(0), None, ts(1))]
    p = spark.createDataFrame(parents, "id long, created_at timestamp, deleted_at timestamp, updated_at timestamp")
    v = valid_versions(p, "id", "updated_at", "deleted_at", "created_at")
    assert {r["key"]: r["deleted"] for r in v.collect()} == {1: False, 2: False, 3: True, 4: False}
    refs = [("t", "f", 10, 1, ts(3)), ("t", "f", 11, 3, ts(3)), ("t", "f", 12, 99, ts(3)), ("t", "f", 13, 4, ts(3)), ("t", "f", 14, 4, None), ("t", "f", 15, None, ts(3)), ("t", "f", 16, 4, ts(40)), ("t", "f", 12, 99, ts(3))]
    r = spark.createDataFrame(refs, "table_name string, field_name string, record_id long, ref long, created timestamp")
    got = orphan_references(r, v)
    assert sorted((x["record_id"], x["reason"]) for x in got.collect()) == [(11, "deleted"), (12, "missing"), (12, "missing"), (13, "late")]
    assert {(x["month"], x["reason"], x["n_records"], x["n_keys"]) for x in orphan_report(got).collect()} == {("2020-01", "deleted", 1, 1), ("2020-01", "missing", 1, 1), ("2020-01", "late", 1, 1)}
    assert {x["reason"] for x in orphan_references(r, v.limit(0)).collect()} == {"missing"}
    assert orphan_references(r.limit(0), v).count() == 0


def test_bloom_filter(spark):
    keys = spark.range(0, 5000).selectExpr("id * 7 as key", "'x' as bits")
    pages = bloom_pages(5000)
    assert pages == 2 and bloom_pages(0) == 1 and bloom_pages(10**8) == 0
    bloom = bloom_filter(keys, "key", pages)
    assert bloom.count() == 2 and {len(r["bits"]) for r in bloom.collect()} == {512}
    probe = spark.range(0, 35_000).selectExpr("id as k", "'y' as bits_of")
    hit = may_contain(probe, probe.k, bloom, pages).toPandas()
    inside = hit["k"] % 7 == 0
    assert hit[inside]["maybe"].all() and hit[~inside]["maybe"].mean() < 0.02
    none = may_contain(probe.limit(5), probe.k, bloom_filter(keys.limit(0), "key", 1), 1)
    assert not any(r["maybe"] for r in none.collect())
    nulls = spark.createDataFrame([(None,)], "k long")
    assert may_contain(nulls, nulls.k, bloom, pages).first()["maybe"]


def test_hot_references_are_joined_where_they_lie(spark):
    refs = spark.range(0, 900).selectExpr("'t' as table_name", "'f' as field_name", "id as record_id", "if(id < 600, 1, id % 90) as ref", "timestamp'2020-01-01' as created")
    known = spark.range(0, 50).selectExpr("id as ref", "true as found")
    plan = hot_key_join(refs, known, "ref", "left", floor=100)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in text and "Union" in text
    assert plan.count() == 900 and plan.where("found").count() == sum(1 for i in range(900) if (1 if i < 600 else i % 90) < 50)


def test_soft_deleted_fixture(spark):
    assert nodes(spark, [1, 2], deleted=(2,)).where("deleted_at is null").count() == 1
