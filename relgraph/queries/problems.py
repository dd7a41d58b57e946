"""Queries p1 to p4 and p6 over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.operators.hierarchy import Hierarchy
from relgraph.operators.intervals import interval_gaps, interval_periods
from relgraph.operators.orphans import orphan_references, orphan_report, valid_versions
from relgraph.operators.units import BASES, UNITS, base_of, factor, linked_measures, noted_unit, pairwise_scales, recorded_units, snapped_unit, source_factors, spelled_unit
from relgraph.operators.skew import heavy_keys, key_profile, running_by_key
from relgraph.sources.tables import table

#: p3: a key is heavy from this share of its table's rows.
HEAVY_SHARE = 0.02

# p1 -----------------------------------------------------------------------------------------------------------------


def _hierarchy(spark: SparkSession, d: str) -> Hierarchy:
    return Hierarchy(table(spark, d, "bill_of_materials").select("parent_part_id", "child_part_id"), "parent_part_id", "child_part_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _hierarchy(spark, d).cycles().select("cycle_id", F.col("node").alias("part_id"))


_P1_SQL = """
WITH RECURSIVE e AS (SELECT DISTINCT CAST(parent_part_id AS BIGINT) AS a, CAST(child_part_id AS BIGINT) AS b FROM bill_of_materials
  WHERE parent_part_id IS NOT NULL AND child_part_id IS NOT NULL),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"""
P1_FOUND_SQL = f"""{_P1_SQL} SELECT min(x.b) AS cycle_id, x.a AS part_id FROM r AS x JOIN r AS y ON x.a = y.b AND x.b = y.a GROUP BY x.a"""


def p1_below(spark: SparkSession, d: str) -> DataFrame:
    return _hierarchy(spark, d).below().select(F.col("node").alias("part_id"), F.col("below").alias("below_id"))


P1_BELOW_SQL = f"{_P1_SQL} SELECT a AS part_id, b AS below_id FROM r"

_P1_PLACES = f"""{_P1_SQL},
g AS (SELECT x.a AS node, min(x.b) AS place FROM r AS x JOIN r AS y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
n AS (SELECT u.node, coalesce(g.place, u.node) AS place FROM (SELECT a AS node FROM e UNION SELECT b FROM e) AS u LEFT JOIN g ON g.node = u.node),
l AS (SELECT DISTINCT n1.place AS a, n2.place AS b FROM e JOIN n AS n1 ON n1.node = e.a JOIN n AS n2 ON n2.node = e.b WHERE n1.place <> n2.place),
t AS (SELECT DISTINCT place FROM n WHERE place NOT IN (SELECT b FROM l))"""


def p1_roots(spark: SparkSession, d: str) -> DataFrame:
    return _hierarchy(spark, d).roots().select(F.col("node").alias("part_id"), F.col("root").alias("root_id"))


P1_ROOTS_SQL = f"""{_P1_PLACES},
w AS (SELECT place AS root, place FROM t UNION SELECT w.root, l.b FROM w JOIN l ON l.a = w.place)
SELECT n.node AS part_id, w.root AS root_id FROM w JOIN n USING (place)"""


def p1_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _hierarchy(spark, d).nodes().select(
        F.col("node").alias("part_id"), "in_cycle", "depth", "max_depth", F.col("n_paths").cast("string").alias("n_paths"), F.col("root").alias("root_id"), F.array_join("path", "/").alias("path")
    )


P1_NODES_SQL = f"""{_P1_PLACES},
w AS (SELECT place, [place] AS path FROM t UNION ALL SELECT l.b, list_append(w.path, l.b) FROM w JOIN l ON l.a = w.place),
m AS (SELECT place, min(len(path)) - 1 AS depth, max(len(path)) - 1 AS max_depth, count(*) AS n_paths, arg_min(path, (len(path), path)) AS path FROM w GROUP BY place)
SELECT n.node AS part_id, n.node IN (SELECT node FROM g) AS in_cycle, CAST(depth AS INTEGER) AS depth, CAST(max_depth AS INTEGER) AS max_depth,
  CAST(n_paths AS VARCHAR) AS n_paths, path[1] AS root_id, array_to_string(path, '/') AS path FROM m JOIN n USING (place)"""


def p1_back_edges(spark: SparkSession, d: str) -> DataFrame:
    return _hierarchy(spark, d).back_edges.select(F.col("src").alias("parent_part_id"), F.col("dst").alias("child_part_id"))


P1_BACK_EDGES_SQL = f"{_P1_SQL} SELECT a AS parent_part_id, b AS child_part_id FROM e WHERE a = b OR a > b AND EXISTS (SELECT 1 FROM r WHERE r.a = e.b AND r.b = e.a)"

# p2 -----------------------------------------------------------------------------------------------------------------

FIELD_OF_BASE = {"kg": "unit_weight_kg", "m": "unit_length_m"}


def _p2_quantities(spark: SparkSession, d: str) -> DataFrame:
    bom = table(spark, d, "bill_of_materials").select("id", "quantity", "unit", "notes")
    return bom.select("id", "quantity", F.coalesce(spelled_unit(F.col("unit")), noted_unit(F.col("notes"))).alias("unit"))


def _p2_measures(spark: SparkSession, d: str) -> DataFrame:
    cols = ["id", "description", "weight_kg", "unit_weight_kg", "unit_length_m"]
    field = F.when(F.col("base") == "kg", FIELD_OF_BASE["kg"]).otherwise(FIELD_OF_BASE["m"])
    return recorded_units(table(spark, d, "parts").select(*cols)).withColumn("field_name", field)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    quantities = _p2_quantities(spark, d).select(F.lit("bill_of_materials").alias("table_name"), F.lit("quantity").alias("field_name"), F.col("id").alias("record_id"), "unit")
    uoms = table(spark, d, "parts").select(F.lit("parts").alias("table_name"), F.lit("base_uom").alias("field_name"), F.col("id").alias("record_id"), spelled_unit(F.col("base_uom")).alias("unit"))
    measures = _p2_measures(spark, d).select(F.lit("parts").alias("table_name"), "field_name", F.col("id").alias("record_id"), "unit")
    rows = quantities.unionByName(uoms).unionByName(measures)
    return rows.where(F.col("unit").isNotNull() & ~F.col("unit").isin(*BASES)).withColumnRenamed("unit", "recorded_unit").distinct()


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value in its base unit, to three decimals; base_unit and value are null where nothing tells the unit."""
    unit = F.col("unit")
    quantities = _p2_quantities(spark, d).select(
        F.lit("bill_of_materials").alias("table_name"), F.lit("quantity").alias("field_name"), F.col("id").alias("record_id"),
        F.col("quantity").cast("double").alias("recorded"), unit, base_of(unit).alias("base_unit"), F.round(F.col("quantity") * factor(unit), 3).alias("value"),
    )
    measures = _p2_measures(spark, d).select(
        F.lit("parts").alias("table_name"), "field_name", F.col("id").alias("record_id"), "recorded", unit, F.when(unit.isNotNull(), F.col("base")).alias("base_unit"), F.round("value", 3).alias("value")
    )
    return quantities.unionByName(measures).distinct()


# The SQL states spellings, sizes and tolerances in its own words, so that it can disagree with the operator.
_SPELT = """each: each ea st pc pcs piece pieces nos no stk|single piece|single pieces; pair: pair pairs pr prs; dozen: dozen dozens doz dz; gross: gross grs gr.144|gross (144);
kg: kg kgs kilo kilos kilogram kilograms kilogramme kilogrammes; g: g gm gms gr gram grams gramme grammes; mg: mg milligram milligrams; t: t to tonne tonnes|metric ton|metric tons;
lb: lb lbs pound pounds; oz: oz ounce ounces; m: m mtr mtrs lfm meter meters metre metres; mm: mm millimeter millimeters millimetre millimetres;
cm: cm cms centimeter centimeters centimetre centimetres; in: in inch inches "; ft: ft foot feet; L: l lt ltr ltrs liter liters litre litres; ml: ml ccm milliliter milliliters millilitre millilitres;
cl: cl centiliter centiliters centilitre centilitres; gal: gal gallon gallons|us gal|us gallon|us gallons; floz: floz|fl oz|fl.oz|fl. oz|fluid ounce|fluid ounces|us fluid ounce|us fluid ounces"""
_WORDS = {u.strip(): [x.strip() for w in rest.split("|")[:1] for x in w.split()] + [w.strip() for w in rest.split("|")[1:]] for u, rest in (part.split(":", 1) for part in _SPELT.split(";"))}


def _unit_case(text: str) -> str:
    """SQL for the unit that a whole text spells, with or without a full stop."""
    low = f"rtrim(lower(trim(regexp_replace({text}, '\\s+', ' ', 'g'))), '.')"
    return "CASE " + " ".join(f"WHEN {low} IN ({', '.join(chr(39) + x + chr(39) for x in words)}) THEN '{u}'" for u, words in _WORDS.items()) + " END"


def _spelt(units: list[str]) -> str:
    every = sorted((x for u in units for x in _WORDS[u]), key=lambda x: -len(x))
    return "((?:" + "|".join(x.replace(".", "[.]").replace("(", "[(]").replace(")", "[)]") for x in every) + ")[.]?)"


_SIZES = {"kg": "WHEN 'kg' THEN 1.0 WHEN 'g' THEN 1e-3 WHEN 'mg' THEN 1e-6 WHEN 't' THEN 1e3 WHEN 'lb' THEN 0.45359237 WHEN 'oz' THEN 0.0283495", "m": "WHEN 'm' THEN 1.0 WHEN 'mm' THEN 1e-3 WHEN 'cm' THEN 1e-2 WHEN 'in' THEN 0.0254 WHEN 'ft' THEN 0.3048"}
_PIECES = "WHEN 'each' THEN 1.0 WHEN 'pair' THEN 2.0 WHEN 'dozen' THEN 12.0 WHEN 'gross' THEN 144.0 WHEN 'L' THEN 1.0 WHEN 'ml' THEN 1e-3 WHEN 'cl' THEN 1e-2 WHEN 'gal' THEN 3.785412 WHEN 'floz' THEN 0.02957353"
# Recorded over true value, from a little below to a little above each conversion.
_RATIOS = {
    "kg": "WHEN ratio BETWEEN 0.88 AND 1.13 THEN 'kg' WHEN ratio BETWEEN 880 AND 1130 THEN 'g' WHEN ratio BETWEEN 8.8e5 AND 1.13e6 THEN 'mg' WHEN ratio BETWEEN 8.8e-4 AND 1.13e-3 THEN 't' WHEN ratio BETWEEN 1.94 AND 2.5 THEN 'lb' WHEN ratio BETWEEN 31 AND 40 THEN 'oz'",
    "m": "WHEN ratio BETWEEN 0.88 AND 1.13 THEN 'm' WHEN ratio BETWEEN 880 AND 1130 THEN 'mm' WHEN ratio BETWEEN 88 AND 113 THEN 'cm' WHEN ratio BETWEEN 34.6 AND 44.5 THEN 'in' WHEN ratio BETWEEN 2.9 AND 3.7 THEN 'ft'",
}
_CUES = r"(?:\buom\s*[=:]|\bunits?\s*[=:]|\bamount\s+as\b|\bqty\s+in\b|\bquantity\s+in\b|\bcounted\s+in\b|\bmeasured\s+in\b|\bquantity\s*:\s*[0-9.,]+|\bneeds\s+[0-9.,]+)\s*"


def _stated(base: str, part: int) -> str:
    units = re.findall("'(\\w+)'", _SIZES[base])
    return f"regexp_extract(lower(description), '(?:^|[^0-9.,])([0-9]+(?:[.,][0-9]+)?)\\s*{_spelt(units)}(?:[^a-z0-9]|$)', {part})"


def _p2_side(base: str, column: str, sure: str) -> str:
    """One row per part: recorded, sure and stated value, and the stated unit's size."""
    return f"""SELECT id, '{base}' AS base, '{column}' AS field_name, CAST({column} AS DOUBLE) AS recorded, CAST({sure} AS DOUBLE) AS sure, stated, stated_unit, CASE stated_unit {_SIZES[base]} END AS size FROM (
  SELECT *, TRY_CAST(replace(number, ',', '.') AS DOUBLE) AS stated, {_unit_case('spelled')} AS stated_unit FROM (SELECT *, {_stated(base, 1)} AS number, {_stated(base, 2)} AS spelled FROM parts))"""


_P2_MEASURES = f"""x AS (SELECT DISTINCT * FROM ({_p2_side('kg', 'unit_weight_kg', 'weight_kg')} UNION ALL {_p2_side('m', 'unit_length_m', 'NULL')})),
y AS (SELECT *, CASE WHEN recorded > 0 THEN recorded / coalesce(CASE WHEN sure > 0 THEN sure END, CASE WHEN stated > 0 THEN stated * size END) END AS ratio FROM x WHERE recorded IS NOT NULL),
z AS (SELECT *, CASE WHEN base = 'kg' THEN CASE {_RATIOS['kg']} END ELSE CASE {_RATIOS['m']} END END AS unit FROM y)"""
_ALL_UNITS = _spelt(list(_WORDS))
_P2_QUANTITIES = f"""q AS (SELECT id, quantity, coalesce({_unit_case('unit')}, {_unit_case('noted')}, {_unit_case('per')}) AS unit FROM (
  SELECT id, quantity, unit, regexp_extract(lower(notes), '{_CUES}{_ALL_UNITS}(?:[^a-z0-9]|$)', 1) AS noted, regexp_extract(lower(notes), '[0-9.,]+\\s*{_ALL_UNITS}\\s+per\\s+assembly', 1) AS per FROM bill_of_materials))"""
P2_FOUND_SQL = f"""WITH {_P2_MEASURES}, {_P2_QUANTITIES} SELECT DISTINCT table_name, field_name, record_id, unit AS recorded_unit FROM (
SELECT 'bill_of_materials' AS table_name, 'quantity' AS field_name, id AS record_id, unit FROM q
UNION ALL SELECT 'parts', 'base_uom', id, {_unit_case('base_uom')} FROM parts
UNION ALL SELECT 'parts', field_name, id, unit FROM z)
WHERE unit IS NOT NULL AND unit NOT IN ('each', 'kg', 'm', 'L')"""
_BASE_CASE = "CASE WHEN unit IN ('each', 'pair', 'dozen', 'gross') THEN 'each' WHEN unit IN ('kg', 'g', 'mg', 't', 'lb', 'oz') THEN 'kg' WHEN unit IN ('m', 'mm', 'cm', 'in', 'ft') THEN 'm' WHEN unit IS NOT NULL THEN 'L' END"
P2_VALUES_SQL = f"""WITH {_P2_MEASURES}, {_P2_QUANTITIES}, v AS (SELECT 'bill_of_materials' AS table_name, 'quantity' AS field_name, id AS record_id, CAST(quantity AS DOUBLE) AS recorded, unit FROM q
UNION ALL SELECT 'parts', field_name, id, recorded, unit FROM z)
SELECT DISTINCT table_name, field_name, record_id, recorded, unit, {_BASE_CASE} AS base_unit, round(recorded * CASE unit {_SIZES['kg']} {_SIZES['m'].replace("WHEN 'm' THEN 1.0", "WHEN 'm' THEN 1.0")} {_PIECES} END, 3) AS value FROM v"""
P2_SCALES_SQL = f"""WITH {_P2_MEASURES}, p AS (
SELECT base, 'sure:' || base AS source_a, 'column:' || base AS source_b, sure AS a, recorded AS b, 1.0 AS size_a FROM x
UNION ALL SELECT base, 'text:' || stated_unit, 'column:' || base, stated, recorded, size FROM x
UNION ALL SELECT base, 'sure:' || base, 'text:' || stated_unit, sure, stated, 1.0 FROM x),
r AS (SELECT *, b / a / size_a AS ratio FROM p WHERE a > 0 AND b > 0),
u AS (SELECT *, CASE WHEN base = 'kg' THEN CASE {_RATIOS['kg']} END ELSE CASE {_RATIOS['m']} END END AS unit FROM r)
SELECT base, source_a, source_b, unit, count(*) AS n, round(median(ratio * CASE unit {_SIZES['kg']} {_SIZES['m']} END), 1) AS off, CAST(0 AS DOUBLE) AS "offset" FROM u WHERE unit IS NOT NULL GROUP BY ALL"""


def p2_scales(spark: SparkSession, d: str) -> DataFrame:
    """The groups of scales between every two sources of a measure: records, how far off the known conversion (1: none), offset.

    The unit is that of source_b for source_a in its base unit, as the graph of sources has it.
    """
    found = pairwise_scales(linked_measures(table(spark, d, "parts")))
    size = source_factors(found)
    rows = []
    for x in found:
        for scale, n in x.groups:
            unit = snapped_unit(scale / size[x.source_a][0], x.base)
            if unit:
                rows.append((x.base, x.source_a, x.source_b, unit, n, round(scale / size[x.source_a][0] * UNITS[unit][1], 1), round(x.offset, 6)))
    return spark.createDataFrame(rows, "base string, source_a string, source_b string, unit string, n long, off double, offset double")


# p3 -----------------------------------------------------------------------------------------------------------------

KEYED = (("supplier_relationships", "buyer_id"), ("bill_of_materials", "child_part_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        heavy_keys(table(spark, d, t), k, "id", HEAVY_SHARE).select(
            F.lit(t).alias("table_name"), F.lit(k).alias("field_name"), F.col(k).cast("long").alias("key_id")
        )
        for t, k in KEYED
    ]
    return parts[0].unionByName(parts[1])


P3_FOUND_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{k}' AS field_name, CAST({k} AS BIGINT) AS key_id FROM {t} WHERE {k} IS NOT NULL "
    f"GROUP BY {k} HAVING count(*) >= {HEAVY_SHARE} * (SELECT count(*) FROM {t})"
    for t, k in KEYED
)


def p3_buyers(spark: SparkSession, d: str) -> DataFrame:
    out = key_profile(table(spark, d, "supplier_relationships"), "buyer_id", "contract_start_date", "id")
    return out.select(F.col("buyer_id").cast("long").alias("buyer_id"), "n_rows", F.col("first_at").alias("first_day"), F.col("last_at").alias("last_day"), F.col("max_step").alias("longest_wait"))


P3_BUYERS_SQL = """
WITH r AS (SELECT CAST(buyer_id AS BIGINT) AS buyer_id,
             datediff('day', DATE '1970-01-01', coalesce(contract_start_date, (SELECT min(contract_start_date) FROM supplier_relationships WHERE buyer_id IS NOT NULL))) AS day
           FROM supplier_relationships WHERE buyer_id IS NOT NULL),
s AS (SELECT buyer_id, day, day - lag(day) OVER (PARTITION BY buyer_id ORDER BY day) AS step FROM r)
SELECT buyer_id, count(*) AS n_rows, min(day) AS first_day, max(day) AS last_day, coalesce(max(step), 0) AS longest_wait
FROM s GROUP BY buyer_id"""


def p3_children(spark: SparkSession, d: str) -> DataFrame:
    out = key_profile(table(spark, d, "bill_of_materials"), "child_part_id", "created_at", "id", "quantity")
    return out.select(F.col("child_part_id").cast("long").alias("child_part_id"), "n_rows", F.col("total").cast("long").alias("total_quantity"), F.col("max_step").alias("longest_pause_s"))


P3_CHILDREN_SQL = """
WITH r AS (SELECT CAST(child_part_id AS BIGINT) AS child_part_id, quantity,
             CAST(floor(epoch(coalesce(created_at, (SELECT min(created_at) FROM bill_of_materials WHERE child_part_id IS NOT NULL)))) AS BIGINT) AS tick
           FROM bill_of_materials WHERE child_part_id IS NOT NULL),
s AS (SELECT child_part_id, quantity, tick - lag(tick) OVER (PARTITION BY child_part_id ORDER BY tick) AS step FROM r)
SELECT child_part_id, count(*) AS n_rows, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS total_quantity, coalesce(max(step), 0) AS longest_pause_s
FROM s GROUP BY child_part_id"""


def p3_running(spark: SparkSession, d: str) -> DataFrame:
    bom = table(spark, d, "bill_of_materials").select("id", "child_part_id", "quantity").distinct()
    out = running_by_key(bom, "child_part_id", "id", "id", "quantity")
    return out.select(F.col("child_part_id").cast("long").alias("child_part_id"), "id", "seq", F.col("running_total").cast("long").alias("running_quantity"))


P3_RUNNING_SQL = """
WITH b AS (SELECT DISTINCT id, child_part_id, quantity FROM bill_of_materials WHERE child_part_id IS NOT NULL)
SELECT CAST(child_part_id AS BIGINT) AS child_part_id, id, row_number() OVER w AS seq, CAST(sum(coalesce(quantity, 0)) OVER w AS BIGINT) AS running_quantity
FROM b WINDOW w AS (PARTITION BY child_part_id ORDER BY id ROWS UNBOUNDED PRECEDING)"""

# p4 -----------------------------------------------------------------------------------------------------------------

PERIODS = (
    ("supplier_relationships", "seller_id", "buyer_id", "contract_start_date", "contract_end_date"),
    ("bill_of_materials", "parent_part_id", "child_part_id", "effective_from", "effective_to"),
)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        interval_gaps(table(spark, d, t), a, b, s, e).select(
            F.lit(t).alias("table_name"),
            F.col(a).alias("from_id"),
            F.col(b).alias("to_id"),
            F.date_format("gap_start", "yyyy-MM-dd").alias("gap_start"),
            F.date_format("gap_end", "yyyy-MM-dd").alias("gap_end"),
        )
        for t, a, b, s, e in PERIODS
    ]
    return parts[0].unionByName(parts[1])


def p4_periods(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        interval_periods(table(spark, d, t), a, b, s, e).select(
            F.lit(t).alias("table_name"),
            F.col(a).alias("from_id"),
            F.col(b).alias("to_id"),
            F.date_format("period_start", "yyyy-MM-dd").alias("period_start"),
            F.date_format("period_end", "yyyy-MM-dd").alias("period_end"),
        )
        for t, a, b, s, e in PERIODS
    ]
    return parts[0].unionByName(parts[1])


def _islands_sql(t: str, a: str, b: str, s: str, e: str) -> str:
    return f"""
SELECT '{t}' AS t, CAST({a} AS BIGINT) AS a, CAST({b} AS BIGINT) AS b, coalesce(datediff('day', DATE '1970-01-01', {s}), -1073741824) AS s,
  coalesce(datediff('day', DATE '1970-01-01', {e}), 1073741824) AS e FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"""


_P4_SCAN = f"""
WITH r AS ({' UNION ALL '.join(_islands_sql(*p) for p in PERIODS)}),
g AS (SELECT *, max(e) OVER (PARTITION BY t, a, b ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r WHERE s <= e)"""
P4_FOUND_SQL = f"""{_P4_SCAN}
SELECT DISTINCT t AS table_name, a AS from_id, b AS to_id, strftime(DATE '1970-01-01' + CAST(before + 1 AS INTEGER), '%Y-%m-%d') AS gap_start,
  strftime(DATE '1970-01-01' + CAST(s - 1 AS INTEGER), '%Y-%m-%d') AS gap_end FROM g WHERE s > before + 1"""
P4_PERIODS_SQL = f"""{_P4_SCAN},
i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY t, a, b ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT t AS table_name, a AS from_id, b AS to_id,
  CASE WHEN min(s) > -1073741824 THEN strftime(DATE '1970-01-01' + CAST(min(s) AS INTEGER), '%Y-%m-%d') END AS period_start,
  CASE WHEN max(e) < 1073741824 THEN strftime(DATE '1970-01-01' + CAST(max(e) AS INTEGER), '%Y-%m-%d') END AS period_end
FROM i GROUP BY t, a, b, k"""

# p6 -----------------------------------------------------------------------------------------------------------------

REFERENCES = (("parts", "primary_supplier_id"), ("supplier_relationships", "seller_id"), ("supplier_relationships", "buyer_id"))


def _p6_orphans(spark: SparkSession, d: str) -> DataFrame:
    parents = valid_versions(table(spark, d, "suppliers"), "id", "updated_at", "deleted_at", "created_at")
    parts = table(spark, d, "parts").select("id", "created_at", F.array(F.struct(F.lit("primary_supplier_id").alias("f"), F.col("primary_supplier_id").alias("r"))).alias("refs"), F.lit("parts").alias("t"))
    rels = table(spark, d, "supplier_relationships").select(
        "id", "created_at", F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("r")) for f in ("seller_id", "buyer_id")]).alias("refs"), F.lit("supplier_relationships").alias("t")
    )
    refs = parts.unionByName(rels).select("id", "created_at", "t", F.inline("refs").alias("field_name", "ref"))
    refs = refs.select(F.col("t").alias("table_name"), "field_name", F.col("id").alias("record_id"), F.col("ref").cast("long").alias("ref"), F.col("created_at").alias("created"))
    return orphan_references(refs, parents)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _p6_orphans(spark, d).select("table_name", "field_name", "record_id", "reason").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_p6_orphans(spark, d))


_P6_SQL = f"""
WITH v AS (SELECT id, deleted_at IS NOT NULL AS deleted, created_at AS born FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, deleted_at IS NOT NULL DESC, created_at DESC NULLS LAST) AS rn FROM suppliers WHERE id IS NOT NULL) WHERE rn = 1),
r AS ({' UNION ALL '.join(f"SELECT '{t}' AS table_name, '{f}' AS field_name, id AS record_id, {f} AS ref, created_at AS created FROM {t}" for t, f in REFERENCES)}),
j AS (SELECT r.*, CASE WHEN v.id IS NULL THEN 'missing' WHEN v.deleted THEN 'deleted' WHEN v.born > r.created THEN 'late' END AS reason
  FROM r LEFT JOIN v ON r.ref = v.id WHERE r.ref IS NOT NULL)"""
P6_FOUND_SQL = f"{_P6_SQL} SELECT DISTINCT table_name, field_name, record_id, reason FROM j WHERE reason IS NOT NULL"
P6_REPORT_SQL = f"""{_P6_SQL} SELECT table_name, field_name, strftime(created, '%Y-%m') AS month, reason,
  count(DISTINCT record_id) AS n_records, count(DISTINCT ref) AS n_keys FROM j WHERE reason IS NOT NULL GROUP BY 1, 2, 3, 4"""


QUERIES = {
    "p1_found": p1_found,
    "p1_nodes": p1_nodes,
    "p1_roots": p1_roots,
    "p1_below": p1_below,
    "p1_back_edges": p1_back_edges,
    "p2_found": p2_found,
    "p2_values": p2_values,
    "p2_scales": p2_scales,
    "p3_found": p3_found,
    "p3_buyers": p3_buyers,
    "p3_children": p3_children,
    "p3_running": p3_running,
    "p4_found": p4_found,
    "p4_periods": p4_periods,
    "p6_found": p6_found,
    "p6_report": p6_report,
}
ORACLE = {
    "p2_found": P2_FOUND_SQL,
    "p2_values": P2_VALUES_SQL,
    "p2_scales": P2_SCALES_SQL,
    "p1_found": P1_FOUND_SQL,
    "p1_nodes": P1_NODES_SQL,
    "p1_roots": P1_ROOTS_SQL,
    "p1_below": P1_BELOW_SQL,
    "p1_back_edges": P1_BACK_EDGES_SQL,
    "p3_found": P3_FOUND_SQL,
    "p3_buyers": P3_BUYERS_SQL,
    "p3_children": P3_CHILDREN_SQL,
    "p3_running": P3_RUNNING_SQL,
    "p4_found": P4_FOUND_SQL,
    "p4_periods": P4_PERIODS_SQL,
    "p6_found": P6_FOUND_SQL,
    "p6_report": P6_REPORT_SQL,
}
