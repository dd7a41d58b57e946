"""Quantities recorded in different units: find the unit of every value and convert it to each, kg, m or L."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgraph.sources.scratch import materialize

# Unit -> (base unit, size of one unit in the base unit, spellings in lower case).
UNITS: dict[str, tuple[str, float, tuple[str, ...]]] = {
    "each": ("each", 1.0, ("each", "ea", "st", "pc", "pcs", "piece", "pieces", "nos", "no", "stk", "single piece", "single pieces")),
    "pair": ("each", 2.0, ("pair", "pairs", "pr", "prs")),
    "dozen": ("each", 12.0, ("dozen", "dozens", "doz", "doz.", "dz", "dz.")),
    "gross": ("each", 144.0, ("gross", "grs", "grs.", "gr.144", "gross (144)")),
    "kg": ("kg", 1.0, ("kg", "kgs", "kilo", "kilos", "kilogram", "kilograms", "kilogramme", "kilogrammes")),
    "g": ("kg", 0.001, ("g", "gm", "gms", "gr", "gram", "grams", "gramme", "grammes")),
    "mg": ("kg", 0.000001, ("mg", "milligram", "milligrams")),
    "t": ("kg", 1000.0, ("t", "to", "tonne", "tonnes", "metric ton", "metric tons")),
    "lb": ("kg", 0.45359237, ("lb", "lb.", "lbs", "lbs.", "pound", "pounds")),
    "oz": ("kg", 0.028349523125, ("oz", "oz.", "ounce", "ounces")),
    "m": ("m", 1.0, ("m", "mtr", "mtrs", "lfm", "meter", "meters", "metre", "metres")),
    "mm": ("m", 0.001, ("mm", "mm.", "millimeter", "millimeters", "millimetre", "millimetres")),
    "cm": ("m", 0.01, ("cm", "cms", "cm.", "centimeter", "centimeters", "centimetre", "centimetres")),
    "in": ("m", 0.0254, ("in", "in.", "inch", "inches", '"')),
    "ft": ("m", 0.3048, ("ft", "ft.", "foot", "feet")),
    "L": ("L", 1.0, ("l", "lt", "ltr", "ltrs", "liter", "liters", "litre", "litres")),
    "ml": ("L", 0.001, ("ml", "ccm", "milliliter", "milliliters", "millilitre", "millilitres")),
    "cl": ("L", 0.01, ("cl", "centiliter", "centiliters", "centilitre", "centilitres")),
    "gal": ("L", 3.785411784, ("gal", "gal.", "us gal", "gallon", "gallons", "us gallon", "us gallons")),
    "floz": ("L", 0.0295735295625, ("floz", "fl oz", "fl.oz.", "fl. oz.", "us fluid ounce", "us fluid ounces", "fluid ounce", "fluid ounces")),
}
BASES = ("each", "kg", "m", "L")
#: A scale is a known conversion if it is within the factor SNAP of it; a record belongs to a scale within the factor NEAR.
SNAP, NEAR = 1.1, 1.15
#: Ratios are counted in bins of so much of their logarithm, from -WIDEST to WIDEST; a group reaches this factor either way.
BIN, WIDEST, GROUP = 0.002, 40.0, 1.35
#: A link between sources counts from so many records on, its offset from so many and above this share of the values.
LEAST_RECORDS, OFFSET_RECORDS, OFFSET = 5, 20, 0.1
_SPELLED = {s: u for u, (_, _, spellings) in UNITS.items() for s in spellings}


def _pattern(units: list[str]) -> str:
    """Alternation of all spellings of the units, longest first, as a Java pattern."""
    spelled = sorted((s for s, u in _SPELLED.items() if u in units), key=lambda s: (-len(s), s))
    return "(" + "|".join(s.replace(".", r"\.").replace("(", r"\(").replace(")", r"\)") for s in spelled) + ")(?![a-z0-9])"


_ANY = _pattern(list(UNITS))
#: What introduces the unit of a quantity in a note. A measure without such words (a label, a torque) is no quantity.
_NOTE_CUES = (
    rf"(?:\buom\s*[=:]|\bunits?\s*[=:]|\bamount\s+as\b|\bqty\s+in\b|\bquantity\s+in\b|\bcounted\s+in\b|\bmeasured\s+in\b|\bquantity\s*:\s*[0-9.,]+|\bneeds\s+[0-9.,]+)\s*{_ANY}",
    rf"\b[0-9.,]+\s*{_ANY}\s+per\s+assembly",
)


def spelled_unit(text: Column) -> Column:
    """The unit that a whole text spells, in any case and with blanks around it; null for null and unknown texts."""
    names = F.create_map(*[F.lit(x) for pair in _SPELLED.items() for x in pair])
    return F.try_element_at(names, F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))))


def noted_unit(text: Column) -> Column:
    """The unit that a free text gives for its record's quantity; null if it gives none."""
    low = F.lower(text)
    found = F.coalesce(*[F.nullif(F.regexp_extract(low, cue, 1), F.lit("")) for cue in _NOTE_CUES])
    return spelled_unit(found)


def stated_measure(text: Column, base: str) -> tuple[Column, Column]:
    """(number, unit) of the first measure in a text whose unit has the base; nulls if there is none.

    A comma between digits is a decimal comma. Numbers without such a unit, as in type names, are passed over.
    """
    pattern = r"(?<![0-9.,])([0-9]+(?:[.,][0-9]+)?)\s*" + _pattern([u for u, (b, _, _) in UNITS.items() if b == base])
    low = F.lower(text)
    number = F.regexp_replace(F.regexp_extract(low, pattern, 1), ",", ".")
    return number.try_cast("double"), spelled_unit(F.nullif(F.regexp_extract(low, pattern, 2), F.lit("")))


def factor(unit: Column) -> Column:
    """Size of a unit in its base unit."""
    return F.try_element_at(F.create_map(*[F.lit(x) for u, (_, f, _) in UNITS.items() for x in (u, f)]), unit)


def base_of(unit: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for u, (b, _, _) in UNITS.items() for x in (u, b)]), unit)


def snapped_unit(ratio: float, base: str) -> str | None:
    """The unit in which a value is recorded that is ``ratio`` times its true value in the base unit.

    The nearest known conversion within the factor SNAP; None if none is that near, or without a positive ratio.
    """
    if not ratio > 0:
        return None
    off, unit = min((abs(math.log(ratio * f)), u) for u, (b, f, _) in UNITS.items() if b == base)
    return unit if off <= math.log(SNAP) else None


def linked_measures(parts: DataFrame) -> DataFrame:
    """The statements of one part about its mass and its length, side by side.

    Columns: id, base, recorded (what the column says), stated and stated_unit (from the description), sure (another
    column that is always in the base unit; null for lengths).
    """
    text = F.col("description")
    rows = []
    for base, recorded, sure in (("kg", "unit_weight_kg", F.col("weight_kg").cast("double")), ("m", "unit_length_m", F.lit(None).cast("double"))):
        number, unit = stated_measure(text, base)
        rows.append(F.struct(F.lit(base).alias("base"), F.col(recorded).cast("double").alias("recorded"), number.alias("stated"), unit.alias("stated_unit"), sure.alias("sure")))
    return parts.select("id", F.inline(F.array(*rows)).alias("base", "recorded", "stated", "stated_unit", "sure")).distinct()


def _link_rows(links: DataFrame) -> DataFrame:
    """base, source_a, source_b, a, b: two statements of one record side by side, for every two sources."""
    column, sure = F.concat(F.lit("column:"), F.col("base")), F.concat(F.lit("sure:"), F.col("base"))
    text = F.concat(F.lit("text:"), F.col("stated_unit"))

    def pair(a: Column, b: Column, va: str, vb: str) -> Column:
        return F.struct(a.alias("source_a"), b.alias("source_b"), F.col(va).alias("a"), F.col(vb).alias("b"))

    pairs = F.array(pair(sure, column, "sure", "recorded"), pair(text, column, "stated", "recorded"), pair(sure, text, "sure", "stated"))
    return links.select("base", F.inline(pairs).alias("source_a", "source_b", "a", "b")).where((F.col("a") > 0) & (F.col("b") > 0))


def _bin(ratio: Column) -> Column:
    return F.round(F.greatest(F.lit(-WIDEST), F.least(F.lit(WIDEST), F.log(ratio))) / BIN).cast("int")


def ratio_groups(bins: list[tuple[int, int]]) -> list[tuple[float, int]]:
    """(scale, n) of the groups into which ratios fall, largest first; bins: (bin of the logarithm, rows).

    The fullest place, smoothed over neighbouring bins, gathers all ratios within the factor GROUP; the rest goes round
    again. The scale of a group is its median, so single wrong values do not move it.
    """
    left, out = dict(bins), []
    near, half = round(0.02 / BIN), math.log(GROUP) / BIN
    full = {k: sum(left.get(k + d, 0) for d in range(-near, near + 1)) for k in left}
    for top in sorted(full, key=lambda k: (-full[k], abs(k), k)):
        if top not in left:
            continue
        inside = sorted(k for k in left if abs(k - top) <= half)
        n = sum(left[k] for k in inside)
        seen = 0
        for k in inside:
            seen += left[k]
            if 2 * seen >= n:
                out.append((math.exp(k * BIN), n))
                break
        for k in inside:
            del left[k]
    return sorted(out, key=lambda g: (-g[1], g[0]))


@dataclass(frozen=True)
class Link:
    """b = scale * a + offset between two sources, from n records; offset is 0 unless it matters. groups: see ratio_groups."""

    base: str
    source_a: str
    source_b: str
    n: int
    scale: float
    offset: float
    groups: tuple[tuple[float, int], ...]


def pairwise_scales(links: DataFrame) -> list[Link]:
    """Robust scale and offset between every two sources of a measure, from all records that both state.

    A source is a column or the descriptions in one spelled unit. Ratios are counted in bins of their logarithm, at most
    2 * WIDEST / BIN for each pair of sources, of which there are as many as units; the scale is the median of the largest
    group. The offset is that of the resistant line through the medians of the lower and the upper third of the values;
    it counts from OFFSET_RECORDS records on and if it is more than the share OFFSET of the middle value, and then the
    scale is the slope of that line. Mixed columns are tested for an offset within their largest group only.
    """
    rows = _link_rows(links)
    keys = ["base", "source_a", "source_b"]
    counted = rows.groupBy(*keys, _bin(F.col("b") / F.col("a")).alias("bin")).count().collect()
    per: dict[tuple, list] = {}
    for r in counted:
        per.setdefault((r["base"], r["source_a"], r["source_b"]), []).append((r["bin"], r["count"]))
    groups = {k: ratio_groups(v) for k, v in per.items()}
    if not groups:
        return []
    # One row a pair of sources is broadcast.
    spark = links.sparkSession
    main = F.broadcast(spark.createDataFrame([(*k, g[0][0]) for k, g in groups.items()], "base string, source_a string, source_b string, main double"))
    alike = F.col("source_b").startswith("text:") | (F.abs(F.log(F.col("b") / F.col("a") / F.col("main"))) <= math.log(GROUP))
    in_line = rows.join(main, keys).where(alike)
    thirds = F.broadcast(in_line.groupBy(*keys).agg(F.percentile_approx("a", F.array(F.lit(1 / 3), F.lit(2 / 3)), 1000).alias("t"), F.count(F.lit(1)).alias("of")))
    low, high = F.col("a") <= F.col("t")[0], F.col("a") >= F.col("t")[1]

    def median(column: str, where: Column, name: str) -> Column:
        return F.percentile_approx(F.when(where, F.col(column)), 0.5, 1000).alias(name)

    lines = in_line.join(thirds, keys).groupBy(*keys, "of").agg(
        median("a", low, "a0"), median("b", low, "b0"), median("a", high, "a1"), median("b", high, "b1"), F.percentile_approx("b", 0.5, 1000).alias("middle")
    )
    out = []
    for r in lines.collect():
        key = (r["base"], r["source_a"], r["source_b"])
        g = groups[key]
        scale, offset = g[0][0], 0.0
        if r["of"] >= OFFSET_RECORDS and r["a1"] > r["a0"]:
            slope = (r["b1"] - r["b0"]) / (r["a1"] - r["a0"])
            base_line = (r["b0"] + r["b1"] - slope * (r["a0"] + r["a1"])) / 2
            if slope > 0 and abs(base_line) > OFFSET * r["middle"]:
                scale, offset = slope, base_line
        out.append(Link(*key, sum(n for _, n in g), scale, offset, tuple(g)))
    return sorted(out, key=lambda x: (x.base, x.source_a, x.source_b))


def source_factors(found: list[Link]) -> dict[str, tuple[float, float]]:
    """(factor, offset) by source: true value in the base unit = factor * (stated value - offset).

    Walks the graph of sources from those that are sure, the link with most records first. Where no column is sure, the
    anchor is the unit that the column itself is meant for, as most of its records have it. Each factor is the product of
    the estimated scales on the way, snapped to a known conversion if one is near. Sources that no link of LEAST_RECORDS
    records reaches keep what their own unit says.
    """
    known: dict[str, tuple[float, float]] = {}
    for base in dict.fromkeys(x.base for x in found):
        mine = [x for x in found if x.base == base and x.n >= LEAST_RECORDS]
        sure = f"sure:{base}"
        known[sure if any(x.source_a == sure for x in found) else f"column:{base}"] = (1.0, 0.0)
        grown = True
        while grown:
            grown = False
            for x in sorted(mine, key=lambda x: (-x.n, x.source_a, x.source_b)):
                a, b = known.get(x.source_a), known.get(x.source_b)
                if (a is None) == (b is None):
                    continue
                # The two sources agree where a's true value is that of b = scale * a + offset.
                size = a[0] / x.scale if b is None else b[0] * x.scale
                unit = snapped_unit(1 / size, base)
                size = UNITS[unit][1] if unit else size
                if b is None:
                    known[x.source_b] = (size, x.offset)
                else:
                    known[x.source_a] = (size, -x.offset / x.scale)
                grown = True
                break
    for u, (_, f, _) in UNITS.items():
        known.setdefault(f"text:{u}", (f, 0.0))
    return known


def recorded_units(parts: DataFrame) -> DataFrame:
    """The unit in which each part's mass and length is recorded: id, base, recorded, unit, value (in the base unit).

    What the part's other statements say of the same measure gives the true value: first the sure column, then the
    description, whose factor and offset come from the graph of sources. The ratios of recorded to true values of all
    records fall into groups; each group's median is snapped to a known conversion, and a record has the unit of the
    group whose scale is next to its own ratio, within the factor NEAR. Without another statement, or if no group fits,
    unit and value are null.
    Repeated rows come out once. Nulls, zeros and negative numbers state nothing. An empty table gives no rows.
    """
    links = materialize(linked_measures(parts)).df
    sizes = source_factors(pairwise_scales(links))

    def of_text(at: int) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for k, v in sizes.items() if k.startswith("text:") for x in (k[5:], v[at])]), F.col("stated_unit"))

    stated = of_text(0) * (F.col("stated") - of_text(1))
    true = F.coalesce(F.when(F.col("sure") > 0, F.col("sure")), F.when((F.col("stated") > 0) & (stated > 0), stated))
    judged = links.where(F.col("recorded").isNotNull()).withColumn("ratio", F.when(F.col("recorded") > 0, F.col("recorded") / true))
    per: dict[str, list] = {}
    for r in judged.where(F.col("ratio") > 0).groupBy("base", _bin(F.col("ratio")).alias("bin")).count().collect():
        per.setdefault(r["base"], []).append((r["bin"], r["count"]))
    scales = [(base, math.log(scale), unit) for base, bins in per.items() for scale, _ in ratio_groups(bins) if (unit := snapped_unit(scale, base))]
    unit = F.lit(None).cast("string")
    if scales:
        nearest = F.array_min(F.array(*[F.when(F.col("base") == b, F.struct(F.abs(F.log("ratio") - F.lit(s)).alias("off"), F.lit(u).alias("unit"))) for b, s, u in scales]))
        unit = F.when(nearest["off"] <= math.log(NEAR), nearest["unit"])
    out = judged.withColumn("unit", unit)
    return out.select("id", "base", "recorded", "unit", (F.col("recorded") * factor(F.col("unit"))).alias("value"))
