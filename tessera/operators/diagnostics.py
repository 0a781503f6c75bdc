"""Sizes of objects as a report: one unit for all tables, percentiles, suggestions beside current settings, and histograms.

Everything is per dataset and for all files together (``EVERY``).  Tables come as a mapping of ``nuclei``, ``cells`` and ``raw`` to rows of objects.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import sizes
from tessera.operators import summary
from tessera.operators.prefix import quantiles
from tessera.session import look_up

EVERY = "ALL FILES"
# Names of the tables in the report, and the measures of each.
NAMES = {"nuclei": "nuclei", "cells": "cells", "raw": "raw objects (before size filter)"}
MEASURES = {
    "nuclei": ["area_px", "equivalent_diameter_px", "major_axis_px", "minor_axis_px", "nearest_neighbour_px"],
    "cells": ["area_px", "equivalent_diameter_px", "major_axis_px", "minor_axis_px"],
    "raw": ["area_px"],
}
EXTRA = {"nuclei": ["eccentricity"], "cells": ["eccentricity", "n_nuclei"], "raw": []}
#: Suggested setting: its name in the report, whether it is an area, and the setting it stands for.
SUGGESTED = {
    "min_nucleus_size": ("Min. nucleus size", True, "min_nucleus_size"),
    "min_distance": ("Min. distance between nucleus seeds", False, "min_distance"),
    "min_label_size": ("Min. cell size", True, "min_label_size"),
}
TYPICAL = {
    "typical_nucleus_diameter": ("Typical nucleus diameter (µm)", "typical_nucleus_diameter_um"),
    "typical_cell_area": ("Typical cell area (µm²)", "typical_cell_area_um2"),
}
#: Settings drawn into the histograms of a measure.
MARKS = {("nuclei", "area"): ["min_nucleus_size"], ("raw", "area"): ["min_nucleus_size"], ("nuclei", "nearest_neighbour"): ["min_distance"], ("cells", "area"): ["min_label_size", "max_cell_area"]}


def metric(name: str) -> str:
    """The column of a pixel measure in micrometres."""
    return "area_um2" if name == "area_px" else name[:-3] + "_um"


def _scopes(df: DataFrame) -> DataFrame:
    """Every row once for its dataset and once for all files."""
    return df.withColumn("dataset", F.explode(F.array(F.col("dataset"), F.lit(EVERY))))


def units(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(dataset, um, pixel_size_um, mixed, length_unit, area_unit): micrometres where every object of every table has a pixel size.

    The pixel size is the median over objects; ``mixed`` says that micrometres were needed because objects have several.
    """
    parts = [_scopes(df.select("dataset", F.col("pixel_size_um").cast("double").alias("value"))) for df in tables.values() if "pixel_size_um" in df.columns]
    if not parts:
        return _nothing(tables)
    every = reduce(DataFrame.unionByName, parts)
    # a few different sizes per dataset: they are counted, not gathered
    counts = every.groupBy("dataset", "value").agg(F.count(F.lit(1)).alias("n"))
    facts = counts.groupBy("dataset").agg(F.bool_and(F.col("value").isNotNull()).alias("um"), F.count_distinct("value").alias("__k"))
    middle = quantiles(every, ["dataset"], "value", {"pixel_size_um": 0.5})
    out = facts.join(middle, "dataset", "left").withColumn("mixed", F.col("um") & (F.col("__k") > 1))
    named = {"length_unit": F.when(F.col("um"), "µm").otherwise("px"), "area_unit": F.when(F.col("um"), "µm²").otherwise("px")}
    return out.select("dataset", "um", "pixel_size_um", "mixed", *[c.alias(n) for n, c in named.items()])


def _nothing(tables: Mapping[str, DataFrame]) -> DataFrame:
    every = reduce(DataFrame.union, [_scopes(df.select("dataset")) for df in tables.values()]).distinct()
    return every.select("dataset", F.lit(False).alias("um"), F.lit(None).cast("double").alias("pixel_size_um"), F.lit(False).alias("mixed"), F.lit("px").alias("length_unit"), F.lit("px").alias("area_unit"))


def in_unit(df: DataFrame, measures: list[str], chosen: DataFrame) -> DataFrame:
    """(dataset, measure, value): measures of both scopes in the scope's unit, named by what they measure (area, equivalent_diameter, ...)."""
    um = look_up(_scopes(df), chosen.select("dataset", "um"), ["dataset"])
    known = [m for m in measures if m in df.columns]
    values = {m.removesuffix("_px"): F.when(F.col("um"), F.col(metric(m))).otherwise(F.col(m)) if m.endswith("_px") and metric(m) in df.columns else F.col(m) for m in known}
    wide = um.select("dataset", *[v.cast("double").alias(n) for n, v in values.items()])
    return summary.long_values(wide, ["dataset"], list(values)).withColumnRenamed("column", "measure")


def multinucleated(cells: DataFrame) -> DataFrame:
    """(dataset, n, fraction): share of cells with more than one nucleus, where nuclei were counted at all."""
    many = F.avg(F.coalesce((F.col("n_nuclei") > 1).cast("double"), F.lit(0.0)))
    counted = _scopes(cells).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), many.alias("fraction"), F.count("n_nuclei").alias("__k"))
    return counted.where("__k > 0").select("dataset", "n", "fraction")


def current(settings: Mapping[str, Any], chosen: DataFrame) -> DataFrame:
    """(dataset, setting, value): the size settings in the unit of each scope; NULL where a pixel size would be needed."""
    px = sizes.size_columns(settings, F.col("pixel_size_um"))
    ps = F.col("pixel_size_um")

    def value(name: str) -> Column:
        power, _, automatic = sizes.SIZES[name]
        v = px[name].cast("double")
        return F.when(F.col("um"), v * (ps * ps if power == 2 else ps)).otherwise(v)

    names = ("min_nucleus_size", "min_distance", "min_label_size", "max_cell_area")
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("setting"), value(n).alias("value")) for n in names]))
    return chosen.select("dataset", pairs.alias("s")).select("dataset", "s.setting", "s.value")


def suggested(tables: Mapping[str, DataFrame], chosen: DataFrame) -> DataFrame:
    """(dataset, setting, value) of the suggested starting values, from medians in the unit of each scope."""
    wanted = {"nuclei": ["area_px", "equivalent_diameter_px"], "cells": ["area_px"]}
    out = chosen
    for name, measures in wanted.items():
        if name not in tables:
            out = out.withColumns({f"{name}_{m.removesuffix('_px')}": F.lit(None).cast("double") for m in measures})
            continue
        medians = quantiles(in_unit(tables[name], measures, chosen), ["dataset", "measure"], "value", {"median": 0.5})
        for m in measures:
            one = m.removesuffix("_px")
            out = out.join(medians.where(F.col("measure") == one).select("dataset", F.col("median").alias(f"{name}_{one}")), "dataset", "left")
    values = summary.suggestions(F.col("nuclei_area"), F.col("nuclei_equivalent_diameter"), F.col("cells_area"), F.col("um"))
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("setting"), v.cast("double").alias("value")) for n, v in values.items()]))
    return out.select("dataset", "um", "length_unit", "area_unit", pairs.alias("s")).select("dataset", "um", "length_unit", "area_unit", "s.setting", "s.value").where("value is not null")


def report(tables: Mapping[str, DataFrame], settings: Mapping[str, Any]) -> DataFrame:
    """(dataset, object, measure, n, median, p5, p25, p75, p95, mean, current_setting): all sizes, suggestions and the multi-nucleated share."""
    tables = {n: df for n, df in tables.items() if df is not None}
    chosen = units(tables)
    found = {}
    for name, df in tables.items():
        measures = [*MEASURES[name], *map(metric, MEASURES[name]), *EXTRA[name]]
        found[NAMES[name]] = (df, [m for m in measures if m in df.columns])
    none = {c: F.lit(None).cast("double") for c in ("p5", "p25", "p75", "p95", "mean", "current_setting")}
    out = summary.size_summary(found).withColumn("current_setting", none["current_setting"])
    # measures in micrometres are only told where all objects have them
    metric_rows = F.col("measure").endswith("_um") | F.col("measure").endswith("_um2")
    out = out.join(chosen.select("dataset", "um"), "dataset").where(~metric_rows | F.col("um")).drop("um")
    now = current(settings, chosen)
    ideas = suggested(tables, chosen).join(now.withColumnRenamed("value", "current_setting"), ["dataset", "setting"], "left")
    label, given = F.lit(None).cast("string"), F.col("current_setting")
    for name, (words, area, _) in SUGGESTED.items():
        label = F.when(F.col("setting") == name, F.concat(F.lit(f"{words} ("), F.col("area_unit" if area else "length_unit"), F.lit(")"))).otherwise(label)
    for name, (words, setting) in TYPICAL.items():
        label = F.when((F.col("setting") == name) & F.col("um"), F.lit(words)).otherwise(label)
        given = F.when(F.col("setting") == name, F.lit(settings.get(setting)).cast("double")).otherwise(given)
    ideas = ideas.select("dataset", F.lit("SUGGESTION").alias("object"), label.alias("measure"), F.lit(None).cast("long").alias("n"), F.col("value").alias("median"),
                         *[none[c].alias(c) for c in ("p5", "p25", "p75", "p95", "mean")], given.alias("current_setting"))
    out = out.unionByName(ideas.where("measure is not null"))
    if "cells" in tables and "n_nuclei" in tables["cells"].columns:
        share = multinucleated(tables["cells"]).select("dataset", F.lit("cells").alias("object"), F.lit("fraction multi-nucleated").alias("measure"), "n", F.col("fraction").alias("median"), *[c.alias(n) for n, c in none.items()])
        out = out.unionByName(share)
    return out


def histograms(tables: Mapping[str, DataFrame], settings: Mapping[str, Any], bins: int = 50) -> DataFrame:
    """(dataset, object, measure, bin, n, log): histograms of every size in its scope's unit; raw areas and nuclei areas also with logarithmic bins.

    Limits are stretched to show the settings that act on a measure, as they are for all files.
    """
    tables = {n: df for n, df in tables.items() if df is not None}
    chosen = units(tables)
    marks = {r.setting: r.value for r in current(settings, chosen).where(F.col("dataset") == EVERY).collect() if r.value is not None}
    parts = []
    for name, df in tables.items():
        long = in_unit(df, MEASURES[name], chosen)
        for measure in [m.removesuffix("_px") for m in MEASURES[name] if m in df.columns]:
            one = long.where(F.col("measure") == measure).select("dataset", "value")
            include = [marks[m] for m in MARKS.get((name, measure), ()) if marks.get(m)]
            both = [(summary.histogram(one, ["dataset"], bins, include), False)]
            if measure == "area" and name in ("raw", "nuclei"):
                both.append((summary.log_histogram(one, ["dataset"], bins, include), True))
            parts += [h.select("dataset", F.lit(name).alias("object"), F.lit(measure).alias("measure"), "bin", "n", F.lit(logs).alias("log")) for h, logs in both]
    return reduce(DataFrame.unionByName, parts)
