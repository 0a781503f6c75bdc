"""Statistics per group and column.

Value columns are turned into one long table, so the number of shuffles does not depend
on how many columns or groups there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text
from tessera.functions.probability import rank_sum_p, welch_p
from tessera.operators.prefix import (
    column_quantiles,
    quantiles,
    running_below,
    running_min_from_above,
    value_counts,
)
from tessera.session import cut, deal, is_small, side


def long_values(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, column, value) with NULL and NaN values dropped."""
    slim = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    out = deal(slim).unpivot(list(keys), list(columns), "column", "value")
    return out.where(F.col("value").isNotNull() & ~F.isnan("value"))


def replicate_key(level: str, dataset: Column, scene: Column, well: Column | None) -> Column:
    """What counts as one replicate: the dataset, a well, or a scene."""
    if level == "dataset":
        return dataset.cast("string")
    part = well if level == "well" and well is not None else scene
    return F.concat_ws("|", dataset.cast("string"), F.coalesce(part.cast("string"), F.lit("nan")))


def keep_large_groups(df: DataFrame, group: str, least: int) -> DataFrame:
    """Drop rows of groups with fewer than ``least`` rows."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    return df.join(side(sizes.select(group)), group, "left_semi")


def group_flags(df: DataFrame, group: str, control: str = "is_control") -> DataFrame:
    """(group, is_control): a group counts as control when most of its rows do."""
    share = F.avg(F.coalesce(F.col(control), F.lit(False)).cast("int"))
    return df.where(F.col(group).isNotNull()).groupBy(group).agg((share > 0.5).alias("is_control"))


def order_groups(
    df: DataFrame,
    group: str,
    sort: str = "name",
    controls_first: bool = True,
    first_column: str | None = None,
    appearance: str | None = None,
) -> DataFrame:
    """(group, is_control, position): the order in which groups are shown, from 1."""
    flags = group_flags(df, group)
    if sort == "median" and first_column:
        med = quantiles(df.where(F.col(group).isNotNull()), [group], first_column, {"__sort": 0.5})
        flags = flags.join(med, group, "left")
        key = F.col("__sort").asc_nulls_last()
    elif sort == "none" and appearance:
        seen = df.groupBy(group).agg(F.min(appearance).alias("__sort"))
        flags = flags.join(seen, group, "left")
        key = F.col("__sort").asc()
    else:
        key = text.natural_key(F.col(group)).asc()
    first = [F.col("is_control").desc()] if controls_first else []
    # one row per group
    w = Window.orderBy(*first, key, F.col(group))
    return flags.select(group, "is_control", F.row_number().over(w).alias("position"))


def describe_groups(long: DataFrame, keys: Sequence[str], spread: bool | None = None) -> DataFrame:
    """n, mean, median, sample sd and quartiles per key."""
    moments = long.groupBy(*keys).agg(
        F.count("value").alias("n_cells"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
    )
    cuts = quantiles(long, keys, "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}, spread)
    return moments.join(cuts, list(keys))


def replicate_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str], replicate: str, spread: bool | None = None) -> DataFrame:
    """(keys, replicate, column, median): median of every column per key and replicate."""
    return column_quantiles(df, [*keys, replicate], columns, {"median": 0.5}, spread)


def describe_replicates(medians: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, sample sd and number of replicate medians."""
    return medians.groupBy(*keys).agg(
        F.count("median").alias("n_replicates"),
        F.avg("median").alias("replicate_median_mean"),
        F.stddev_samp("median").alias("replicate_median_sd"),
        F.var_samp("median").alias("replicate_median_var"),
    )


def rank_sums(
    long: DataFrame, group: str, is_control: Column, spread: bool | None = None
) -> DataFrame:
    """Rank-sum statistic of every non-control group against the pooled controls, per column.

    Rows are reduced to distinct values first.  One running count of the controls over the
    values of a column serves all groups, so control rows are never copied per group.
    """
    flagged = long.select("column", group, "value", is_control.alias("__c"))
    counts = value_counts(
        flagged, ["column"], "value", {"n_c": F.col("__c").cast("int"), "cnt": F.lit(1)}
    )
    below = running_below(counts, ["column"], "value", ["n_c"], spread).select(
        "column", "value", "n_c", "n_c_below", "n_c_total"
    )
    mine = value_counts(flagged.where(~F.col("__c")), ["column", group], "value")
    t, c = F.col("cnt").cast("double"), F.col("n_c").cast("double")

    def cubed(x: Column) -> Column:
        return x * x * x - x

    per_group = (
        mine.join(below, ["column", "value"])
        .groupBy("column", group)
        .agg(
            F.sum("cnt").alias("n1"),
            F.max("n_c_total").alias("n2"),
            F.sum(t * (F.col("n_c_below").cast("double") + c / 2)).alias("u"),
            F.sum(cubed(t + c) - cubed(c)).alias("__tie"),
        )
    )
    own_ties = counts.groupBy("column").agg(
        F.sum(cubed(F.col("n_c").cast("double"))).alias("__own")
    )
    return per_group.join(own_ties, "column").select(
        "column", group, "n1", "n2", "u", (F.col("__tie") + F.col("__own")).alias("tie_term")
    )


def rank_sum_z(u: Column, n1: Column, n2: Column, tie: Column) -> Column:
    """Tie- and continuity-corrected normal deviate of the larger U."""
    a, b = n1.cast("double"), n2.cast("double")
    n = a + b
    sd = F.sqrt(a * b / 12.0 * ((n + 1.0) - F.try_divide(tie, n * (n - 1.0))))
    return F.try_divide(F.greatest(u, a * b - u) - a * b / 2.0 - 0.5, sd)


def welch(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> tuple[Column, Column]:
    """t and degrees of freedom for unequal variances, NULL below two values a side."""
    a, b = F.try_divide(v1, n1), F.try_divide(v2, n2)
    usable = (n1 >= 2) & (n2 >= 2) & (a + b > 0)
    t = F.try_divide(m1 - m2, F.sqrt(a + b))
    df = F.try_divide(
        (a + b) * (a + b), F.try_divide(a * a, n1 - 1) + F.try_divide(b * b, n2 - 1)
    )
    return F.when(usable, t), F.when(usable, df)


def adjust_p(df: DataFrame, family: Sequence[str], p: str, out: str, spread: bool | None = None) -> DataFrame:
    """Benjamini-Hochberg within a family; NULL p-values neither count nor get a value.

    Equal p-values get the same adjusted value, so the work is on distinct ones.
    """
    counts = value_counts(df, family, p)
    ranked = running_below(counts, family, p, spread=spread).select(
        *family,
        p,
        (F.col(p) * F.col("cnt_total") / (F.col("cnt_below") + F.col("cnt"))).alias("__q"),
    )
    best = running_min_from_above(ranked, family, p, "__q", spread).select(
        *[F.col(k).alias(f"__f_{k}") for k in family],
        F.col(p).alias("__p"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__q_min_above"))).alias(out),
    )
    cond = df[p].cast("double") == best["__p"]
    for k in family:
        cond = cond & df[k].eqNullSafe(best[f"__f_{k}"])
    return df.join(best, cond, "left").drop("__p", *[f"__f_{k}" for k in family])


def summarise(
    df: DataFrame,
    group: str,
    columns: Sequence[str],
    replicate: str,
    control: str = "is_control",
    min_cells: int = 0,
    spread: bool | None = None,
) -> DataFrame:
    """The statistics table: one row per column and group with tests against controls.

    Groups below ``min_cells`` rows are left out, but their control rows still count.
    """
    if spread is None:
        spread = not is_small(df)
    known = df.where(F.col(group).isNotNull())
    sizes = known.groupBy(group).agg(
        F.count(F.lit(1)).alias("__rows"),
        (F.avg(F.coalesce(F.col(control), F.lit(False)).cast("int")) > 0.5).alias("__ctrl"),
    )
    sizes = side(sizes)
    flagged = known.join(sizes, group)
    # several passes follow; they read columns of one written table instead of redoing the joins
    wide = cut(flagged.select(group, "__ctrl", "__rows", replicate, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]))
    long = long_values(wide, [group, "__ctrl", "__rows"], columns)
    shown = long.where(F.col("__rows") >= min_cells)

    kept = wide.where(F.col("__rows") >= min_cells)
    cells = describe_groups(shown.select(group, "column", "value"), ["column", group], spread)
    reps = describe_replicates(replicate_medians(kept, [group], columns, replicate, spread), ["column", group])
    pooled = wide.where("__ctrl")
    control_median = column_quantiles(pooled, [], columns, {"ctrl_median": 0.5}, spread)
    # a replicate that spans several control groups is one replicate of the pooled controls
    control_reps = replicate_medians(pooled, [], columns, replicate, spread)
    control_reps = describe_replicates(control_reps, ["column"]).select(
        "column",
        F.col("n_replicates").alias("__cn"),
        F.col("replicate_median_mean").alias("__cm"),
        F.col("replicate_median_var").alias("__cv"),
    )
    ranks = rank_sums(shown.unionByName(long.where(F.col("__ctrl") & (F.col("__rows") < min_cells))),
                      group, F.col("__ctrl"), spread)
    out = (
        cells.join(reps, ["column", group])
        .join(sizes.select(group, F.col("__ctrl").alias("is_control")), group)
        .join(control_median, "column", "left")
        .join(control_reps, "column", "left")
        .join(ranks, ["column", group], "left")
    )
    t, dof = welch(
        F.col("replicate_median_mean"), F.col("replicate_median_var"), F.col("n_replicates"),
        F.col("__cm"), F.col("__cv"), F.col("__cn"),
    )
    tested = ~F.col("is_control")
    enough = tested & (F.col("n1") >= 3) & (F.col("n2") >= 3)
    out = out.select(
        F.lit(group).alias("group_by"),
        F.col(group).alias("group"),
        "column",
        "is_control",
        "n_cells",
        "n_replicates",
        "mean",
        "median",
        "std",
        "q25",
        "q75",
        "replicate_median_mean",
        "replicate_median_sd",
        F.try_divide(F.col("median"), F.col("ctrl_median")).alias("median_ratio_vs_ctrl"),
        (F.col("median") - F.col("ctrl_median")).alias("median_diff_vs_ctrl"),
        rank_sum_p(F.when(enough, F.col("u")), F.col("n1"), F.col("n2"), F.col("tie_term")).alias(
            "p_cells_mannwhitney"
        ),
        welch_p(F.when(tested, t), dof).alias("p_replicates_welch"),
    )
    # the adjustment reads the table several times
    out = adjust_p(cut(out), ["column"], "p_cells_mannwhitney", "q_cells_BH", spread)
    return adjust_p(out, ["column"], "p_replicates_welch", "q_replicates_BH", spread)


def robust_shift(
    df: DataFrame, group: str, columns: Sequence[str], control: str = "is_control", spread: bool | None = None
) -> DataFrame:
    """Median shift of each group in robust standard deviations of the reference rows.

    The reference is the rows of control groups, or all rows when there is no control
    group.  The scale is 1.4826 times the median absolute deviation, else the sample
    standard deviation, else 1.
    """
    flags = side(group_flags(df, group, control))
    any_control = flags.agg(F.coalesce(F.bool_or("is_control"), F.lit(False)).alias("__any"))
    flagged = df.where(F.col(group).isNotNull()).join(flags.withColumnRenamed("is_control", "__ctrl"), group)
    flagged = flagged.crossJoin(F.broadcast(any_control))  # exactly one row
    wide = flagged.select(group, "__ctrl", "__any", *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    ref = wide.where(F.col("__ctrl") | ~F.col("__any"))
    mid = column_quantiles(ref, [], columns, {"__med": 0.5}, spread)
    # one row per value column: as many rows as there are column names in this call
    centre = mid.agg(F.map_from_entries(F.collect_list(F.struct("column", "__med"))).alias("__at"))
    dev = ref.crossJoin(F.broadcast(centre)).select(*[F.abs(F.col(f"`{c}`") - F.col("__at")[c]).alias(c) for c in columns])
    mad = column_quantiles(dev, [], columns, {"__mad": 0.5}, spread)
    sd = long_values(ref, [], columns).groupBy("column").agg(F.stddev_samp("value").alias("__sd"))
    scale = mid.join(mad, "column").join(sd, "column").select(
        "column",
        "__med",
        F.coalesce(
            F.nullif(1.4826 * F.col("__mad"), F.lit(0.0)), F.nullif(F.col("__sd"), F.lit(0.0)), F.lit(1.0)
        ).alias("__scale"),
    )
    meds = column_quantiles(wide, [group], columns, {"median": 0.5}, spread)
    return meds.join(F.broadcast(scale), "column").select(
        group, "column", ((F.col("median") - F.col("__med")) / F.col("__scale")).alias("shift")
    )


def colour_limit(shifts: DataFrame) -> DataFrame:
    """Symmetric colour range of a shift matrix: P98 of the absolute shifts, at least 0.5."""
    q = quantiles(shifts.select(F.abs("shift").alias("value")), [], "value", {"limit": 0.98})
    return q.select(F.greatest(F.col("limit"), F.lit(0.5)).alias("limit"))


def plate_names(df: DataFrame) -> DataFrame:
    """Add ``plate_name``; without any plate of two or more wells everything is one plate."""
    have = df.columns
    source = F.col("source_dataset").cast("string")
    if "plate_num" in have:
        numbered = F.concat(F.lit("Plate "), F.col("plate_num").cast("bigint").cast("string"))
        if "sample_num" in have:
            sample = F.concat(F.lit(" · Sample "), F.col("sample_num").cast("bigint").cast("string"))
            numbered = F.concat(numbered, F.when(F.col("__samples"), F.coalesce(sample, F.lit(""))).otherwise(""))
        name = F.when(F.col("__plates"), numbered).otherwise(source)
    else:
        name = source
    facts = df.agg(
        (F.bool_or(F.col("plate_num").isNotNull()) if "plate_num" in have else F.lit(False)).alias("__plates"),
        (F.bool_or(F.col("sample_num").isNotNull()) if "sample_num" in have else F.lit(False)).alias("__samples"),
    )
    # the facts are one row each, written so that no later pass over the table repeats them
    named = df.crossJoin(F.broadcast(cut(facts))).withColumn("plate_name", name)
    wells = named.select("plate_name", "well_row", "well_column").distinct().groupBy("plate_name").count()
    multi = wells.agg((F.max("count") >= 2).alias("__multi"))
    return named.crossJoin(F.broadcast(cut(multi))).withColumn(
        "plate_name", F.when(F.col("__multi"), F.col("plate_name")).otherwise("all data")
    ).drop("__plates", "__samples", "__multi")


def plate_medians(df: DataFrame, columns: Sequence[str], spread: bool | None = None) -> DataFrame:
    """Median per plate position and column (zero-based row and column)."""
    placed = df.withColumn("plate_row", text.row_index(F.col("well_row"))).withColumn(
        "plate_col", F.expr("try_cast(well_column as int)") - 1
    ).where("plate_row is not null and plate_col is not null")
    return column_quantiles(plate_names(placed), ["plate_name", "plate_row", "plate_col"], columns, {"median": 0.5}, spread)


def heatmap_limits(medians: DataFrame) -> DataFrame:
    """P2 and P98 of the well medians of each column."""
    return quantiles(medians.withColumnRenamed("median", "value"), ["column"], "value", {"low": 0.02, "high": 0.98})


def time_course(
    df: DataFrame, group: str, columns: Sequence[str], time: str = "timepoint", spread: bool | None = None
) -> DataFrame:
    """Quartiles per group and time."""
    known = df.where(F.col(group).isNotNull())
    return column_quantiles(known, [group, time], columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, spread)


def box_stats(long: DataFrame, keys: Sequence[str], spread: bool | None = None) -> DataFrame:
    """Quartiles, mean, and the most extreme values within 1.5 interquartile ranges."""
    cuts = quantiles(long, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, spread)
    counts = value_counts(long, keys, "value")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    joined = counts.join(side(cuts), list(keys))
    v = F.col("value")
    return joined.groupBy(*keys).agg(
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(F.when(v >= F.col("q1") - reach, v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("q3") + reach, v)).alias("whisker_high"),
        (F.sum(v * F.col("cnt")) / F.sum("cnt")).alias("mean"),
    )


def ecdf(long: DataFrame, keys: Sequence[str], spread: bool | None = None) -> DataFrame:
    """Share of values up to and including each distinct value."""
    ranked = running_below(value_counts(long, keys, "value"), keys, "value", spread=spread)
    upto = F.col("cnt_below") + F.col("cnt")
    return ranked.select(*keys, "value", (upto / F.col("cnt_total")).alias("share"))


def axis_limits(long: DataFrame, clip: float = 0.5, spread: bool | None = None) -> DataFrame:
    """Axis range per column: clipped percentiles with five percent room (or 1 when flat)."""
    q = quantiles(long, ["column"], "value", {"lo": clip / 100, "hi": 1 - clip / 100}, spread)
    span = F.col("hi") - F.col("lo")
    pad = F.when(span > 0, 0.05 * span).otherwise(1.0)
    return q.select("column", (F.col("lo") - pad).alias("low"), (F.col("hi") + pad).alias("high"))


def subsample(df: DataFrame, group: str, key: Sequence[str], most: int) -> DataFrame:
    """At most about ``most`` rows per group for drawing, chosen by a hash of the row key.

    Taking hashes below a share of the hash range needs the group size only.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    place = (F.xxhash64(*key) % F.lit(1 << 40) + F.lit(1 << 40)) / F.lit(float(1 << 41))
    return df.join(side(sizes), group).where(place < F.lit(float(most)) / F.col("__n")).drop("__n")


def histogram(long: DataFrame, keys: Sequence[str], bins: int = 50, include: Sequence[float] = (),
              spread: bool | None = None) -> DataFrame:
    """Linear histogram over the central 99 percent, stretched to show given settings."""
    q = quantiles(long, keys, "value", {"lo": 0.005, "hi": 0.995}, spread)
    ends = long.groupBy(*keys).agg(F.min("value").alias("__mn"), F.max("value").alias("__mx"))
    q = q.join(ends, list(keys))
    flat = F.col("hi") <= F.col("lo")
    q = q.select(
        *keys,
        F.when(flat, F.col("__mn") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("__mx") + 0.5).otherwise(F.col("hi")).alias("hi"),
    ).withColumn("span", F.col("hi") - F.col("lo"))
    lo, hi, span = F.col("lo"), F.col("hi"), F.col("span")
    for x in include:
        near = (F.lit(float(x)) >= lo - 4 * span) & (F.lit(float(x)) <= hi + 4 * span)
        lo, hi = (
            F.when(near, F.least(lo, x - 0.04 * span)).otherwise(lo),
            F.when(near, F.greatest(hi, x + 0.04 * span)).otherwise(hi),
        )
    q = q.select(*keys, F.greatest(lo, F.lit(0.0)).alias("lo"), hi.alias("hi"))
    return count_bins(long, q, keys, bins)


def log_histogram(long: DataFrame, keys: Sequence[str], bins: int = 50, include: Sequence[float] = ()) -> DataFrame:
    """Histogram of positive values with logarithmic bins (``bins`` edges)."""
    positive = long.where(F.col("value") > 0)
    q = positive.groupBy(*keys).agg(
        F.greatest(F.min("value"), F.lit(1.0)).alias("lo"), (F.max("value") * 1.05).alias("hi")
    )
    lo, hi = F.col("lo"), F.col("hi")
    for x in include:
        near = (F.lit(float(x)) >= lo / 30) & (F.lit(float(x)) <= hi * 30)
        lo, hi = (
            F.when(near, F.least(lo, F.lit(x * 0.8))).otherwise(lo),
            F.when(near, F.greatest(hi, F.lit(x * 1.25))).otherwise(hi),
        )
    q = q.select(*keys, F.log10(lo).alias("lo"), F.log10(hi).alias("hi"))
    logs = positive.select(*keys, F.log10("value").alias("value"))
    return count_bins(logs, q, keys, bins - 1)


def count_bins(long: DataFrame, limits: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """(keys, bin, n): equal-width bins from 0; the last bin includes the upper limit."""
    joined = (
        long.join(side(limits), list(keys)) if keys else long.crossJoin(F.broadcast(limits))  # one row
    )
    at = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    at = F.when(F.col("value") == F.col("hi"), bins - 1).otherwise(at)
    inside = (F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))
    return joined.where(inside).groupBy(*keys, at.cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def size_summary(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], dataset: str = "dataset") -> DataFrame:
    """n, percentiles and mean of every measure, per dataset and pooled over all files."""
    parts = []
    for name, (df, measures) in tables.items():
        keyed = df.withColumn("dataset", F.explode(F.array(F.col(dataset), F.lit("ALL FILES"))))
        long = long_values(keyed, ["dataset"], measures)
        keys = ["dataset", "column"]
        cuts = quantiles(
            long, keys, "value", {"median": 0.5, "p5": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95}
        )
        base = long.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
        parts.append(
            base.join(cuts, keys).select(
                "dataset",
                F.lit(name).alias("object"),
                F.col("column").alias("measure"),
                "n",
                *[F.round(c, 3).alias(c) for c in ("median", "p5", "p25", "p75", "p95", "mean")],
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def round_to(value: Column, base: int) -> Column:
    """Pixels: to the nearest multiple of ``base`` (half to even), at least ``base``."""
    return F.greatest(F.bround(value / base) * base, F.lit(float(base)))


def two_digits(value: Column) -> Column:
    """Micrometres: two significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(1.0) - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, 0.0).otherwise(F.bround(value * scale) / scale)


def suggestions(nucleus_area: Column, nucleus_diameter: Column, cell_area: Column, micrometres: Column) -> dict[str, Column]:
    """Starting values for the size settings from measured medians."""

    def value(x: Column, base: int) -> Column:
        return F.when(micrometres, two_digits(x)).otherwise(round_to(x, base))

    return {
        "min_nucleus_size": value(nucleus_area / 3, 10),
        "min_distance": value(0.35 * nucleus_diameter, 1),
        "min_label_size": value(cell_area / 3, 50),
        "typical_nucleus_diameter": value(nucleus_diameter, 1),
        "typical_cell_area": value(cell_area, 50),
    }
