"""Exact running totals, ranks and quantiles without a task that sees a whole group.

A window over a group runs in one task, so a group with a third of all rows would sit on
one executor.  Here rows are first reduced to distinct values, and the running total is
assembled from three levels of value buckets (see ``functions.ordering``).  Every window
is over buckets, whose number per partition has a fixed upper bound.

Groups are carried as one struct column.  A struct compares equal to itself when a field
is NULL, so a missing key is a group of its own, and because the struct itself is never
NULL the optimizer adds no per-branch filters and the shuffles are shared between levels.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.ordering import high_bucket, log_bucket, middle_bucket, order_key
from tessera.session import cut, is_small, side

_BEFORE = (Window.unboundedPreceding, -1)

#: Values of groups of at most so many rows are collected into lists; an aggregating task holds those of 128 groups at once.
GROUP_ROWS = 1 << 13


def value_counts(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Distinct non-null values per group with row counts (partial aggregation does most)."""
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    sums = sums or {"cnt": F.lit(1)}
    named = {f"__w_{n}": c.cast("bigint") for n, c in sums.items()}
    src = df.select(*keys, v.alias(value), *[c.alias(n) for n, c in named.items()])
    return (
        src.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(*[F.sum(f"__w_{n}").alias(n) for n in sums])
    )


def running_below(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: Sequence[str] = ("cnt",),
    spread: bool | None = None,
) -> DataFrame:
    """Add ``<sum>_below`` (total over smaller values of the group) and ``<sum>_total``.

    ``counts`` holds one row per (group, value).  ``spread`` forces or forbids the
    three-level form; by default the planner's size of the input decides.
    """
    if spread is None:
        spread = not is_small(counts)
    if not spread:
        whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        below = whole.orderBy(value).rowsBetween(*_BEFORE)
        return counts.select(
            "*",
            *[_zero(F.sum(s).over(below)).alias(f"{s}_below") for s in sums],
            *[F.sum(s).over(whole).alias(f"{s}_total") for s in sums],
        )
    src, mid, top, others = _levels(counts, keys, value, [(F.sum, s, s) for s in sums])
    below = Window.partitionBy("__g").orderBy("__h").rowsBetween(*_BEFORE)
    top = top.select(
        "__g",
        "__h",
        *[_zero(F.sum(s).over(below)).alias(f"__t_{s}") for s in sums],
        *[F.sum(s).over(Window.partitionBy("__g")).alias(f"{s}_total") for s in sums],
    )
    below = Window.partitionBy("__g", "__h").orderBy("__m").rowsBetween(*_BEFORE)
    mid = mid.select(
        "__g", "__h", "__m", *[_zero(F.sum(s).over(below)).alias(f"__u_{s}") for s in sums]
    )
    base = mid.join(top, ["__g", "__h"])
    below = Window.partitionBy("__g", "__h", "__m").orderBy(value).rowsBetween(*_BEFORE)
    low = src.select("*", *[_zero(F.sum(s).over(below)).alias(f"__l_{s}") for s in sums])
    return low.join(base, ["__g", "__h", "__m"]).select(
        *_ungroup(keys),
        value,
        *others,
        *[(F.col(f"__t_{s}") + F.col(f"__u_{s}") + F.col(f"__l_{s}")).alias(f"{s}_below") for s in sums],
        *[f"{s}_total" for s in sums],
    )


def running_min_from_above(
    ranked: DataFrame, keys: Sequence[str], value: str, what: str, spread: bool | None = None
) -> DataFrame:
    """Add ``<what>_min_above``: minimum of ``what`` over this and all larger values."""
    if spread is None:
        spread = not is_small(ranked)
    if not spread:
        whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        up = whole.orderBy(value).rowsBetween(Window.currentRow, Window.unboundedFollowing)
        return ranked.withColumn(f"{what}_min_above", F.min(what).over(up))
    src, mid, top, others = _levels(ranked, keys, value, [(F.min, what, "__s")])

    def after(*by):
        return Window.partitionBy(*by).rowsBetween(1, Window.unboundedFollowing)

    top = top.select("__g", "__h", F.min("__s").over(after("__g").orderBy("__h")).alias("__t"))
    mid = mid.select(
        "__g", "__h", "__m", F.min("__s").over(after("__g", "__h").orderBy("__m")).alias("__u")
    )
    base = mid.join(top, ["__g", "__h"])
    here_on = (
        Window.partitionBy("__g", "__h", "__m")
        .orderBy(value)
        .rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    low = src.select("*", F.min(what).over(here_on).alias("__l"))
    return low.join(base, ["__g", "__h", "__m"]).select(
        *_ungroup(keys), value, *others, F.least("__l", "__u", "__t").alias(f"{what}_min_above")
    )


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    spread: bool | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group that has values.

    ``probs`` maps output column to probability, for example ``{"median": 0.5}``.  The
    built-in percentile keeps the distinct values of a group in one task, so it is used
    for inputs of a checked size only; see ``column_quantiles`` for larger ones.
    """
    if spread is None:
        spread = not is_small(df)
    v = _known(value)
    if not spread:
        q = F.percentile("__v", F.array(*[F.lit(float(p)) for p in probs.values()]))
        kept = df.select(*keys, v.alias("__v")).where(F.col("__v").isNotNull())
        one = kept.groupBy(*keys).agg(q.alias("__q")).where(F.col("__q").isNotNull())
        return one.select(*keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(probs)])
    kept = df.select(*keys, v.alias("__v")).where(F.col("__v").isNotNull())
    return _spread_quantiles(kept, keys, ["__v"], probs).drop("__column")


def column_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probs: Mapping[str, float],
    spread: bool | None = None,
) -> DataFrame:
    """Quantiles of several columns: one row (keys, column, probs) per group and column that has values."""
    if spread is None:
        spread = not is_small(df)
    slim = df.select(*keys, *[_known(c).alias(c) for c in columns])
    if not spread:
        return quantiles(slim.unpivot(list(keys), list(columns), "column", "__v"), [*keys, "column"], "__v", probs, False)
    return _spread_quantiles(slim, keys, columns, probs).withColumnRenamed("__column", "column")


def _spread_quantiles(slim: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """(keys, __column, probs), by the sizes of the groups, which are counted first.

    The values of a small group meet in one list per column, so a row is moved once for all
    its columns.  In larger groups the values are counted by bucket, and only buckets that
    hold a wanted rank are looked into.
    """
    sizes = cut(slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")))
    few = F.col("__n") <= GROUP_ROWS
    some, many = sizes.agg(F.bool_or(few), F.bool_or(~few)).first()
    parts = []
    if many:
        large = side(sizes.where(~few).select(_grouped(keys).alias("__g"), F.monotonically_increasing_id().alias("__id")))
        keyed = slim.select(_grouped(keys).alias("__g"), *columns)
        parts.append(_quantiles_of_large(keyed, large, keys, columns, probs))
        slim = keyed.join(large.select("__g"), "__g", "left_anti").select(*_ungroup(keys), *columns)
    if some or not many:
        parts.append(_quantiles_of_few(slim, keys, columns, probs))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _known(c: str) -> Column:
    return F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))


def _quantiles_of_few(slim: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Quantiles of groups of at most ``GROUP_ROWS`` rows, whose sorted values are one list per column."""
    # groups are told apart by a number before their keys are compared as text
    mark = F.xxhash64(*[F.col(k) for k in keys]) if keys else F.lit(0).cast("bigint")
    lists = slim.groupBy(mark.alias("__k"), *keys).agg(*[F.sort_array(F.collect_list(f"`{c}`")).alias(f"__l{i}") for i, c in enumerate(columns)])
    named = F.array(*[F.struct(F.lit(c).alias("__column"), F.col(f"__l{i}").alias("__l")) for i, c in enumerate(columns)])
    each = lists.select(*keys, F.explode(named).alias("__s")).select(*keys, "__s.__column", "__s.__l").where(F.size("__l") > 0)
    out = []
    for name, p in probs.items():
        position = (F.size("__l") - 1) * F.lit(float(p))
        lo, hi = F.get("__l", F.floor(position).cast("int")), F.get("__l", F.ceil(position).cast("int"))
        out.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return each.select(*keys, "__column", *out)


def _quantiles_of_large(
    keyed: DataFrame, large: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Mapping[str, float]
) -> DataFrame:
    """Quantiles of the groups in ``large`` (``__g``, ``__id``): counts by bucket, then the values of the buckets that hold a rank."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").alias("v")) for i, c in enumerate(columns)]))
    long = keyed.join(large, "__g").select("__id", values.alias("__s")).select("__id", F.col("__s.c").alias("__c"), F.col("__s.v").alias("__v"))
    long = long.where(F.col("__v").isNotNull()).withColumn("__h", log_bucket(F.col("__v")))
    by = Window.partitionBy("__id", "__c")
    buckets = long.groupBy("__id", "__c", "__h").agg(F.count(F.lit(1)).alias("cnt")).select(
        "*", _zero(F.sum("cnt").over(by.orderBy("__h").rowsBetween(*_BEFORE))).alias("cnt_below"), F.sum("cnt").over(by).alias("cnt_total")
    )
    covers = F.lit(False)
    for p in probs.values():
        position = (F.col("cnt_total") - 1) * F.lit(float(p))
        covers = covers | _holds(F.floor(position)) | _holds(F.ceil(position))
    # at most two buckets per group, column and probability
    wanted = side(buckets.where(covers).select("__id", "__c", "__h", F.col("cnt_below").alias("__b"), F.col("cnt_total").alias("__n")))
    at = ["__id", "__c", "__h"]
    inside = cut(long.join(wanted.select(*at), at).groupBy(*at, "__v").agg(F.count(F.lit(1)).alias("cnt")))
    ranked = running_below(inside, at, "__v").join(wanted, at).select(
        "__id", "__c", "__v", "cnt", (F.col("__b") + F.col("cnt_below")).alias("cnt_below"), F.col("__n").alias("cnt_total")
    )
    named = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("__c") + 1).alias("__column")
    return _pick(ranked, ["__id", "__c"], "__v", probs).join(large, "__id").select(*_ungroup(keys), named, *probs)


def quantiles_of_counts(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    spread: bool | None = None,
) -> DataFrame:
    """Same, from a table of distinct values with their ``cnt``."""
    return _pick(running_below(counts, keys, value, spread=spread), keys, value, probs)


def _holds(rank: Column) -> Column:
    return (F.col("cnt_below") <= rank) & (rank < F.col("cnt_below") + F.col("cnt"))


def _pick(ranked: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Quantiles from values with their ``cnt``, ``cnt_below`` and ``cnt_total``."""
    last = F.col("cnt_total") - 1
    covers = F.lit(False)
    picks, out = [], []
    for name, p in probs.items():
        position = last * F.lit(float(p))
        lo, hi = _holds(F.floor(position)), _holds(F.ceil(position))
        covers = covers | lo | hi
        picks += [
            F.max(F.when(lo, F.col(value))).alias(f"__lo_{name}"),
            F.max(F.when(hi, F.col(value))).alias(f"__hi_{name}"),
        ]
        position = F.col("__last") * F.lit(float(p))
        step = F.col(f"__hi_{name}") - F.col(f"__lo_{name}")
        out.append((F.col(f"__lo_{name}") + step * (position - F.floor(position))).alias(name))
    picked = ranked.where(covers).groupBy(*keys).agg(F.max(last).alias("__last"), *picks)
    return picked.select(*keys, *out)


def null_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join on keys that may be NULL on both sides; NULL matches NULL."""
    key = F.struct(*[F.col(c) for c in on])
    payload = [c for c in right.columns if c not in on]
    return (
        left.withColumn("__g", key)
        .join(right.select(key.alias("__g"), *payload), "__g", how)
        .drop("__g")
    )


def _levels(df: DataFrame, keys: Sequence[str], value: str, aggs):
    """Bucketed source plus its two summary levels."""
    others = [c for c in df.columns if c not in keys and c != value]
    keyed = df.select(
        _grouped(keys).alias("__g"),
        value,
        *others,
        order_key(F.col(value)).alias("__k"),
    )
    src = keyed.select(
        "__g", value, *others,
        _zero(high_bucket(F.col("__k"))).alias("__h"),
        _zero(middle_bucket(F.col("__k"))).alias("__m"),
    )
    mid = src.groupBy("__g", "__h", "__m").agg(*[f(i).alias(o) for f, i, o in aggs])
    top = mid.groupBy("__g", "__h").agg(*[f(o).alias(o) for f, _, o in aggs])
    return src, mid, top, others


def _grouped(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))


def _ungroup(keys: Sequence[str]) -> list[Column]:
    return [F.col("__g").getField(k).alias(k) for k in keys]


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))
