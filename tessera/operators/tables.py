"""Combining result tables: unions, metadata lookups, rescans, control flags, upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text
from tessera.operators.prefix import null_safe_join
from tessera.session import cut, side


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating columns with NaN replaced by NULL; done once at every ingest."""
    fixed = {
        f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
        for f in df.schema.fields
        if f.dataType.typeName() in ("float", "double")
    }
    return df.withColumns(fixed) if fixed else df


def union_tables(parts: Sequence[DataFrame]) -> DataFrame:
    """Union all by name; a column missing in one part is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def disambiguate_stems(files: DataFrame, stem: str = "stem", path: str = "path") -> DataFrame:
    """Every stem once: later files of the same stem get the parent folder, then a counter.

    A stem normally has one file, so the two windows see a handful of rows each.
    """
    parent = F.element_at(F.split(F.col(path), "/"), -2)
    first = F.row_number().over(Window.partitionBy(stem).orderBy(path))
    prefixed = F.when(F.col("__i") == 1, F.col(stem)).otherwise(
        F.concat(text.safe_name(F.coalesce(parent, F.lit(""))), F.lit("_"), F.col(stem))
    )
    out = files.withColumn("__i", first).withColumn("__s", prefixed)
    again = F.row_number().over(Window.partitionBy("__s").orderBy("__i", path))
    return (
        out.withColumn("__j", again)
        .withColumn(
            stem,
            F.when(F.col("__j") == 1, F.col("__s")).otherwise(
                F.concat(F.col("__s"), F.lit("_"), F.col("__j").cast("string"))
            ),
        )
        .drop("__i", "__s", "__j")
    )


def filter_scenes(
    datasets: DataFrame,
    include: Sequence[str],
    exclude: Sequence[str],
    regex: bool = False,
    case_sensitive: bool = False,
    force_single: bool = False,
    limit: int = 0,
) -> DataFrame:
    """Filter the ``scenes`` array; files with one scene are kept as they are unless forced."""
    kept = F.filter("scenes", lambda s: text.name_filter(s, include, exclude, regex, case_sensitive))
    if not force_single:
        kept = F.when(F.size("scenes") <= 1, F.col("scenes")).otherwise(kept)
    if limit > 0:
        kept = F.slice(kept, 1, limit)
    return datasets.withColumn("n_scenes_total", F.size("scenes")).withColumn("scenes", kept).where(
        F.size("scenes") > 0
    )


def expand_jobs(datasets: DataFrame) -> DataFrame:
    """One row per dataset, scene and timepoint."""
    return datasets.withColumn("scene", F.explode("scenes")).withColumn(
        "timepoint", F.explode("timepoints")
    ).drop("scenes", "timepoints")


def pending_jobs(jobs: DataFrame, done: DataFrame, keys: Sequence[str], overwrite: bool = False) -> DataFrame:
    """Jobs without a finished entry in the manifest."""
    return jobs if overwrite else jobs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def discovered(folders: DataFrame) -> DataFrame:
    """(dataset, path, discovery_index) of result folders (layout, dataset, path): the first layout of a name counts.

    The index orders by layout, then name; it is a text made of both, so nothing has to be numbered and a later run finds the same one.
    """
    first = folders.groupBy("dataset").agg(F.min(F.struct("layout", "path")).alias("__f"))
    return first.select("dataset", F.col("__f.path").alias("path"), F.format_string("%03d/%s", F.col("__f.layout").cast("int"), "dataset").alias("discovery_index"))


def latest_rescans(scans: DataFrame, order: str = "discovery_index") -> DataFrame:
    """The highest rescan per (plate, sample), the last discovered on a tie; scans without a plate stay.

    A maximum over a struct is combined before the shuffle, so no group is collected.
    """
    cols = [c for c in scans.columns if c not in ("plate", "sample")]
    best = (
        scans.where(F.col("plate").isNotNull())
        .groupBy("plate", "sample")
        .agg(F.max_by(F.struct(*cols), F.struct("rescan", order)).alias("__b"))
        .select("plate", "sample", *[F.col("__b")[c].alias(c) for c in cols])
        .select(*scans.columns)
    )
    return best.unionByName(scans.where(F.col("plate").isNull()))


def build_plate_map(
    plates: DataFrame,
    compounds: DataFrame | None,
    plate: str = "Plate",
    treatment: str = "Treatment",
    compound_columns: Sequence[str] = ("Source Name", "Class/Target"),
) -> DataFrame:
    """Plate map with normalised treatments, well ids and compound columns as text."""
    out = plates.withColumn(treatment, _normal(plates, treatment)).withColumn(
        "well_id", text.well_id(F.col("well_row"), F.col("well_column"))
    ).withColumn(plate, F.expr(f"try_cast(`{plate}` as double)").cast("bigint"))
    if compounds is not None:
        keep = [c for c in compound_columns if c in compounds.columns]
        comp = compounds.select(
            _normal(compounds, treatment).alias(treatment), *[F.col(f"`{c}`").cast("string").alias(c) for c in keep]
        )
        out = null_safe_join(out, comp, [treatment], "left")
    return out


def _normal(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.typeName()
    return text.normal_value(F.col(f"`{column}`"), kind in ("float", "double"))


def assert_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """Raise when a lookup table has a key twice (the lookup would multiply rows)."""
    known = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    twice = known.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{what}: key {tuple(twice[0])[:-1]} occurs {twice[0]['count']} times")


def add_plate_metadata(
    cells: DataFrame, plate_map: DataFrame, columns: Sequence[str], plate: str = "Plate", check: bool = True
) -> DataFrame:
    """Left lookup of plate-map columns on (plate, well)."""
    if check:
        assert_unique(plate_map, [plate, "well_id"], "plate map")
    look = plate_map.select(
        F.col(f"`{plate}`").alias("plate_num"), "well_id", *[F.col(f"`{c}`") for c in columns]
    )
    base = cells.drop(*[c for c in columns if c in cells.columns])
    return base.join(look, ["plate_num", "well_id"], "left").select(*base.columns, *[F.col(f"`{c}`") for c in columns])


def control_flag(
    treatment: Column | None,
    well: Column,
    controls: Sequence[str] = (),
    wells: Sequence[str] = (),
    treatment_is_float: bool = False,
) -> Column:
    """True for control treatments or control wells, never NULL."""
    flag = F.lit(False)
    if controls and treatment is not None:
        flag = flag | text.normal_value(treatment, treatment_is_float).isin(*[c.strip() for c in controls])
    if wells:
        wanted = F.array_contains(
            F.transform(F.array(*[F.lit(w) for w in wells]), text.normal_well), well
        )
        flag = flag | wanted
    return F.coalesce(flag, F.lit(False))


def zscores(
    df: DataFrame, columns: Sequence[str], reference: Sequence[str], control: str = "is_control"
) -> DataFrame:
    """``Zscore_<column>`` against the control rows of each reference group.

    The moments are a small aggregate (combined before the shuffle) joined back on the
    group; a window would sort every row of a group in one task.  A missing group key is
    a group of its own.  Columns that do not exist give NULL scores.
    """
    have = [c for c in columns if c in df.columns]
    is_control = F.coalesce(F.col(control), F.lit(False))
    aggs = [F.count_if(is_control).alias("__rows")]
    for i, c in enumerate(have):
        x = F.when(is_control, F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")))
        aggs += [F.avg(x).alias(f"__m{i}"), F.stddev_samp(x).alias(f"__s{i}")]
    moments = df.groupBy(*reference).agg(*aggs)
    if reference:
        joined = null_safe_join(df, side(moments), reference, "left")
    else:
        joined = df.crossJoin(F.broadcast(moments))  # exactly one row
    out = {}
    for c in columns:
        if c not in have:
            out[f"Zscore_{c}"] = F.lit(None).cast("double")
            continue
        i = have.index(c)
        usable = (F.col("__rows") > 1) & (F.col(f"__s{i}") > 0)
        out[f"Zscore_{c}"] = F.when(usable, (F.col(c) - F.col(f"__m{i}")) / F.col(f"__s{i}"))
    return joined.select(*df.columns, *[e.alias(n) for n, e in out.items()])


def upsert(old: DataFrame | None, new: DataFrame, keys: Sequence[str], done: DataFrame | None = None) -> DataFrame:
    """New rows replace old rows with the same key.

    ``done`` lists the keys that were processed; a key that now has no rows still removes
    its old ones.  Without it the keys of ``new`` are used.
    """
    if old is None:
        return new
    gone = (new if done is None else done).select(*keys).distinct()
    return old.join(gone, list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_scenes(old: DataFrame | None, new: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Upsert by scene, or by (scene, timepoint) when either table is a time series.

    The choice is part of the plan: one flag row is attached to the old table.
    """
    if old is None:
        return new
    marks = (new if done is None else done).select("scene", "timepoint")
    series = (
        old.select("scene", "timepoint").unionByName(marks)
        .groupBy("scene").agg((F.min("timepoint") != F.max("timepoint")).alias("many"))
        .agg(F.coalesce(F.bool_or("many"), F.lit(False)).alias("__series"))
    )
    # the time is part of the key only in a series, so the join stays an equality
    time = F.when(F.col("__series"), F.col("timepoint"))
    hit = marks.crossJoin(F.broadcast(series)).select("scene", F.coalesce(time, F.lit(0)).alias("__t")).distinct()
    keyed = old.crossJoin(F.broadcast(series)).withColumn("__t", F.coalesce(time, F.lit(0)))  # exactly one row
    kept = keyed.join(hit, ["scene", "__t"], "left_anti").select(*old.columns)
    return kept.unionByName(new, allowMissingColumns=True)


def evenly_spaced(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """``k`` rows at rounded, evenly spaced positions of the sorted table (all if fewer)."""
    ranked = with_row_number(df, order)
    last = F.col("__n") - 1
    # position i of k is bround(i * (n-1) / (k-1)); a row is taken when some i lands on it
    if k == 1:
        wanted = F.col("__rn") == 0
    else:
        near = F.bround((F.col("__rn") * (k - 1)).cast("double") / F.greatest(last, F.lit(1)))
        wanted = F.lit(False)
        for shift in (-1, 0, 1):
            i = near + shift
            lands = F.bround(i * last / F.lit(float(k - 1))) == F.col("__rn")
            wanted = wanted | (lands & (i >= 0) & (i <= k - 1))
    return ranked.where((F.col("__n") <= k) | wanted).drop("__rn", "__n")


def with_row_number(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Zero-based ``__rn`` and total ``__n`` over the whole sorted table.

    Rows are range-partitioned and sorted; partition sizes are added up from a checkpoint,
    so no single task sees all rows.
    """

    spread = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    placed = cut(
        spread.withColumn("__id", F.monotonically_increasing_id())
        .withColumn("__p", F.shiftright(F.col("__id"), 33).cast("int"))
        .withColumn("__i", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__id")
    )
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.orderBy("__p")
    offsets = sizes.select(
        "__p",
        F.coalesce(F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"),
        F.sum("__c").over(Window.partitionBy(F.lit(0))).alias("__n"),
    )  # one row per partition
    return (
        placed.join(F.broadcast(offsets), "__p")
        .withColumn("__rn", F.col("__o") + F.col("__i"))
        .drop("__p", "__i", "__o")
    )


def sorted_slice(df: DataFrame, order: Sequence[str], skip: int = 0, limit: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    out = out.offset(skip) if skip else out
    return out.limit(limit) if limit else out


def first_known(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """First non-null value per group in row order; of rows that share a place, the smallest value."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min_by(value, F.struct(*order, value)).alias(value)
    )


def rename_map(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))
