"""Following objects through the frames of a series.

Links between two frames do not depend on links elsewhere except through what is already
taken, so linking runs level by level (previous frame, the one before it, ...) for all
frames of all scenes at once, instead of frame by frame.  The overlap table is a join, the
assignment is an auction between blocks of objects (``matching``), and track ids come from
following predecessor pointers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from tessera.operators import pixels as px
from tessera.operators.matching import assign
from tessera.operators.tiles import Tiles, chained
from tessera.session import cut, look_up


# ---------------------------------------------------------------- overlaps from tiles


def tile_overlaps(t: Tiles, labels: str, time: str, levels: int = 1) -> DataFrame:
    """The overlap table of ``pixels.frame_overlaps`` from tiled label images.

    Tiles at the same place of two frames meet in a join; only counts leave the tile.
    """
    keys = [c for c in t.keys if c != time]
    pairs = px.frame_pairs(t.df.select(*t.keys), keys, time, levels)
    dtype, size = t.layers[labels], t.size
    # frames are cropped to the smallest frame of the series
    shape = t.df.groupBy(*keys).agg(F.min("height").alias("__h"), F.min("width").alias("__w"))
    cur = look_up(t.df.select(*t.keys, "ty", "tx", "height", "width", F.col(labels).alias("__b")), shape, keys)
    old = t.df.select(
        *keys, F.col(time).alias(f"{time}_prev"), "ty", "tx", F.col("height").alias("__ph"),
        F.col("width").alias("__pw"), F.col(labels).alias("__a"),
    )
    met = look_up(cur, pairs, [*keys, time]).join(old, [*keys, f"{time}_prev", "ty", "tx"])
    fields = [t.df.schema[c] for c in [*keys, time]]
    prev = StructField(f"{time}_prev", t.df.schema[time].dataType)
    schema = StructType([*fields, prev, StructField("level", LongType())]
                        + [StructField(c, LongType()) for c in ("a", "b", "shared")])
    names = schema.fieldNames()

    def block(blob, row, h, w, dt):
        y, x = row["ty"] * size, row["tx"] * size
        a = np.frombuffer(blob, dt).reshape(min(size, h - y), min(size, w - x))
        return a[: max(0, row["__h"] - y), : max(0, row["__w"] - x)]

    def count(row):
        b = block(row["__b"], row, row["height"], row["width"], dtype)
        a = block(row["__a"], row, row["__ph"], row["__pw"], dtype)
        both = (a > 0) & (b > 0)
        u, n = np.unique(np.stack([a[both], b[both]]), axis=1, return_counts=True)
        return {**{c: [row[c]] * len(n) for c in names[:-3]}, "a": u[0].tolist(), "b": u[1].tolist(), "shared": n.tolist()}

    shared = met.mapInPandas(chained(None, (), count, schema), schema).groupBy(*names[:-1]).agg(F.sum("shared").alias("shared"))
    sizes = cell_table(t, labels, shape)
    area_a = sizes.select(*keys, F.col(time).alias(f"{time}_prev"), F.col("label").alias("a"), F.col("area").alias("area_a"))
    area_b = sizes.select(*keys, time, F.col("label").alias("b"), F.col("area").alias("area_b"))
    return (
        shared.join(area_a, [*keys, f"{time}_prev", "a"]).join(area_b, [*keys, time, "b"])
        .withColumn("iou", F.col("shared") / (F.col("area_a") + F.col("area_b") - F.col("shared")))
        .withColumn("share_b", F.col("shared") / F.col("area_b"))
    )


def cell_table(t: Tiles, labels: str, shape: DataFrame) -> DataFrame:
    """(keys, label, area) inside the common crop of each series."""
    keys = [c for c in shape.columns if not c.startswith("__")]
    s = t.select(labels)
    s = s._with(look_up(s.df, shape, keys), s.layers)

    def run(b):
        a = b[labels][: max(0, b.__dict__["__h"] - b.core_y), : max(0, b.__dict__["__w"] - b.core_x)]
        u, n = np.unique(a[a > 0], return_counts=True)
        return {"label": u.tolist(), "area": n.tolist()}

    return s.rows([labels], "label bigint, area bigint", run, per_image=["__h", "__w"]).groupBy(
        *t.keys, "label"
    ).agg(F.sum("area").alias("area"))


# ---------------------------------------------------------------- linking


def link(
    cells: DataFrame, overlaps: DataFrame, keys: Sequence[str], time: str, min_iou: float = 0.25, max_gap: int = 1,
    divisions: bool = True, split_fraction: float = 0.5, frames: DataFrame | None = None,
) -> DataFrame:
    """Tracks (keys, time, cell_id, track_id, parent_track_id, iou_previous, frames_bridged).

    ``cells`` is (keys, time, label); ``overlaps`` covers ``max_gap + 1`` available frames
    back.  ``frames`` gives (keys, time, frame_index) where missing frames count in gaps;
    without it the time itself is the index.
    """
    keys = list(keys)
    prev = f"{time}_prev"
    if frames is None:
        frames = cells.select(*keys, time).distinct().withColumn("frame_index", F.col(time).cast("bigint"))
    index = frames.select(*keys, time, "frame_index")
    old_index = index.select(*keys, F.col(time).alias(prev), F.col("frame_index").alias("__old"))
    near = (
        overlaps.join(index, [*keys, time]).join(old_index, [*keys, prev])
        .withColumn("gap", F.col("frame_index") - F.col("__old") - 1)
        .where(F.col("gap") <= max_gap).drop("frame_index", "__old")
    )
    near = cut(near)
    links = None
    for level in range(max_gap + 1):
        cand = near.where((F.col("level") == level) & (F.col("iou") >= min_iou))
        if links is not None:
            taken_b = links.select(*keys, time, "b")
            # an object is gone once a link leads from it to any later frame
            taken_a = links.select(*keys, prev, "a").distinct()
            cand = cand.join(taken_b, [*keys, time, "b"], "left_anti").join(taken_a, [*keys, prev, "a"], "left_anti")
        cand = cut(cand.select(*keys, time, prev, "gap", "a", "b", "iou"))
        if cand.isEmpty():
            continue
        now = assign(cand, [*keys, time, prev]).join(
            cand.select(*keys, time, prev, "a", "b", "gap"), [*keys, time, prev, "a", "b"]
        )
        now = cut(now.select(*keys, time, prev, "a", "b", "iou", "gap"))
        links = now if links is None else links.unionByName(now)
    cells = cells.select(*keys, time, "label")
    if links is None:
        links = near.select(*keys, time, prev, "a", "b", "iou", "gap").limit(0)

    # predecessor pointers, doubled until every cell points at the start of its track
    ptr = cells.join(
        links.select(*keys, time, F.col("b").alias("label"), F.col(prev).alias("pt"), F.col("a").alias("pl"), "iou", "gap"),
        [*keys, time, "label"], "left",
    )
    base = cut(ptr)
    heads = base.select(
        *keys, time, "label", F.coalesce("pt", time).alias("ht"), F.coalesce("pl", "label").alias("hl")
    )
    heads = cut(heads)
    while True:
        up = heads.select(*keys, F.col(time).alias("ht"), F.col("label").alias("hl"), F.col("ht").alias("ut"), F.col("hl").alias("ul"))
        step = cut(heads.join(up, [*keys, "ht", "hl"]).select(*keys, time, "label", "ht", "hl", "ut", "ul"))
        moved = not step.where("ut <> ht or ul <> hl").isEmpty()
        heads = step.select(*keys, time, "label", F.col("ut").alias("ht"), F.col("ul").alias("hl"))
        if not moved:
            break

    # ids count track starts by frame and label: totals of earlier frames plus the place in the frame
    starts = heads.where((F.col(time) == F.col("ht")) & (F.col("label") == F.col("hl"))).select(*keys, time, "label")
    per_frame = starts.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    per_frame = per_frame.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*keys, time).orderBy("label"))
    ids = starts.withColumn("__i", place).join(per_frame, [*keys, time]).select(
        *keys, F.col(time).alias("ht"), F.col("label").alias("hl"), (F.col("before") + F.col("__i")).alias("track_id")
    )
    tracked = cut(heads.join(ids, [*keys, "ht", "hl"]).select(*keys, time, "label", "track_id"))

    out = tracked.join(base.select(*keys, time, "label", "pt", "iou", "gap"), [*keys, time, "label"])
    if divisions:
        # the largest share wins, the smaller label on a tie
        owner = near.where((F.col("level") == 0) & (F.col("share_b") >= split_fraction)).groupBy(
            *keys, time, prev, F.col("b").alias("label")
        ).agg(F.max_by("a", F.struct("share_b", -F.col("a"))).alias("a"))
        parents = owner.join(
            tracked.select(*keys, F.col(time).alias(prev), F.col("label").alias("a"), F.col("track_id").alias("parent")),
            [*keys, prev, "a"],
        ).select(*keys, time, "label", "parent")
        out = out.join(parents, [*keys, time, "label"], "left")
    else:
        out = out.withColumn("parent", F.lit(None).cast("bigint"))
    return out.select(
        *keys, time, F.col("label").alias("cell_id"), "track_id",
        F.when(F.col("pt").isNull(), F.col("parent")).alias("parent_track_id"),
        F.col("iou").alias("iou_previous"), F.coalesce("gap", F.lit(0)).alias("frames_bridged"),
    )


def track_tiles(
    t: Tiles, labels: str, time: str = "timepoint", min_iou: float = 0.25, max_gap: int = 1, divisions: bool = True,
    split_fraction: float = 0.5, frames: DataFrame | None = None,
) -> DataFrame:
    """Tracks of tiled label images (keys include the time)."""
    keys = [c for c in t.keys if c != time]
    shape = t.df.groupBy(*keys).agg(F.min("height").alias("__h"), F.min("width").alias("__w"))
    found = cell_table(t, labels, shape).select(*t.keys, "label")
    return link(found, tile_overlaps(t, labels, time, max_gap + 1), keys, time, min_iou, max_gap, divisions, split_fraction, frames)


def tracked_movie(t: Tiles, labels: str, tracks: DataFrame) -> Tiles:
    """Label tiles with track ids instead of cell ids."""
    mapping = tracks.select(*t.keys, F.col("cell_id").alias("label"), F.col("track_id").alias("new"))
    return t.relabel(labels, mapping, missing="zero")


def track_summary(tracks: DataFrame, keys: Sequence[str], time: str = "timepoint") -> DataFrame:
    """One row per track: span, length, parent, daughters, and whether it covers the whole series."""
    keys = list(keys)
    per_track = tracks.groupBy(*keys, "track_id").agg(
        F.min(time).alias("first_timepoint"), F.max(time).alias("last_timepoint"),
        F.count(F.lit(1)).alias("n_frames"), F.max("parent_track_id").alias("parent_track_id"),
    )
    kids = tracks.where("parent_track_id is not null").groupBy(*keys, F.col("parent_track_id").alias("track_id")).agg(
        F.count(F.lit(1)).alias("n_daughters")
    )
    frames = tracks.select(*keys, time).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("__t"))
    return (
        per_track.join(kids, [*keys, "track_id"], "left").join(frames, keys)
        .select(*keys, "track_id", "first_timepoint", "last_timepoint", "n_frames", "parent_track_id",
                F.coalesce("n_daughters", F.lit(0)).alias("n_daughters"), (F.col("n_frames") == F.col("__t")).alias("whole_series"))
    )


def add_tracks(measurements: DataFrame, tracks: DataFrame, summary: DataFrame, keys: Sequence[str], time: str = "timepoint") -> DataFrame:
    """Track columns right after ``cell_id``; existing ones are replaced."""
    keys, new = list(keys), ["track_id", "parent_track_id", "track_n_frames"]
    lengths = summary.select(*keys, "track_id", F.col("n_frames").alias("track_n_frames"))
    look = tracks.join(lengths, [*keys, "track_id"], "left").select(*keys, time, "cell_id", *new)
    base = measurements.drop(*[c for c in new if c in measurements.columns])
    at = base.columns.index("cell_id") + 1
    return base.join(look, [*keys, time, "cell_id"], "left").select(*base.columns[:at], *new, *base.columns[at:])


def displacement(points: DataFrame, keys: Sequence[str], time: str, y: str = "centroid_y", x: str = "centroid_x") -> DataFrame:
    """Distance moved since the previous frame of the same track (a track has few frames)."""
    w = Window.partitionBy(*keys).orderBy(time)
    d = F.sqrt((F.col(y) - F.lag(y).over(w)) ** 2 + (F.col(x) - F.lag(x).over(w)) ** 2)
    return points.withColumn("displacement_px", d)


def ancestors(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, track_id, ancestor, generations): all ancestors of every track, by joining known lines of descent with each other.

    After round r lines of up to 2 ** r generations are known; it ends when a round finds none.
    """
    keys = list(keys)
    known = cut(summary.where("parent_track_id is not null").select(*keys, "track_id", F.col("parent_track_id").alias("ancestor"), F.lit(1).alias("generations")))
    reach = 1
    while True:
        # lines of more than ``reach`` generations are new: one of exactly ``reach``, continued by any known line
        first = known.where(F.col("generations") == reach).select(*keys, "track_id", F.col("ancestor").alias("via"))
        then = known.select(*keys, F.col("track_id").alias("via"), "ancestor", "generations")
        longer = cut(first.join(then, [*keys, "via"]).select(*keys, "track_id", "ancestor", (F.col("generations") + reach).alias("generations")))
        if longer.isEmpty():
            return known
        known, reach = known.unionByName(longer), 2 * reach
