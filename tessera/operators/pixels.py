"""Objects and images as plain relations: one row per pixel.

``labels`` tables have (keys, y, x, label) with label 0 as background, ``pixels`` tables
have (keys, y, x, v).  These forms suit modest images and cross-checks; whole scenes run
tile by tile (``operators.tiles``) and give the same tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.prefix import quantiles


def explode_image(df: DataFrame, keys: Sequence[str], values: str, width: int | Column) -> DataFrame:
    """(keys, y, x, v) from a row-major array column."""
    w = F.lit(width) if isinstance(width, int) else width
    return df.select(*keys, F.posexplode(values).alias("__i", "v"), w.alias("__w")).select(
        *keys,
        (F.floor(F.col("__i") / F.col("__w"))).cast("int").alias("y"),
        (F.col("__i") % F.col("__w")).cast("int").alias("x"),
        "v",
    )


def crop_common(df: DataFrame, keys: Sequence[str], member: Sequence[str]) -> DataFrame:
    """Crop all images of a series to the smallest height and width among them."""
    shapes = df.groupBy(*keys, *member).agg(F.max("y").alias("__h"), F.max("x").alias("__w"))
    least = shapes.groupBy(*keys).agg(F.min("__h").alias("__h"), F.min("__w").alias("__w"))
    return df.join(least, list(keys)).where("y <= __h and x <= __w").drop("__h", "__w")


def contacts(labels: DataFrame, keys: Sequence[str], intensity: str | None = None) -> DataFrame:
    """Touching label pairs: number of shared pixel edges and mean intensity across them."""
    e = F.col(intensity).cast("double") if intensity else F.lit(None).cast("double")
    cell = F.struct(F.col("label").alias("l"), F.col("y"), F.col("x"), e.alias("e"))
    base = labels.select(*keys, "y", "x", cell.alias("me"))
    # a window partition is one image row or one image column
    right = F.lead("me").over(Window.partitionBy(*keys, "y").orderBy("x"))
    below = F.lead("me").over(Window.partitionBy(*keys, "x").orderBy("y"))
    sides = base.select(*keys, "me", right.alias("other")).where("other.x = me.x + 1").unionByName(
        base.select(*keys, "me", below.alias("other")).where("other.y = me.y + 1")
    )
    touching = sides.where("me.l > 0 and other.l > 0 and me.l <> other.l")
    return touching.groupBy(
        *keys,
        F.least("me.l", "other.l").alias("cell_id_a"),
        F.greatest("me.l", "other.l").alias("cell_id_b"),
    ).agg(
        F.count(F.lit(1)).alias("contact_px"),
        F.avg((F.col("me.e") + F.col("other.e")) / 2).alias("junction_intensity"),
    )


def both_directions(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, cell_id, other_id, contact_px): the symmetric adjacency as rows."""
    return edges.select(*keys, F.col("cell_id_a").alias("cell_id"), F.col("cell_id_b").alias("other_id"), "contact_px").unionByName(
        edges.select(*keys, F.col("cell_id_b").alias("cell_id"), F.col("cell_id_a").alias("other_id"), "contact_px")
    )


def neighbour_counts(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return both_directions(edges, keys).groupBy(*keys, "cell_id").agg(
        F.count(F.lit(1)).alias("n_neighbours"), F.sum("contact_px").alias("contact_px")
    )


def region_columns(n: Column, cy: Column, cx: Column, vy: Column, vx: Column, cov: Column,
                   y0: Column, x0: Column, y1: Column, x1: Column) -> dict[str, Column]:
    """Shape descriptors from central moments and the bounding box (inclusive limits)."""
    half = (vy - vx) / 2
    root = F.sqrt(half * half + cov * cov)
    big = (vy + vx) / 2 + root
    small = F.greatest((vy + vx) / 2 - root, F.lit(0.0))
    # axis aligned shapes are noise free only up to rounding
    turned = F.when(vx == vy, F.when(cov > 0, F.lit(0.25) * F.pi()).otherwise(F.lit(-0.25) * F.pi())).otherwise(
        0.5 * F.atan2(2 * cov, vy - vx)
    )
    box = (y1 - y0 + 1) * (x1 - x0 + 1)
    return {
        "area_px": n,
        "centroid_y": cy,
        "centroid_x": cx,
        "major_axis_px": 4 * F.sqrt(big),
        "minor_axis_px": 4 * F.sqrt(small),
        "eccentricity": F.when(big > 0, F.sqrt(F.greatest(1 - small / big, F.lit(0.0)))).otherwise(0.0),
        "orientation_rad": turned,
        "equivalent_diameter_px": F.sqrt(4 * n / F.pi()),
        "extent": n / box,
    }


def regions(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per object with its moments-based shape."""
    g = labels.where("label > 0").groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("y").alias("cy"),
        F.avg("x").alias("cx"),
        F.var_pop("y").alias("vy"),
        F.var_pop("x").alias("vx"),
        F.covar_pop(F.col("y").cast("double"), F.col("x").cast("double")).alias("cov"),
        F.min("y").alias("y0"),
        F.min("x").alias("x0"),
        F.max("y").alias("y1"),
        F.max("x").alias("x1"),
    )
    cols = region_columns(*[F.col(c) for c in ("n", "cy", "cx", "vy", "vx", "cov", "y0", "x0", "y1", "x1")])
    return g.select(*keys, "label", *[c.alias(n) for n, c in cols.items()])


def drop_small_and_border(labels: DataFrame, keys: Sequence[str], min_size: int, buffer: int | None) -> DataFrame:
    """Set labels to 0 that are smaller than ``min_size`` or come within ``buffer`` of the image edge."""
    shape = labels.groupBy(*keys).agg(F.max("y").alias("__h"), F.max("x").alias("__w"))
    boxes = labels.where("label > 0").groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("__n"),
        F.min("y").alias("__y0"), F.min("x").alias("__x0"),
        F.max("y").alias("__y1"), F.max("x").alias("__x1"),
    )
    ok = F.col("__n") >= min_size
    if buffer is not None:
        ok = ok & (F.col("__y0") > buffer) & (F.col("__x0") > buffer) & (
            F.col("__y1") < F.col("__h") - buffer
        ) & (F.col("__x1") < F.col("__w") - buffer)
    kept = boxes.join(shape, list(keys)).where(ok).select(*keys, "label", F.lit(True).alias("__keep"))
    return labels.join(kept, [*keys, "label"], "left").withColumn(
        "label", F.when(F.col("__keep"), F.col("label")).otherwise(F.lit(0))
    ).select(*labels.columns)


def intensity(labels: DataFrame, pixels: DataFrame, keys: Sequence[str], extra: Sequence[str] = (),
              spread: bool | None = None) -> DataFrame:
    """Mean, median, population sd and sum of ``v`` per object (and ``extra``, e.g. channel)."""
    inside = labels.where("label > 0").join(pixels, [*keys, "y", "x"])
    by = [*keys, "label", *extra]
    stats = inside.groupBy(*by).agg(
        F.avg(F.col("v").cast("double")).alias("mean"),
        F.stddev_pop(F.col("v").cast("double")).alias("std"),
        F.sum(F.col("v").cast("double")).alias("sum"),
    )
    med = quantiles(inside.select(*by, F.col("v").cast("double").alias("v")), by, "v", {"median": 0.5}, spread)
    return stats.join(med, by)


def boundary_pixels(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Object pixels with a 4-neighbour outside the object; the image edge counts as outside."""
    row, col = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    inner = F.lit(True)
    for w in (row, col):
        for f in (F.lag, F.lead):
            inner = inner & (F.coalesce(f("label").over(w), F.lit(-1)) == F.col("label"))
    return labels.withColumn("__in", inner).where("label > 0 and not __in").drop("__in")


def boundary_stats(labels: DataFrame, pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    ring = boundary_pixels(labels, keys).join(pixels, [*keys, "y", "x"])
    v = F.col("v").cast("double")
    return ring.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("edge_px"), F.avg(v).alias("edge_mean"), F.stddev_pop(v).alias("edge_std")
    ).withColumn("edge_cv", F.try_divide(F.col("edge_std"), F.nullif(F.col("edge_mean"), F.lit(0.0))))


def coarsen(pixels: DataFrame, keys: Sequence[str], factor: int) -> DataFrame:
    """Block means after cropping to a multiple of ``factor``."""
    shape = pixels.groupBy(*keys).agg((F.max("y") + 1).alias("__h"), (F.max("x") + 1).alias("__w"))
    inside = pixels.join(shape, list(keys)).where(
        f"y < __h - __h % {factor} and x < __w - __w % {factor}"
    )
    return inside.groupBy(
        *keys, F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")
    ).agg(F.avg(F.col("v").cast("double")).alias("v"))


def project_z(pixels: DataFrame, keys: Sequence[str], how: str = "max", z: str = "z") -> DataFrame:
    """Reduce the z axis by maximum, mean, or the middle plane."""
    v = F.col("v").cast("double")
    if how == "middle":
        planes = pixels.groupBy(*keys).agg(F.floor((F.max(z) + 1) / 2).cast("int").alias("__mid"))
        return pixels.join(planes, list(keys)).where(F.col(z) == F.col("__mid")).select(*keys, "y", "x", v.alias("v"))
    agg = F.max(v) if how == "max" else F.avg(v)
    return pixels.groupBy(*keys, "y", "x").agg(agg.alias("v"))


def mean_field(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean image over all scenes (pixels outside the smallest scene should be cropped first)."""
    return pixels.groupBy(*keys, "y", "x").agg(F.avg(F.col("v").cast("double")).alias("field"))


def apply_field(pixels: DataFrame, field: DataFrame, keys: Sequence[str], operation: str = "divide",
                offset: float = 0.0) -> DataFrame:
    """Correct pixels with a field: subtract it, or divide by the field over its mean (at least 0.001)."""
    if operation == "subtract":
        return pixels.join(field, [*keys, "y", "x"]).withColumn("v", F.col("v") - F.col("field")).drop("field")
    mean = field.groupBy(*keys).agg(F.avg("field").alias("__mean")) if keys else field.agg(F.avg("field").alias("__mean"))
    gain = field.join(mean, list(keys)) if keys else field.crossJoin(F.broadcast(mean))  # one row
    gain = gain.select(*keys, "y", "x", F.greatest(F.col("field") / F.col("__mean"), F.lit(1e-3)).alias("__gain"))
    return pixels.join(gain, [*keys, "y", "x"]).withColumn("v", (F.col("v") - offset) / F.col("__gain")).drop("__gain")


def normalise_percentiles(pixels: DataFrame, keys: Sequence[str], low: float, high: float,
                          spread: bool | None = None) -> DataFrame:
    """(v - P_low) / (P_high - P_low) clipped to [0, 1]; a flat range falls back to the maximum, then to one."""
    q = quantiles(pixels, keys, "v", {"__lo": low / 100, "__hi": high / 100}, spread)
    top = pixels.groupBy(*keys).agg(F.max("v").cast("double").alias("__mx"))
    q = q.join(top, list(keys)).withColumn(
        "__hi", F.when(F.col("__hi") > F.col("__lo"), F.col("__hi"))
        .when(F.col("__mx") > F.col("__lo"), F.col("__mx")).otherwise(F.col("__lo") + 1)
    )
    scaled = (F.col("v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    return pixels.join(q, list(keys)).withColumn("v", F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))).drop(
        "__lo", "__hi", "__mx"
    )


def bin_counts(pixels: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """(keys, bin, n, lo, hi): equal-width histogram between minimum and maximum."""
    v = F.col("v").cast("double")
    ends = pixels.groupBy(*keys).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    at = F.least(F.floor((v - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return pixels.join(ends, list(keys)).groupBy(
        *keys, "lo", "hi", F.coalesce(at, F.lit(0)).cast("int").alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))


def otsu_from_bins(hist: DataFrame, keys: Sequence[str], bins: int = 256) -> DataFrame:
    """Threshold per image: the centre of the bin that best separates two classes, lowest on ties.

    A window partition is one histogram, so at most ``bins`` rows.
    """
    centre = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    h = hist.withColumn("__c", centre)
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    h = h.select(
        *keys, "bin", "__c",
        F.sum("n").over(upto).alias("__w1"),
        F.sum(F.col("n") * F.col("__c")).over(upto).alias("__s1"),
        F.sum("n").over(whole).alias("__w"),
        F.sum(F.col("n") * F.col("__c")).over(whole).alias("__s"),
    )
    w2, s2 = F.col("__w") - F.col("__w1"), F.col("__s") - F.col("__s1")
    gap = F.try_divide(F.col("__s1"), F.col("__w1")) - F.try_divide(s2, w2)
    var = F.col("__w1").cast("double") * w2 * gap * gap
    scored = h.withColumn("__v", F.coalesce(F.round(var, 9), F.lit(0.0)))
    return scored.groupBy(*keys).agg(F.max_by("__c", F.struct("__v", -F.col("bin"))).alias("threshold"))


def frame_pairs(frames: DataFrame, keys: Sequence[str], time: str, levels: int = 1) -> DataFrame:
    """(keys, t, t_prev, level): each available frame with the ``levels`` frames before it.

    The window is over the frames of one series, not over its pixels.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    out = frames.select(*keys, time).distinct().withColumn("__p", F.row_number().over(w))
    older = out.select(*keys, F.col(time).alias(f"{time}_prev"), F.col("__p").alias("__q"))
    asked = out.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn(
        "__q", F.col("__p") - F.col("level") - 1
    )
    return asked.join(older, [*keys, "__q"]).select(*keys, time, f"{time}_prev", "level")


def frame_overlaps(labels: DataFrame, keys: Sequence[str], time: str, pairs: DataFrame) -> DataFrame:
    """Shared pixels, areas, IoU and share of the newer object for overlapping objects of frame pairs."""
    areas = labels.where("label > 0").groupBy(*keys, time, "label").agg(F.count(F.lit(1)).alias("area"))
    cur = labels.where("label > 0").select(*keys, time, "y", "x", F.col("label").alias("b"))
    old = cur.select(*keys, F.col(time).alias(f"{time}_prev"), "y", "x", F.col("b").alias("a"))
    shared = (
        cur.join(pairs, [*keys, time])
        .join(old, [*keys, f"{time}_prev", "y", "x"])
        .groupBy(*keys, time, f"{time}_prev", "level", "a", "b")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    area_a = areas.select(*keys, F.col(time).alias(f"{time}_prev"), F.col("label").alias("a"), F.col("area").alias("area_a"))
    area_b = areas.select(*keys, time, F.col("label").alias("b"), F.col("area").alias("area_b"))
    return (
        shared.join(area_a, [*keys, f"{time}_prev", "a"])
        .join(area_b, [*keys, time, "b"])
        .withColumn("iou", F.col("shared") / (F.col("area_a") + F.col("area_b") - F.col("shared")))
        .withColumn("share_b", F.col("shared") / F.col("area_b"))
    )


def nearest_neighbour(points: DataFrame, keys: Sequence[str], ident: str, first_cell: float = 8.0) -> DataFrame:
    """Exact distance to the nearest other point of the same image, NULL when it is alone.

    Points are hashed into square cells and compared with the 3 x 3 cells around them.  A
    hit no farther than the cell size is final; the rest go on with cells four times as
    wide.  Points found are cut per round, and only unfinished points take part again, so
    the number of compared pairs stays near the number of points.  A point without a place or name has no distance and is
    nobody's neighbour, and points of one name are not neighbours.
    """
    from tessera.session import cut

    pts = points.select(*keys, ident, F.col("centroid_y").alias("py"), F.col("centroid_x").alias("px"))
    # NaN counts as larger than any number
    placed = F.coalesce((F.abs("py") < float("inf")) & (F.abs("px") < float("inf")) & F.col(ident).isNotNull(), F.lit(False))
    nowhere = pts.where(~placed).select(*keys, ident, F.lit(None).cast("double").alias("distance"))
    pts = pts.where(placed)
    alone = pts.groupBy(*keys).agg((F.min(ident) != F.max(ident)).alias("__others"))
    pts = cut(pts.join(alone, list(keys)))
    todo = pts.where("__others")
    done, size = pts.where("not __others").select(*keys, ident, F.lit(None).cast("double").alias("distance")).unionByName(nowhere), first_cell
    while not todo.isEmpty():  # ends: some cell size covers the image
        gy, gx = F.floor(F.col("py") / size), F.floor(F.col("px") / size)
        around = F.sequence(F.lit(-1), F.lit(1))
        asking = (
            todo.withColumn("__gy", gy).withColumn("__gx", gx)
            .withColumn("__dy", F.explode(around)).withColumn("__dx", F.explode(around))
            .select(*keys, ident, "py", "px", (F.col("__gy") + F.col("__dy")).alias("__gy"),
                    (F.col("__gx") + F.col("__dx")).alias("__gx"))
        )
        there = pts.select(*keys, F.col(ident).alias("__o"), F.col("py").alias("qy"), F.col("px").alias("qx"),
                           gy.alias("__gy"), gx.alias("__gx"))
        d2 = (F.col("py") - F.col("qy")) ** 2 + (F.col("px") - F.col("qx")) ** 2
        best = (
            asking.join(there, [*keys, "__gy", "__gx"]).where(F.col("__o") != F.col(ident))
            .groupBy(*keys, ident).agg(F.sqrt(F.min(d2)).alias("distance"))
        )
        found = cut(best.where(F.col("distance") <= size))
        done = done.unionByName(found)
        todo = cut(todo.join(found, [*keys, ident], "left_anti"))
        size *= 4
    return done
