"""One row per object: shape, outline, intensity, surroundings.

Every measure is a small per-tile reduction followed by a Spark aggregation per object.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tessera.functions import text
from tessera.operators import kernels as k
from tessera.operators import pixels as px
from tessera.operators import segment as sg
from tessera.operators.prefix import quantiles_of_counts
from tessera.operators.tiles import Tiles, gather
from tessera.session import cut


def unique_names(names: Sequence[str], n: int) -> list[str]:
    """One distinct name per channel: missing ones are ch<i>, repeated ones get _ch<i>."""
    out = [str(c) for c in names][:n] + [f"ch{i}" for i in range(len(names), n)]
    return [c if out.count(c) == 1 else f"{c}_ch{i}" for i, c in enumerate(out)]


# ---------------------------------------------------------------- intensity


def _moments_of(labels: np.ndarray, values: np.ndarray) -> pd.DataFrame:
    """n, mean, squared deviations and median per label of one tile."""
    order = np.lexsort((values, labels))
    lab, v = labels[order], values[order]
    u, first, n = np.unique(lab, return_index=True, return_counts=True)
    group = np.repeat(np.arange(len(u)), n)
    mean = np.bincount(group, weights=v, minlength=len(u)) / np.maximum(n, 1)
    dev = np.bincount(group, weights=(v - mean[group]) ** 2, minlength=len(u))
    low, high = first + (n - 1) // 2, first + n // 2
    median = (v[low] + v[high]) / 2 if len(v) else np.zeros(0)
    return pd.DataFrame({"label": u, "n": n, "mean": mean, "dev": dev, "median": median})


_MOMENTS = "label bigint, channel string, n bigint, mean double, dev double, median double"


def _pooled(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tile moments of the same object put together."""
    n, m = F.col("n"), F.col("mean")
    g = parts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum(n * m).alias("sum"), F.sum(F.col("dev") + n * m * m).alias("__q"),
        F.max("dev").alias("__dev"), F.count(F.lit(1)).alias("tiles"), F.max("median").alias("median"),
    )
    mean = F.col("sum") / F.col("n")
    dev = F.when(F.col("tiles") == 1, F.col("__dev")).otherwise(F.greatest(F.col("__q") - F.col("n") * mean * mean, F.lit(0.0)))
    return g.withColumn("mean", mean).withColumn("std", F.sqrt(dev / F.col("n"))).drop("__q", "__dev")


def channel_stats(t: Tiles, labels: str, channels: Mapping[str, str]) -> DataFrame:
    """(keys, label, channel, n, mean, std, sum, median) for channel name -> layer.

    An object inside one tile is finished there.  Only objects that lie in several tiles
    send their values (counted per tile) for an exact median.
    """
    inputs = [labels, *channels.values()]

    def moments(b):
        parts = []
        for name, layer in channels.items():
            v = b[layer].astype(float)
            inside = (b[labels] > 0) & ~np.isnan(v)
            parts.append(_moments_of(b[labels][inside], v[inside]).assign(channel=name))
        return {c: pd.concat(parts)[c].tolist() for c in ("label", "channel", "n", "mean", "dev", "median")}

    keys = [*t.keys, "label", "channel"]
    out = _pooled(t.rows(inputs, _MOMENTS, moments), keys)
    if t.single:
        return out.drop("tiles")
    out = cut(out)
    split = out.where("tiles > 1").select(*t.keys, "label").distinct()
    # the labels of one image that cross tile borders: a small part of its objects
    lists = split.groupBy(*t.keys).agg(F.collect_list("label").alias("split_labels"))

    def values(b):
        lab = b[labels]
        inside = np.isin(lab, b.split_labels)
        rows = {"label": [], "channel": [], "value": [], "cnt": []}
        for name, layer in channels.items():
            pair = pd.DataFrame({"l": lab[inside], "v": b[layer][inside].astype(float)})
            n = pair.groupby(["l", "v"]).size()
            rows["label"] += n.index.get_level_values(0).tolist()
            rows["value"] += n.index.get_level_values(1).tolist()
            rows["cnt"] += n.tolist()
            rows["channel"] += [name] * len(n)
        return rows

    shared = t.with_scalar(lists).rows(inputs, "label bigint, channel string, value double, cnt bigint", values, per_image=["split_labels"])
    counts = shared.groupBy(*keys, "value").agg(F.sum("cnt").alias("cnt"))
    exact = quantiles_of_counts(counts, keys, "value", {"__median": 0.5})
    return out.join(exact, keys, "left").withColumn(
        "median", F.when(F.col("tiles") > 1, F.col("__median")).otherwise(F.col("median"))
    ).drop("__median", "tiles")


def _rim(b, labels: str, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Core labels and the mask of pixels an erosion of ``band`` steps with 4 neighbours removes."""
    pad = b.padded(labels, "constant", constant_values=0)
    core = b[labels][b.core]
    h, w = core.shape
    inner = core > 0
    for dy in range(-band, band + 1):
        for dx in range(abs(dy) - band, band - abs(dy) + 1):
            inner &= pad[band + dy: band + dy + h, band + dx: band + dx + w] == core
    return core, (core > 0) & ~inner


def boundary_values(t: Tiles, labels: str, channels: Mapping[str, str], band: int = 1) -> DataFrame:
    """(keys, label, channel, value, cnt): intensities on the rim of every object."""

    def run(b):
        core, rim = _rim(b, labels, band)
        out = {"label": [], "channel": [], "value": [], "cnt": []}
        for name, layer in channels.items():
            pair = pd.DataFrame({"l": core[rim], "v": b[layer][b.core][rim].astype(float)})
            n = pair.groupby(["l", "v"]).size()
            out["label"] += n.index.get_level_values(0).tolist()
            out["value"] += n.index.get_level_values(1).tolist()
            out["cnt"] += n.tolist()
            out["channel"] += [name] * len(n)
        return out

    t = t.select(labels, *channels.values())
    parts = t.rows([labels, *channels.values()], "label bigint, channel string, value double, cnt bigint", run, halo=band)
    return parts.groupBy(*t.keys, "label", "channel", "value").agg(F.sum("cnt").alias("cnt"))


def boundary_stats(t: Tiles, labels: str, channels: Mapping[str, str], band: int = 1) -> DataFrame:
    """(keys, label, channel, edge_mean, edge_std, edge_cv)"""

    def run(b):
        core, rim = _rim(b, labels, band)
        parts = [_moments_of(core[rim], b[layer][b.core][rim].astype(float)).assign(channel=name) for name, layer in channels.items()]
        return {c: pd.concat(parts)[c].tolist() for c in ("label", "channel", "n", "mean", "dev", "median")}

    t = t.select(labels, *channels.values())
    keys = [*t.keys, "label", "channel"]
    s = _pooled(t.rows([labels, *channels.values()], _MOMENTS, run, halo=band), keys)
    return s.select(*keys, F.col("mean").alias("edge_mean"), F.col("std").alias("edge_std"),
                    F.try_divide(F.col("std"), F.col("mean")).alias("edge_cv"))


# ---------------------------------------------------------------- outline


# Length of an outline pixel by the code of its outline neighbours.
OUTLINE_LENGTH = {
    **dict.fromkeys((5, 7, 15, 17, 25, 27), 1.0),
    **dict.fromkeys((21, 33), 2**0.5),
    **dict.fromkeys((13, 23), (1 + 2**0.5) / 2),
}


def perimeters(t: Tiles, labels: str) -> DataFrame:
    """(keys, label, perimeter_px): outline pixels weighted by how they continue."""
    table = np.zeros(50)
    for code, length in OUTLINE_LENGTH.items():
        table[code] = length

    def run(b):
        lab = b.padded(labels, "constant", constant_values=0)
        h, w = lab.shape
        same4 = np.ones((h - 2, w - 2), bool)
        mid = lab[1:-1, 1:-1]
        for dy, dx in ((0, 1), (2, 1), (1, 0), (1, 2)):
            same4 &= lab[dy: dy + h - 2, dx: dx + w - 2] == mid
        line = np.where((mid > 0) & ~same4, mid, 0)  # outline pixels, one pixel around the core
        core = line[1:-1, 1:-1]
        code = np.ones(core.shape, int)
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                if (dy, dx) != (1, 1):
                    near = line[dy: dy + core.shape[0], dx: dx + core.shape[1]] == core
                    code += np.where(near, 10 if (dy != 1 and dx != 1) else 2, 0)
        on = core > 0
        u, inv = np.unique(core[on], return_inverse=True)
        total = np.bincount(inv, weights=table[code[on]], minlength=len(u))
        return {"label": u.tolist(), "length": total.tolist()}

    return t.select(labels).rows([labels], "label bigint, length double", run, halo=2).groupBy(*t.keys, "label").agg(
        F.sum("length").alias("perimeter_px")
    )


def hull_area(rows: Sequence[int], left: Sequence[int], right: Sequence[int]) -> int:
    """Pixels whose centre lies in the hull of the edge midpoints of all object pixels."""
    y, lo, hi = (np.asarray(v, float) for v in (rows, left, right))
    pts = np.concatenate([
        np.stack([y, lo - 0.5], 1), np.stack([y, hi + 0.5], 1), np.stack([y - 0.5, lo], 1), np.stack([y + 0.5, lo], 1),
        np.stack([y - 0.5, hi], 1), np.stack([y + 0.5, hi], 1),
    ])
    pts = np.unique(pts, axis=0)

    def chain(points):
        out: list = []
        for p in points:
            while len(out) > 1 and (
                (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])
            ) <= 0:
                out.pop()
            out.append(p)
        return np.array(out)

    low, high = chain(pts.tolist()), chain([[p[0], -p[1]] for p in pts.tolist()])
    grid = np.arange(int(y.min()), int(y.max()) + 1)
    # one side of the hull bounds x from below, the mirrored one from above
    ends = [np.interp(grid, c[:, 0], c[:, 1]) for c in (low, high)]
    start, stop = ends[0], -ends[1]
    return int((np.floor(stop + 1e-9) - np.ceil(start - 1e-9) + 1).clip(0).sum())


def solidity(t: Tiles, labels: str) -> DataFrame:
    """(keys, label, convex_px): only the two ends of every image row of an object are needed."""

    def run(b):
        y, x = np.nonzero(b[labels])
        g = pd.DataFrame({"l": b[labels][y, x], "y": y + b.y0, "x": x + b.x0}).groupby(["l", "y"])["x"].agg(["min", "max"])
        return {"label": g.index.get_level_values(0).tolist(), "y": g.index.get_level_values(1).tolist(),
                "lo": g["min"].tolist(), "hi": g["max"].tolist()}

    ends = t.rows([labels], "label bigint, y int, lo int, hi int", run).groupBy(*t.keys, "label", "y").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    schema = StructType([ends.schema[c] for c in [*t.keys, "label"]] + [StructField("convex_px", LongType())])

    def hull(batches):
        for pdf in batches:
            pdf["convex_px"] = [hull_area(*r) for r in zip(pdf["y"], pdf["lo"], pdf["hi"])]
            yield pdf[schema.fieldNames()]

    # a list has one entry per image row of one object
    return gather(ends, [*t.keys, "label"], ["y", "lo", "hi"]).mapInPandas(hull, schema)


def ruggedness_of(segments: np.ndarray, smooth: float, least: float) -> float | None:
    """Length of the longest closed outline over its length after smoothing along the line."""
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for y0, x0, y1, x1 in segments.tolist():
        after.setdefault((y0, x0), []).append((y1, x1))
        after.setdefault((y1, x1), []).append((y0, x0))
    longest: list = []
    todo = set(after)
    for start in sorted(after):
        if start not in todo:
            continue
        line, here, came = [start], start, None
        todo.discard(start)
        while True:
            ways = [p for p in after[here] if p != came] or after[here]
            step = next((p for p in ways if p in todo), None)
            if step is None:
                break
            line.append(step)
            todo.discard(step)
            came, here = here, step
        line.append(start)
        if len(line) > len(longest):
            longest = line
    c = np.array(longest, float) / 2
    sigma = max(least, len(c) * smooth)
    w = k.gaussian_weights(sigma)
    r = len(w) // 2
    around = np.arange(-r, len(c) + r) % len(c)
    soft = np.stack([np.convolve(c[around, i], w, "valid") for i in (0, 1)], 1)

    def length(p):
        return float(np.sqrt((np.diff(np.vstack([p, p[:1]]), axis=0) ** 2).sum(1)).sum())

    return length(c) / length(soft) if length(soft) > 0 else None


def ruggedness(t: Tiles, labels: str, smooth: float = 0.02, least: float = 1.5) -> DataFrame:
    """(keys, label, ruggedness): the half-level outline of each object, traced and smoothed."""

    def run(b):
        lab = b.padded(labels, "constant", constant_values=0)
        # blocks of 2 x 2 pixels whose lower right pixel is in the core or just beyond it at the image edge
        y0, x0 = b.core_y - 1, b.core_x - 1
        down = b.core_h + (1 if b.core_y + b.core_h == b.height else 0)
        right = b.core_w + (1 if b.core_x + b.core_w == b.width else 0)
        corner = [lab[dy: dy + down, dx: dx + right] for dy, dx in ((0, 0), (0, 1), (1, 0), (1, 1))]
        yy, xx = np.mgrid[y0: y0 + down, x0: x0 + right]
        # midpoints of the block sides in doubled coordinates: top, left, right, bottom
        side = {"t": (2 * yy, 2 * xx + 1), "l": (2 * yy + 1, 2 * xx), "r": (2 * yy + 1, 2 * xx + 2), "b": (2 * yy + 2, 2 * xx + 1)}
        # which sides a line joins when only (or all but) these corners are inside; opposite corners stay apart
        joins = {1: ["tl"], 2: ["tr"], 4: ["lb"], 8: ["rb"], 3: ["lr"], 12: ["lr"], 5: ["tb"], 10: ["tb"],
                 9: ["tl", "rb"], 6: ["tr", "lb"], 14: ["tl"], 13: ["tr"], 11: ["lb"], 7: ["rb"]}
        out = []
        for i in range(4):
            mine = corner[i] > 0
            for j in range(i):
                mine &= corner[j] != corner[i]
            code = sum((1 << j) * (corner[j] == corner[i]) for j in range(4))
            for c, lines in joins.items():
                at = mine & (code == c)
                if at.any():
                    for a, z in lines:
                        out.append(np.stack([corner[i][at], side[a][0][at], side[a][1][at], side[z][0][at], side[z][1][at]]))
        rows = np.concatenate(out, axis=1) if out else np.zeros((5, 0), int)
        return dict(zip(("label", "ya", "xa", "yb", "xb"), (r.tolist() for r in rows)))

    lines = t.select(labels).rows([labels], "label bigint, ya int, xa int, yb int, xb int", run, halo=1)
    schema = StructType([lines.schema[c] for c in [*t.keys, "label"]] + [StructField("ruggedness", DoubleType())])

    ends = ["ya", "xa", "yb", "xb"]

    def trace(batches):
        for pdf in batches:
            pdf["ruggedness"] = [ruggedness_of(np.stack(r, 1), smooth, least) for r in zip(*[pdf[c] for c in ends])]
            yield pdf[schema.fieldNames()]

    # a list is the outline of one object
    return gather(lines, [*t.keys, "label"], ends).mapInPandas(trace, schema)


# ---------------------------------------------------------------- rings


def expand(t: Tiles, labels: str, out: str, reach: float) -> Tiles:
    """Labels grown into the background by up to ``reach`` pixels; the nearest label wins,
    the smaller one on a tie."""
    r = int(np.floor(reach))
    by_distance: dict[int, list[tuple[int, int]]] = {}
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            d2 = dy * dy + dx * dx
            if 0 < d2 <= reach * reach:
                by_distance.setdefault(d2, []).append((dy, dx))
    top = np.iinfo(np.int64).max

    def run(b):
        pad = b.padded(labels, "constant", constant_values=0) if r else b[labels]
        core = b[labels][b.core].copy()
        h, w = core.shape
        for d2 in sorted(by_distance):
            free = core == 0
            if not free.any():
                break
            best = np.full(core.shape, top)
            for dy, dx in by_distance[d2]:
                part = pad[r + dy: r + dy + h, r + dx: r + dx + w]
                best = np.minimum(best, np.where(part > 0, part, top))
            core = np.where(free & (best < top), best, core)
        return {out: core}

    return t.transform([labels], {out: sg.LABEL}, run, halo=r)


def rings(t: Tiles, nuclei: str, out: str, gap: float, width: float) -> Tiles:
    """A ring of ``width`` pixels around every nucleus, ``gap`` pixels away from it."""
    t = expand(t, nuclei, out, gap + width)
    if gap > 0:
        t = expand(t, nuclei, "__inner", gap)
        t = sg.pointwise(t, [out, "__inner"], out, sg.LABEL, lambda b: np.where(b["__inner"] > 0, 0, b[out]))
        return sg._drop(t, "__inner")
    return sg.pointwise(t, [out, nuclei], out, sg.LABEL, lambda b: np.where(b[nuclei] > 0, 0, b[out]))


# ---------------------------------------------------------------- assembly


def wide(stats: DataFrame, keys: Sequence[str], names: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Channel rows to columns ``<prefix><channel>``, with an explicit channel list."""
    aggs = [
        F.max(F.when(F.col("channel") == n, F.col(c))).alias(f"{prefix}_{n}")
        for n in names for prefix, c in columns.items()
    ]
    return stats.groupBy(*keys).agg(*aggs)


def shapes(t: Tiles, labels: str, pixel_size: str = "pixel_size_um") -> DataFrame:
    """Shape columns of the measurement table; ``t`` must carry the pixel size per image."""
    keys = [*t.keys, "label"]
    o = sg.objects(t, labels).join(perimeters(t, labels), keys).join(solidity(t, labels), keys)
    sizes = t.df.groupBy(*t.keys).agg(F.max(pixel_size).alias(pixel_size))
    ps = F.col(pixel_size)
    return o.join(sizes, list(t.keys)).select(
        *keys, ps.alias("pixel_size_um"), F.col("area_px").cast("double").alias("area_px"), (F.col("area_px") * ps * ps).alias("area_um2"),
        "perimeter_px", "eccentricity", "orientation_rad", F.degrees("orientation_rad").alias("orientation_deg"),
        F.col("major_axis_px").alias("major_axis_length_px"), F.col("minor_axis_px").alias("minor_axis_length_px"),
        (F.col("major_axis_px") * ps).alias("major_axis_length_um"), (F.col("minor_axis_px") * ps).alias("minor_axis_length_um"),
        (F.col("area_px") / F.col("convex_px")).alias("solidity"), "extent", "equivalent_diameter_px", "centroid_y", "centroid_x",
    )


FULL = {"mean": "mean", "median": "median", "std": "std", "sum": "sum"}


def measure_cells(
    t: Tiles, names: Sequence[str], layers: Sequence[str], edge_channels: Sequence[int], cells: str = "cells",
    nuclei: str | None = "nuclei", adjacency: DataFrame | None = None, nuclei_per_cell: DataFrame | None = None,
    no_nuclei: bool = False, band: int = 1, smooth: float = 0.02, least: float = 1.5,
) -> DataFrame:
    """The cell table without the scene columns; ``t`` must carry ``pixel_size_um`` per image."""
    keys = [*t.keys, "label"]
    chans = dict(zip(names, layers))
    out = shapes(t, cells).join(ruggedness(t, cells, smooth, least), keys, "left")
    out = out.join(wide(channel_stats(t, cells, chans), keys, names, FULL), keys, "left")
    if nuclei is not None:
        sizes = t.df.groupBy(*t.keys).agg(F.max("pixel_size_um").alias("__ps"))
        nuc = sg.objects(t, nuclei).join(sizes, list(t.keys)).select(
            *keys, F.col("area_px").cast("double").alias("nuc_area_px"), (F.col("area_px") * F.col("__ps") ** 2).alias("nuc_area_um2"),
            F.col("eccentricity").alias("nuc_eccentricity"), F.col("orientation_rad").alias("nuc_orientation_rad"),
        )
        stats = wide(channel_stats(t, nuclei, chans), keys, names, {f"nuc_{a}": c for a, c in FULL.items()})
        out = out.join(nuc, keys, "left").join(stats, keys, "left")
    edge_names = [names[i] for i in edge_channels if i < len(names)]
    if edge_names:
        e = boundary_stats(t, cells, {n: chans[n] for n in edge_names}, band)
        out = out.join(wide(e, keys, edge_names, {"edge_mean": "edge_mean", "edge_std": "edge_std", "edge_cv": "edge_cv"}), keys, "left")
    if adjacency is not None:
        near = px.neighbour_counts(adjacency, list(t.keys)).withColumnRenamed("cell_id", "label")
        out = out.join(near, keys, "left").withColumn("n_neighbours", F.coalesce("n_neighbours", F.lit(0)).cast("int")).withColumn(
            "neighbour_contact_um", F.coalesce("contact_px", F.lit(0)) * F.col("pixel_size_um")
        ).drop("contact_px")
    else:
        out = out.withColumn("n_neighbours", F.lit(None).cast("int")).withColumn("neighbour_contact_um", F.lit(None).cast("double"))
    if no_nuclei:
        out = out.withColumn("n_nuclei", F.lit(None).cast("int"))
    elif nuclei_per_cell is not None:
        out = out.join(nuclei_per_cell.select(*keys, "n_nuclei"), keys, "left").withColumn(
            "n_nuclei", F.coalesce("n_nuclei", F.lit(1)).cast("int")
        )
    else:
        out = out.withColumn("n_nuclei", F.lit(1))
    return out.withColumnRenamed("label", "cell_id")


def measure_nuclei(
    t: Tiles, names: Sequence[str], layers: Sequence[str], gap: float, width: float, nuclei: str = "nuclei"
) -> DataFrame:
    """The nucleus table without the scene columns: shape, intensity, ring, nearest nucleus."""
    keys = [*t.keys, "label"]
    chans = dict(zip(names, layers))
    out = shapes(t, nuclei)
    far = px.nearest_neighbour(out, list(t.keys), "label").withColumnRenamed("distance", "nearest_nucleus_px")
    out = out.join(far, keys, "left").withColumn("nearest_nucleus_um", F.col("nearest_nucleus_px") * F.col("pixel_size_um"))
    out = out.withColumn("object", F.lit("nucleus"))
    out = out.join(wide(channel_stats(t, nuclei, chans), keys, names, FULL), keys, "left")
    if width > 0:
        r = rings(t, nuclei, "__ring", gap, width)
        area = sg.label_sizes(r, "__ring").withColumnRenamed("n", "ring_area_px")
        stats = wide(channel_stats(r, "__ring", chans), keys, names, {"ring_mean": "mean", "ring_median": "median"})
        out = out.join(area, keys, "left").join(stats, keys, "left")
        out = out.withColumn("ring_area_px", F.coalesce("ring_area_px", F.lit(0)))
        for n in names:
            ratio = F.when(F.col(f"ring_mean_{n}") > 0, F.col(f"mean_{n}") / F.col(f"ring_mean_{n}"))
            out = out.withColumn(f"nuc_ring_ratio_{n}", ratio)
    return out.withColumnRenamed("label", "cell_id")


def add_scene_columns(
    measured: DataFrame, images: DataFrame, keys: Sequence[str], settings: Mapping[str, Any], summary: DataFrame | None,
) -> DataFrame:
    """Dataset, file, time, well and scene columns in front of the measures.

    ``images`` is (keys, file, frame_interval_min); in single-timepoint runs the last
    summary row of a scene counts.
    """
    well = text.parse_well(F.col("scene"), F.col("file"), settings["well_regex"], settings["well_regex_fallback"])
    meta = images.select(*keys, "file", "frame_interval_min").withColumn("__w", well)
    out = measured.join(meta, list(keys), "left")
    if summary is not None:
        have = summary.columns
        info = summary.groupBy(*keys).agg(
            F.max("confluent" if "confluent" in have else F.lit(None).cast("boolean")).alias("scene_confluent"),
            F.max("n_nuclei").cast("int").alias("scene_n_nuclei"),
        )
        out = out.join(info, list(keys), "left")
    front = [
        "dataset", "file", "scene", F.col("timepoint"),
        (F.col("timepoint") * F.nullif(F.col("frame_interval_min"), F.lit(0.0))).alias("time_min"),
        F.col("__w.row").alias("well_row"), F.col("__w.col").alias("well_column"),
        F.concat("__w.row", "__w.col").alias("well_id"),
    ]
    front += ["scene_confluent", "scene_n_nuclei"] if summary is not None else []
    front += ["cell_id", "n_nuclei", "n_neighbours", "neighbour_contact_um"] if "n_nuclei" in measured.columns else ["object", "cell_id"]
    named = {c if isinstance(c, str) else "" for c in front} | {*keys}
    return out.select(*front, *[c for c in measured.columns if c not in named])


def boundary_arrays(t: Tiles, cells: str, channels: Mapping[str, str], band: int = 1) -> DataFrame:
    """(keys, cell_id, channel, intensities): the rim values of each object, sorted.

    A list is as long as the rim of one object.
    """
    v = boundary_values(t, cells, channels, band)
    parts = v.groupBy(*t.keys, F.col("label").alias("cell_id"), "channel").agg(
        F.sort_array(F.collect_list(F.struct("value", "cnt"))).alias("__v")
    )
    return parts.select(
        *t.keys, "cell_id", "channel",
        F.flatten(F.transform("__v", lambda s: F.array_repeat(s["value"].cast("float"), s["cnt"].cast("int")))).alias("intensities"),
    )
