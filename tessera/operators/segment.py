"""From images to objects: filters, thresholds, components, floods, and their composition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import graph
from tessera.operators import kernels as k
from tessera.operators import pixels as px
from tessera.operators.prefix import quantiles_of_counts, running_below
from tessera.operators.tiles import POSITION, Tiles, gather
from tessera.session import cut

LABEL = "i8"


# ---------------------------------------------------------------- filters


def smooth(t: Tiles, layer: str, out: str, sigma: float) -> Tiles:
    """Gaussian blur (four sigmas wide, nearest pixel beyond the edge)."""
    w = k.gaussian_weights(sigma)

    def run(b):
        return {out: k.convolve_valid(k.convolve_valid(b.padded(layer, "edge"), w, 0), w, 1)}

    return t.transform([layer], {out: "f8"}, run, halo=len(w) // 2)


def box_maximum(t: Tiles, layer: str, out: str, reach: int) -> Tiles:
    def run(b):
        return {out: k.extreme_valid(b.padded(layer, "edge"), 2 * reach + 1, True)}

    return t.transform([layer], {out: "f8"}, run, halo=reach)


def gradient_surface(t: Tiles, layer: str, out: str, sigma: float) -> Tiles:
    """Sobel magnitude with its dips along thin lines closed."""
    reach = int(np.ceil(1.5 * float(sigma or 0) + 2))

    def sobel(b):
        a = b.padded(layer, "symmetric")
        side, mid = np.array([-1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])
        gy = k.convolve_valid(k.convolve_valid(a, side, 0), mid, 1)
        gx = k.convolve_valid(k.convolve_valid(a, mid, 0), side, 1)
        return {out: np.sqrt(gy * gy + gx * gx)}

    def grow(b):
        return {out: k.extreme_valid(b.padded(out, "symmetric"), 2 * reach + 1, True)}

    def shrink(b):
        return {out: k.extreme_valid(b.padded(out, "symmetric"), 2 * reach + 1, False)}

    t = t.transform([layer], {out: "f8"}, sobel, halo=1)
    t = t.transform([out], {out: "f8"}, grow, halo=reach)
    return t.transform([out], {out: "f8"}, shrink, halo=reach)


def morph(t: Tiles, layer: str, out: str, offsets: Sequence[tuple[int, int]], grow: bool, times: int = 1) -> Tiles:
    """Binary dilation or erosion; beyond the image is background."""
    reach = max(max(abs(y), abs(x)) for y, x in offsets) * times

    def run(b):
        a = b[layer].astype(bool)
        for _ in range(times):
            a = k.spread_mask(a, offsets, grow)
        return {out: a[b.core]}

    return t.transform([layer], {out: "u1"}, run, halo=reach)


def closing(t: Tiles, layer: str, out: str, offsets: Sequence[tuple[int, int]]) -> Tiles:
    return morph(morph(t, layer, out, offsets, True), out, out, offsets, False)


def pointwise(t: Tiles, inputs: Sequence[str], out: str, dtype: str, fn, per_image: Sequence[str] = ()) -> Tiles:
    """``fn(block)`` -> array, without surroundings."""
    return t.transform(list(inputs), {out: dtype}, lambda b: {out: fn(b)}, per_image=per_image)


# ---------------------------------------------------------------- thresholds


def histogram(t: Tiles, layer: str, bins: int = 256, where: str | None = None) -> DataFrame:
    """(keys, lo, hi, bin, n): counted inside each tile before the shuffle."""
    keys = list(t.keys)
    inputs = [layer] + ([where] if where else [])

    def picked(b):
        a = b[layer].astype(float)
        return a[b[where] > 0] if where else a.ravel()

    def extremes(b):
        a = picked(b)
        return {"lo": [float(a.min())], "hi": [float(a.max())]} if a.size else {"lo": [], "hi": []}

    ends = t.rows(inputs, "lo double, hi double", extremes)
    ends = ends.groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def count(b):
        n = np.bincount(bin_of(picked(b), b.lo, b.hi, bins), minlength=bins)
        hit = np.nonzero(n)[0]
        return {"lo": [b.lo] * len(hit), "hi": [b.hi] * len(hit), "bin": hit.tolist(), "n": n[hit].tolist()}

    parts = t.with_scalar(ends).rows(inputs, "lo double, hi double, bin int, n bigint", count, per_image=["lo", "hi"])
    return parts.groupBy(*keys, "lo", "hi", "bin").agg(F.sum("n").alias("n"))


def bin_of(a: np.ndarray, lo: float, hi: float, bins: int) -> np.ndarray:
    if not hi > lo:
        return np.zeros(a.size, int)
    return np.minimum(((a - lo) / (hi - lo) * bins).astype(int), bins - 1)


def otsu(t: Tiles, layer: str, bins: int = 256) -> DataFrame:
    """(keys, threshold)"""
    return px.otsu_from_bins(histogram(t, layer, bins), list(t.keys), bins)


def image_percentiles(
    t: Tiles, layer: str, probs: Mapping[str, float], where: str | None = None, bins: int = 4096
) -> DataFrame:
    """Exact percentiles of a layer per image, optionally only where another layer is set.

    A histogram tells which bins hold the wanted ranks.  Only pixels of those bins leave
    their tile as values; every other bin takes part as one row with its count.
    """
    keys = list(t.keys)
    hist = cut(histogram(t, layer, bins, where))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = hist.withColumn("__u", F.sum("n").over(upto)).withColumn("__n", F.sum("n").over(Window.partitionBy(*keys)))
    wanted = F.lit(False)
    for p in probs.values():
        at = (F.col("__n") - 1) * F.lit(float(p))
        for rank in (F.floor(at), F.ceil(at)):
            wanted = wanted | ((rank < F.col("__u")) & (rank >= F.col("__u") - F.col("n")))
    ranked = ranked.withColumn("__hit", wanted)
    hits = ranked.where("__hit").groupBy(*keys, "lo", "hi").agg(F.collect_list("bin").alias("hit_bins"))

    def values(b):
        a = b[layer].astype(float)
        a = a[b[where] > 0] if where else a.ravel()
        v, n = np.unique(a[np.isin(bin_of(a, b.lo, b.hi, bins), b.hit_bins)], return_counts=True)
        return {"value": v.tolist(), "cnt": n.tolist()}

    inputs = [layer] + ([where] if where else [])
    exact = t.with_scalar(hits).rows(inputs, "value double, cnt bigint", values, per_image=["lo", "hi", "hit_bins"])
    exact = exact.groupBy(*keys, "value").agg(F.sum("cnt").alias("cnt"))
    middle = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    rest = ranked.where("not __hit").select(*keys, middle.alias("value"), F.col("n").alias("cnt"))
    counts = exact.unionByName(rest).groupBy(*keys, "value").agg(F.sum("cnt").alias("cnt"))
    return quantiles_of_counts(counts, keys, "value", probs)


# ---------------------------------------------------------------- components


def components(t: Tiles, layer: str, out: str, eight: bool = False, inverse: bool = False) -> Tiles:
    """Connected components of a mask; a component carries its first pixel's index plus one."""

    def local(b):
        mask = (b[layer] > 0) != inverse
        first = k.components(mask, eight)
        where = b.positions().ravel()
        return {out: np.where(first >= 0, where[np.maximum(first, 0)], 0)}

    # callers count, join and relabel what comes next: three reads of one written table
    t = t.transform([layer], {out: LABEL}, local).cut()
    if t.single:
        return t

    def seams(b):
        lab = b[out]
        cy, cx = b.core
        a_all, b_all = [], []
        inside = np.zeros(lab.shape, bool)
        inside[cy, cx] = True
        for p, q in k.shifted_pairs(lab.shape, k.EIGHT if eight else k.FOUR):
            cross = (inside[p] != inside[q]) & (lab[p] > 0) & (lab[q] > 0)
            a_all.append(lab[p][cross])
            b_all.append(lab[q][cross])
        pairs = np.unique(np.stack([np.concatenate(a_all), np.concatenate(b_all)]), axis=1)
        return {"a": pairs[0].tolist(), "b": pairs[1].tolist()}

    edges = t.select(out).rows([out], "a bigint, b bigint", seams, halo=1)
    roots = graph.connected(edges, t.keys).select(*t.keys, F.col("node").alias("label"), F.col("root").alias("new"))
    return t.relabel(out, roots).cut()


def label_sizes(t: Tiles, layer: str) -> DataFrame:
    """(keys, label, n) of non-zero labels."""

    def run(b):
        v, n = np.unique(b[layer], return_counts=True)
        ok = v > 0
        return {"label": v[ok].tolist(), "n": n[ok].tolist()}

    return t.rows([layer], "label bigint, n bigint", run).groupBy(*t.keys, "label").agg(F.sum("n").alias("n"))


def number(t: Tiles, layer: str) -> Tiles:
    """Labels 1..N per image in the order of their old values."""
    ids = label_sizes(t, layer).select(*t.keys, "label", F.lit(1).cast("bigint").alias("cnt"))
    ranked = running_below(ids, list(t.keys), "label")
    return t.relabel(layer, ranked.select(*t.keys, "label", (F.col("cnt_below") + 1).alias("new")))


def keep_labels(t: Tiles, layer: str, kept: DataFrame) -> Tiles:
    """Labels in ``kept`` (keys, label) stay, all others become background."""
    return t.relabel(layer, kept.select(*t.keys, "label", F.col("label").alias("new")), missing="zero")


def remove_small_objects(t: Tiles, layer: str, size: int) -> Tiles:
    """Objects of a mask with fewer than ``size`` pixels become background."""
    t = components(t, layer, "__c")
    t = keep_labels(t, "__c", label_sizes(t, "__c").where(F.col("n") >= size))
    return _drop(pointwise(t, ["__c"], layer, "u1", lambda b: b["__c"] > 0), "__c")


def remove_small_holes(t: Tiles, layer: str, size: int) -> Tiles:
    """Background areas with fewer than ``size`` pixels become foreground."""
    t = components(t, layer, "__c", inverse=True)
    t = keep_labels(t, "__c", label_sizes(t, "__c").where(F.col("n") >= size))
    return _drop(pointwise(t, ["__c"], layer, "u1", lambda b: b["__c"] == 0), "__c")


def fill_holes(t: Tiles, layer: str) -> Tiles:
    """Background that does not reach the image edge becomes foreground."""
    t = components(t, layer, "__c", inverse=True)

    def outside(b):
        y = np.arange(b.core_y, b.core_y + b.core_h)[:, None]
        x = np.arange(b.core_x, b.core_x + b.core_w)[None, :]
        edge = (y == 0) | (x == 0) | (y == b.height - 1) | (x == b.width - 1)
        v = np.unique(b["__c"][edge])
        return {"label": v[v > 0].tolist()}

    t = keep_labels(t, "__c", t.rows(["__c"], "label bigint", outside).distinct())
    return _drop(pointwise(t, ["__c"], layer, "u1", lambda b: b["__c"] == 0), "__c")


def _drop(t: Tiles, *layers: str) -> Tiles:
    return t.select(*[n for n in t.layers if n not in layers])


# ---------------------------------------------------------------- distance, peaks, floods


def distance(t: Tiles, mask: str, out: str) -> Tiles:
    """Exact Euclidean distance to the background, by columns and then by rows."""

    def down(m):
        return np.minimum(k.column_distances(m > 0), 1 << 20)

    t = t.strips(mask, out, LABEL, down, along="y")
    return t.strips(out, out, "f8", lambda g: np.sqrt(k.row_envelope(g * g)), along="x")


def peaks(t: Tiles, value: str, mask: str, out: str, reach: int) -> Tiles:
    """Local maxima at least ``reach`` apart and away from the edge, numbered in raster order."""

    def candidates(b):
        v = b.padded(value, "constant", constant_values=-np.inf)
        top = k.extreme_valid(v, 2 * reach + 1, True)
        core = b[value][b.core]
        y = np.arange(b.core_y, b.core_y + b.core_h)[:, None]
        x = np.arange(b.core_x, b.core_x + b.core_w)[None, :]
        clear = (y >= reach) & (x >= reach) & (y < b.height - reach) & (x < b.width - reach)
        ok = (core == top) & (core > 0) & (b[mask][b.core] > 0) & clear
        return {"__state": np.where(ok, 0, 3)}

    def space(b):
        before = b["__state"][b.core].copy()
        after = k.settle_peaks(b[value], b["__state"], b.positions(), reach, b.core)[b.core]
        return {"__state": after, "changed": int((after != before).sum())}

    def spaced(t):
        t = t.transform([value, mask], {"__state": "u1"}, candidates, halo=reach)
        t = t.repeat([value, "__state"], {"__state": "u1"}, space, halo=reach)
        return _drop(pointwise(t, ["__state"], out, LABEL, lambda b: np.where(b["__state"] == 1, b.positions(), 0)), "__state")

    return number(t.in_blocks(spaced).cut(), out)


def watershed(t: Tiles, surface: str, markers: str, out: str, mask: str | None = None) -> Tiles:
    """Flood ``surface`` from the markers inside the mask (4 neighbours).

    A pixel goes to the flood that reaches it at the lowest level, then in the fewest steps
    at that level, then with the smaller label, which does not depend on tile borders.
    """
    big = np.iinfo(np.int64).max // 2
    inputs = [surface, markers] + ([mask] if mask else [])

    def start(b):
        inside = b[mask] > 0 if mask else np.ones(b[surface].shape, bool)
        seeded = (b[markers] > 0) & inside
        return {
            "__in": inside,
            "__level": np.where(seeded, b[surface], np.inf),
            "__steps": np.where(seeded, 0, big),
            out: np.where(seeded, b[markers], 0),
        }

    def rise(b):
        level, steps = b["__level"], b["__steps"]
        before = level[b.core].copy(), steps[b.core].copy()
        level, steps = k.settle_levels(b[surface], b["__in"] > 0, level, steps)
        level, steps = level[b.core], steps[b.core]
        return {"__level": level, "__steps": steps,
                "changed": int(((level != before[0]) | (steps != before[1])).sum())}

    def colour(b):
        ring = np.ones(b[out].shape, bool)
        ring[b.core] = False
        fixed = ring | (b[markers] > 0)
        after = k.settle_labels(b["__level"], b["__steps"], fixed, b[out])[b.core]
        return {out: after, "changed": int((after != b[out][b.core]).sum())}

    def flooded(t):
        t = t.transform(inputs, {"__in": "u1", "__level": "f8", "__steps": LABEL, out: LABEL}, start)
        t = t.repeat([surface, "__in", "__level", "__steps"], {"__level": "f8", "__steps": LABEL}, rise)
        t = t.repeat(["__level", "__steps", markers, out], {out: LABEL}, colour)
        return _drop(t, "__in", "__level", "__steps")

    return t.in_blocks(flooded)


def deep_minima(t: Tiles, layer: str, out: str, depth: DataFrame) -> Tiles:
    """Mask of minima at least ``depth`` (keys, depth) deep, with 8 neighbours."""

    def sink(b):
        before = b["__fill"][b.core].copy()
        after = k.settle_fill(b[layer], b["__fill"])[b.core]
        return {"__fill": after, "changed": int((after != before).sum())}

    def deep(b):
        # a sum and a difference of rounded numbers are off by less than this
        v = b[layer].astype(float)
        return (b["__fill"] - v) >= b.depth - 1e-15 * (np.abs(v) + b.depth)

    def filled(t):
        t = t.with_scalar(depth)
        t = t.transform([layer], {"__fill": "f8"}, lambda b: {"__fill": b[layer].astype(float) + b.depth}, per_image=["depth"])
        t = t.repeat([layer, "__fill"], {"__fill": "f8"}, sink).with_scalar(depth)
        return _drop(pointwise(t, [layer, "__fill"], out, "u1", deep, per_image=["depth"]), "__fill")

    return t.in_blocks(filled)


# ---------------------------------------------------------------- label image tables


def contacts(t: Tiles, labels: str, value: str | None = None) -> DataFrame:
    """Touching pairs with the number of shared pixel edges and the mean value across them."""
    inputs = [labels] + ([value] if value else [])

    def run(b):
        lab, cy, cx = b[labels], *b.core
        own = np.zeros(lab.shape, bool)
        own[cy, cx] = True
        a_all, b_all, e_all = [], [], []
        for p, q in k.shifted_pairs(lab.shape, k.FOUR):
            # an edge belongs to the tile of its upper or left pixel
            m = own[p] & (lab[p] > 0) & (lab[q] > 0) & (lab[p] != lab[q])
            a_all.append(np.minimum(lab[p][m], lab[q][m]))
            b_all.append(np.maximum(lab[p][m], lab[q][m]))
            e_all.append((b[value][p][m].astype(float) + b[value][q][m]) / 2 if value else np.zeros(int(m.sum())))
        pair = np.stack([np.concatenate(a_all), np.concatenate(b_all)])
        uniq, inv, n = np.unique(pair, axis=1, return_inverse=True, return_counts=True)
        total = np.bincount(inv.ravel(), weights=np.concatenate(e_all), minlength=uniq.shape[1])
        return {"a": uniq[0].tolist(), "b": uniq[1].tolist(), "n": n.tolist(), "e": total.tolist()}

    parts = t.select(*inputs).rows(inputs, "a bigint, b bigint, n bigint, e double", run, halo=1)
    mean = F.sum("e") / F.sum("n") if value else F.lit(None).cast("double")
    return parts.groupBy(*t.keys, F.col("a").alias("cell_id_a"), F.col("b").alias("cell_id_b")).agg(
        F.sum("n").alias("contact_px"), mean.alias("junction_intensity")
    )


def objects(t: Tiles, labels: str) -> DataFrame:
    """(keys, label, shape columns) from sums of coordinates per tile."""

    def run(b):
        lab = b[labels]
        y, x = np.nonzero(lab)
        v = lab[y, x]
        u, inv, n = np.unique(v, return_inverse=True, return_counts=True)
        gy, gx = (y + b.y0).astype(float), (x + b.x0).astype(float)

        def total(w):
            return np.bincount(inv, weights=w, minlength=len(u)).tolist()

        lo_y, lo_x = np.full(len(u), b.height), np.full(len(u), b.width)
        hi_y, hi_x = np.full(len(u), -1), np.full(len(u), -1)
        np.minimum.at(lo_y, inv, y + b.y0)
        np.minimum.at(lo_x, inv, x + b.x0)
        np.maximum.at(hi_y, inv, y + b.y0)
        np.maximum.at(hi_x, inv, x + b.x0)
        return {
            "label": u.tolist(), "n": n.tolist(), "sy": total(gy), "sx": total(gx), "syy": total(gy * gy),
            "sxx": total(gx * gx), "sxy": total(gy * gx), "y0": lo_y.tolist(), "x0": lo_x.tolist(),
            "y1": hi_y.tolist(), "x1": hi_x.tolist(), "h": [b.height] * len(u), "w": [b.width] * len(u),
        }

    schema = ("label bigint, n bigint, sy double, sx double, syy double, sxx double, sxy double, "
              "y0 int, x0 int, y1 int, x1 int, h int, w int")
    g = t.rows([labels], schema, run).groupBy(*t.keys, "label").agg(
        *[F.sum(c).alias(c) for c in ("n", "sy", "sx", "syy", "sxx", "sxy")],
        *[F.min(c).alias(c) for c in ("y0", "x0")], *[F.max(c).alias(c) for c in ("y1", "x1", "h", "w")],
    )
    n, cy, cx = F.col("n"), F.col("sy") / F.col("n"), F.col("sx") / F.col("n")
    vy = F.greatest(F.col("syy") / n - cy * cy, F.lit(0.0))
    vx = F.greatest(F.col("sxx") / n - cx * cx, F.lit(0.0))
    cols = px.region_columns(n, cy, cx, vy, vx, F.col("sxy") / n - cy * cx, *[F.col(c) for c in ("y0", "x0", "y1", "x1")])
    edge = F.least("y0", "x0", F.col("h") - 1 - F.col("y1"), F.col("w") - 1 - F.col("x1"))
    return g.select(*t.keys, "label", *[c.alias(name) for name, c in cols.items()], edge.alias("edge_distance"))


def finish_cells(t: Tiles, labels: str, min_size: int, border: int | None) -> Tiles:
    """Drop labels below ``min_size`` pixels or within ``border`` pixels of the image edge."""
    ok = F.col("area_px") >= min_size
    if border is not None:
        ok = ok & (F.col("edge_distance") > border)
    return keep_labels(t, labels, objects(t, labels).where(ok))


# ---------------------------------------------------------------- merging over weak junctions


def _pair_table(t: Tiles, labels: str, edge: str, band: int) -> DataFrame:
    e = box_maximum(t.select(labels, edge), edge, "__e", band) if band > 0 else t.select(labels, edge)
    return contacts(e, labels, "__e" if band > 0 else edge)


def _contrast(t: Tiles, pairs: DataFrame, edge: str, where: str, reference: DataFrame) -> DataFrame:
    """Pairs with (mean - baseline) / (reference - baseline), only where reference > baseline."""
    keys = list(t.keys)
    low = image_percentiles(t, edge, {"base": 0.5}, where=where)
    any_low = image_percentiles(t, edge, {"fallback": 0.05})
    levels = reference.join(any_low, keys).join(low, keys, "left").withColumn("base", F.coalesce("base", "fallback"))
    return (
        pairs.join(levels.where("reference > base"), keys)
        .withColumn("contrast", (F.col("junction_intensity") - F.col("base")) / (F.col("reference") - F.col("base")))
    )


def merge_multinucleated(
    t: Tiles, cells: str, nuclei: str, edge: str, nuclei_mask: str, max_distance: float = 0.0, ratio: float = 0.5,
    max_nuclei: int = 2, band: int = 2, min_boundary: int = 5,
) -> tuple[Tiles, DataFrame, DataFrame]:
    """Merge touching cells without a junction between them whose nuclei are close.

    Returns the tiles with both label layers remapped, the accepted pairs, and
    (keys, label, n_nuclei) of merged cells.
    """
    keys = list(t.keys)
    shapes = objects(t, nuclei)
    pairs = _pair_table(t, cells, edge, band).where(F.col("contact_px") >= min_boundary)
    from tessera.operators.prefix import quantiles

    reference = quantiles(pairs, keys, "junction_intensity", {"reference": 0.5})
    scored = _contrast(t, pairs, edge, nuclei_mask, reference)
    if max_distance and max_distance > 0:
        limit = shapes.select(*keys).distinct().withColumn("limit", F.lit(float(max_distance)))
    else:
        limit = quantiles(shapes, keys, "equivalent_diameter_px", {"d": 0.5}).select(*keys, (2 * F.col("d")).alias("limit"))

    def end(name):
        return shapes.select(*keys, F.col("label").alias(f"cell_id_{name}"), F.col("centroid_y").alias(f"y_{name}"),
                             F.col("centroid_x").alias(f"x_{name}"))

    apart = F.sqrt((F.col("y_a") - F.col("y_b")) ** 2 + (F.col("x_a") - F.col("x_b")) ** 2)
    candidates = (
        scored.join(end("a"), [*keys, "cell_id_a"]).join(end("b"), [*keys, "cell_id_b"]).join(limit, keys)
        .where((F.col("contrast") < ratio) & (apart <= F.col("limit")))
        .select(*keys, F.col("cell_id_a").alias("a"), F.col("cell_id_b").alias("b"), F.col("contrast").alias("weight"))
    )
    nodes = shapes.select(*keys, F.col("label").alias("node"), F.lit(1).cast("bigint").alias("load"))
    roots, taken = graph.merge_weakest_first(candidates, nodes, keys, F.lit(max_nuclei))
    mapping = roots.select(*keys, F.col("node").alias("label"), F.col("root").alias("new"))
    merged = roots.groupBy(*keys, F.col("root").alias("label")).agg(F.count(F.lit(1)).alias("n_nuclei")).where("n_nuclei > 1")
    return t.relabel(cells, mapping).relabel(nuclei, mapping), taken, merged


def merge_without_junction(
    t: Tiles, labels: str, edge: str, markers: str, ratio: float = 0.4, max_area: int = 160000, band: int = 2,
    min_boundary: int = 5,
) -> tuple[Tiles, DataFrame]:
    """Merge regions over weak boundaries, weakest first, never beyond ``max_area`` pixels."""
    keys = list(t.keys)
    pairs = _pair_table(t, labels, edge, band).where(F.col("contact_px") >= min_boundary)
    # length-weighted 90th percentile: the first mean whose boundaries reach nine tenths
    lengths = pairs.groupBy(*keys, F.col("junction_intensity").alias("value")).agg(F.sum("contact_px").alias("len"))
    reach = running_below(lengths, keys, "value", ["len"]).where(
        F.col("len_below") + F.col("len") >= 0.9 * F.col("len_total")
    )
    reference = reach.groupBy(*keys).agg(F.min("value").alias("reference"))
    scored = _contrast(t, pairs, edge, markers, reference).where(F.col("contrast") < ratio)
    edges = scored.select(*keys, F.col("cell_id_a").alias("a"), F.col("cell_id_b").alias("b"), F.col("contrast").alias("weight"))
    nodes = label_sizes(t, labels).select(*keys, F.col("label").alias("node"), F.col("n").alias("load"))
    roots, taken = graph.merge_weakest_first(edges, nodes, keys, F.lit(max_area))
    return t.relabel(labels, roots.select(*keys, F.col("node").alias("label"), F.col("root").alias("new"))), taken


# ---------------------------------------------------------------- whole steps


def segment_nuclei(
    t: Tiles, image: str, sigma: float, min_size: int, min_distance: int, split: bool = True
) -> tuple[Tiles, DataFrame]:
    """Adds ``nuclei_mask`` and ``nuclei``; also returns the areas of all objects before the size filter."""
    t = smooth(t, image, "__s", sigma).cut()
    t = t.with_scalar(otsu(t, "__s"))
    t = pointwise(t, ["__s"], "nuclei_mask", "u1", lambda b: b["__s"] > b.threshold, per_image=["threshold"])
    t = fill_holes(_drop(t, "__s"), "nuclei_mask").cut()
    t = components(t, "nuclei_mask", "__raw")
    raw = label_sizes(t, "__raw").select(*t.keys, F.col("n").alias("area_px"))
    t = keep_labels(t, "__raw", label_sizes(t, "__raw").where(F.col("n") >= min_size))
    t = _drop(pointwise(t, ["__raw"], "nuclei_mask", "u1", lambda b: b["__raw"] > 0), "__raw").cut()
    t = distance(t, "nuclei_mask", "__d").cut()
    t = peaks(t, "__d", "nuclei_mask", "__m", max(1, min_distance)).cut()
    t = pointwise(t, ["__d"], "__h", "f8", lambda b: -b["__d"])
    t = _drop(watershed(t, "__h", "__m", "nuclei", "nuclei_mask"), "__h", "__m", "__d")
    t = t.cut() if split else components(t, "nuclei", "nuclei", eight=True)
    return number(t, "nuclei").cut(), raw


def foreground_mask(
    t: Tiles, edge: str, out: str, kind: str = "union", threshold: float | None = None, percentile: float = 20.0,
    radius: int = 7, iterations: int = 3, min_hole: int = 2000,
) -> Tiles:
    """Where cells may be in a sparse image: around nuclei, on strong edges, or both."""
    disk = k.disk_offsets(radius)
    if kind != "nuclei":
        if threshold is None:
            t = t.with_scalar(image_percentiles(t, edge, {"cutoff": percentile / 100}))
            strong = pointwise(t, [edge], "__e", "u1", lambda b: b[edge] > b.cutoff, per_image=["cutoff"])
        else:
            strong = pointwise(t, [edge], "__e", "u1", lambda b: b[edge] > threshold)
        t = strong
    if kind in ("nuclei", "union"):
        t = morph(t, "nuclei_mask", out, disk, True, iterations)
    if kind == "edge":
        t = _drop(closing(t, "__e", out, disk), "__e")
    elif kind == "union":
        t = _drop(pointwise(t, [out, "__e"], out, "u1", lambda b: (b[out] > 0) | (b["__e"] > 0)), "__e")
        t = closing(t, out, out, disk)
    elif kind != "nuclei":
        raise ValueError(f"unknown foreground mask: {kind}")
    return remove_small_holes(t, out, min_hole) if min_hole > 0 else t


def enclosed_mask(t: Tiles, edge: str, out: str, threshold: float | None, percentile: float, radius: int) -> Tiles:
    """Everything enclosed by junction signal."""
    t = t.with_scalar(image_percentiles(t, edge, {"cutoff": percentile / 100}))
    t = pointwise(t, [edge], out, "u1", lambda b: b[edge] > (b.cutoff if threshold is None else threshold), per_image=["cutoff"])
    return fill_holes(closing(t, out, out, k.disk_offsets(max(1, radius))), out)


def surface(t: Tiles, edge: str, out: str, mode: str, sigma: float) -> Tiles:
    if mode == "intensity":
        return pointwise(t, [edge], out, "f8", lambda b: b[edge])
    if mode == "gradient":
        return gradient_surface(t, edge, out, sigma)
    raise ValueError(f"unknown edge mode: {mode}")


def coarse(t: Tiles, layer: str, out: str, f: int) -> Tiles:
    """Block means over ``f`` x ``f`` pixels (missing pixels of the last blocks count as zero)."""
    if f == 1:
        return pointwise(t.select(layer), [layer], out, "f8", lambda b: b[layer]).select(out)

    def run(b):
        a = b[layer]
        y, x = np.mgrid[b.y0: b.y0 + a.shape[0], b.x0: b.x0 + a.shape[1]]
        block = np.stack([(y // f).ravel(), (x // f).ravel()])
        u, inv = np.unique(block, axis=1, return_inverse=True)
        s = np.bincount(inv.ravel(), weights=a.ravel().astype(float))
        m = u.shape[1]
        return {"y": u[0].tolist(), "x": u[1].tolist(), "v": s.tolist(),
                "height": [-(-b.height // f)] * m, "width": [-(-b.width // f)] * m}

    sums = t.rows([layer], "y int, x int, v double, height int, width int", run)
    pixels = sums.groupBy(*t.keys, "y", "x", "height", "width").agg((F.sum("v") / (f * f)).alias("v"))
    return tiles_from_pixels(pixels, t.keys, "v", out, "f8", t.size, t.single)


def tiles_from_pixels(pixels: DataFrame, keys, value: str, out: str, dtype: str, size: int, single: bool) -> Tiles:
    """Pack (keys, y, x, height, width, value) rows into tiles; absent pixels are zero."""
    import pandas as pd
    from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

    keys = list(keys)
    schema = StructType([pixels.schema[c] for c in keys] + [StructField(p, IntegerType()) for p in POSITION]
                        + [StructField(out, BinaryType())])

    columns = ["y", "x", "height", "width", value]

    def pack(batches):
        for pdf in batches:
            out = []
            for g in pdf.to_dict("records"):
                height, width = int(g["height"][0]), int(g["width"][0])
                y0, x0 = g["ty"] * size, g["tx"] * size
                a = np.zeros((min(size, height - y0), min(size, width - x0)), dtype)
                a[np.asarray(g["y"]) - y0, np.asarray(g["x"]) - x0] = g[value]
                out.append({**{c: g[c] for c in [*keys, "ty", "tx"]}, "height": height, "width": width, out_name: a.tobytes()})
            yield pd.DataFrame(out, columns=schema.fieldNames())

    out_name = out
    placed = pixels.withColumn("ty", F.floor(F.col("y") / size).cast("int")).withColumn("tx", F.floor(F.col("x") / size).cast("int"))
    # one group is one tile
    packed = gather(placed, [*keys, "ty", "tx"], columns).mapInPandas(pack, schema)
    return Tiles(packed, tuple(keys), size, {out: dtype}, single)


def junction_seeds(t: Tiles, image: str, out: str, sigma: float, min_depth: float) -> Tiles:
    """One numbered marker per dark basin of the strongly blurred junction image."""
    f = int(max(1, min(8, sigma // 2)))
    keys = list(t.keys)
    small = smooth(coarse(t, image, "__v", f), "__v", "__v", max(sigma / f, 0.5)).cut()
    span = image_percentiles(small, "__v", {"lo": 0.01, "hi": 0.99}).where("hi > lo")
    depth = span.select(*keys, (min_depth * (F.col("hi") - F.col("lo"))).alias("depth"))
    basins = number(components(deep_minima(small, "__v", "__b", depth), "__b", out), out)

    def spots(b):
        y, x = np.nonzero(b[out])
        n = len(y)
        return {"y": (y + b.y0).tolist(), "x": (x + b.x0).tolist(), "label": b[out][y, x].tolist(), "one": [1] * n}

    marks = basins.rows([out], "y int, x int, label bigint, one int", spots)
    size, layer = t.size, out
    steps = F.sequence(F.lit(0), F.lit(f - 1))
    wide = (
        marks.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
        .select(*keys, (F.col("y") * f + F.col("dy")).alias("y"), (F.col("x") * f + F.col("dx")).alias("x"), "label")
        .withColumn("ty", F.floor(F.col("y") / size).cast("int")).withColumn("tx", F.floor(F.col("x") / size).cast("int"))
    )
    # a list holds at most the pixels of one tile
    lists = wide.groupBy(*keys, "ty", "tx").agg(F.collect_list(F.struct("y", "x", "label")).alias("__p"))
    joined = t.df.join(lists, [*keys, "ty", "tx"], "left")
    columns = [*t.df.columns, layer]
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([*t.df.schema.fields, StructField(layer, BinaryType())])

    def paint(batches):
        for pdf in batches:
            blobs = []
            for row in pdf[["ty", "tx", "height", "width", "__p"]].to_dict("records"):
                y0, x0 = row["ty"] * size, row["tx"] * size
                a = np.zeros((min(size, row["height"] - y0), min(size, row["width"] - x0)), LABEL)
                for p in row["__p"] if row["__p"] is not None else ():
                    if p["y"] - y0 < a.shape[0] and p["x"] - x0 < a.shape[1]:
                        a[p["y"] - y0, p["x"] - x0] = p["label"]
                blobs.append(a.tobytes())
            yield pdf.drop(columns="__p").assign(**{layer: blobs})[columns]

    return t._with(joined.mapInPandas(paint, schema), {**t.layers, layer: LABEL})


def per_image_counts(t: Tiles, layer: str, name: str) -> DataFrame:
    """(keys, height, width, name): number of labels of every image, zero included."""
    every = t.df.groupBy(*t.keys).agg(F.max("height").alias("height"), F.max("width").alias("width"))
    n = label_sizes(t, layer).groupBy(*t.keys).agg(F.count(F.lit(1)).alias(name))
    return every.join(n, list(t.keys), "left").withColumn(name, F.coalesce(name, F.lit(0)))


def segment_cells(t: Tiles, nuclei_image: str | None, edge_image: str, p: Mapping[str, Any]) -> dict[str, Any]:
    """The complete segmentation of a table of images, all sizes of ``p`` in pixels.

    ``min_nuclei_confluent`` is a number or a column over ``height`` and ``width``.

    Returns tiles with ``nuclei_mask``, ``nuclei`` and ``cells`` layers and the tables
    summary, adjacency, nuclei, cells, raw_areas.
    """
    keys = list(t.keys)
    border = p["clear_border_buffer"] if p["clear_border_labels"] else None
    if p["segment_objects"] == "nuclei_only":
        t, raw = segment_nuclei(t, nuclei_image, p["nuclei_sigma"], p["min_nucleus_size"], p["min_distance"], p["split_touching_nuclei"])
        t = number(finish_cells(t, "nuclei", 0, border), "nuclei").cut()
        summary = per_image_counts(t, "nuclei", "n_nuclei").drop("height", "width").withColumn("status", F.lit("ok"))
        return {"tiles": t, "summary": summary, "raw_areas": raw, "nuclei": objects(t, "nuclei"), "adjacency": None, "cells": None}
    if p["seed_source"] == "junctions":
        return _from_junctions(t, edge_image, p, border)

    t, raw = segment_nuclei(t, nuclei_image, p["nuclei_sigma"], p["min_nucleus_size"], p["min_distance"], p["split_touching_nuclei"])
    individual = objects(t, "nuclei")
    counts = per_image_counts(t, "nuclei", "n_nuclei")
    confluent = F.col("n_nuclei") >= p["min_nuclei_confluent"]
    sparse_skip = (not p["nonconfluent_enabled"]) and p["sparse_policy"] == "skip"
    skipped = (~confluent & (F.col("n_nuclei") > 0)) if sparse_skip else F.lit(False)
    counts = counts.select(*keys, "n_nuclei", confluent.alias("confluent"), skipped.alias("skipped"))
    t = smooth(t, edge_image, "edge", p["edge_sigma"]).cut()
    mask = None
    if p["nonconfluent_enabled"]:
        # only sparse images need the mask; confluent ones may be cells everywhere
        t = foreground_mask(t, "edge", "__mask", p["foreground_mask"], p["edge_threshold"], p["edge_threshold_percentile"],
                            p["nuc_dilation_rad"], p["nuc_dilation_iterations"], p["min_hole_size"])
        t = t.with_scalar(counts.select(*keys, "confluent"))
        t = pointwise(t, ["__mask"], "__mask", "u1", lambda b: np.ones_like(b["__mask"]) if b.confluent else b["__mask"],
                      per_image=["confluent"])
        mask = "__mask"
    t = surface(t, "edge", "__h", p["edge_mode"], p["edge_sigma"])
    t = watershed(t, "__h", "nuclei", "cells", mask).cut()
    if sparse_skip:
        t = t.with_scalar(counts.select(*keys, "skipped"))
        t = pointwise(t, ["cells"], "cells", LABEL, lambda b: np.zeros_like(b["cells"]) if b.skipped else b["cells"], per_image=["skipped"])
    t = _drop(t, "__h", *(["__mask"] if mask else [])).cut()
    merged = taken = None
    if p["merge_multinucleated"] and p["multinuc_max_nuclei"] > 1:
        t, taken, merged = merge_multinucleated(
            t, "cells", "nuclei", "edge", "nuclei_mask", p["multinuc_max_distance"], p["multinuc_junction_ratio"],
            p["multinuc_max_nuclei"], p["multinuc_band_px"],
        )
        t = t.cut()
    t = finish_cells(t, "cells", p["min_label_size"], border).cut()
    shapes = objects(t, "cells")
    if merged is not None:
        shapes = shapes.join(merged, [*keys, "label"], "left").withColumn("n_nuclei", F.coalesce("n_nuclei", F.lit(1)))
    else:
        shapes = shapes.withColumn("n_nuclei", F.lit(1).cast("bigint"))
    per_image = shapes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("n_nuclei") > 1).alias("n_multinucleated"))
    summary = counts.join(per_image, keys, "left").na.fill(0, ["n_cells", "n_multinucleated"]).withColumn(
        "status", F.when(F.col("skipped"), "skipped_sparse").otherwise("ok")
    ).drop("skipped")
    return {"tiles": t, "summary": summary, "raw_areas": raw, "nuclei": individual, "cells": shapes, "merged_pairs": taken,
            "adjacency": contacts(t, "cells", "edge").withColumn("junction_intensity", F.round("junction_intensity", 3))}


def offset_slices(t: Tiles, layers: Sequence[str], z: str, counts: DataFrame) -> Tiles:
    """Labels of z slices that were segmented one by one, made distinct within their stack.

    A slice continues after the ``n`` (keys, n) of the slices before it; the window is over the slices of one stack.
    """
    keys = [c for c in t.keys if c != z]
    before = Window.partitionBy(*keys).orderBy(z).rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*t.keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    moved = t.with_scalar(shift)

    def shifted(b):
        return {layer: np.where(b[layer] > 0, b[layer] + b.shift, 0) for layer in layers}

    moved = moved.transform(list(layers), {layer: LABEL for layer in layers}, shifted, per_image=["shift"])
    return moved.select(*t.layers)


def stack_slices(got: Mapping[str, Any], z: str) -> dict[str, Any]:
    """What ``segment_cells`` made of single slices, as stacks: distinct labels, and counts summed over slices.

    Labels go on after the nuclei of the slices before, or after their largest cell label where there are no nuclei.  A stack is confluent
    if all its slices are.  Objects, contacts and sizes of single slices mean nothing for a stack, so there are none.
    """
    t, summary = got["tiles"], got["summary"]
    keys = [c for c in t.keys if c != z]
    layers = [n for n in ("nuclei", "cells") if n in t.layers]
    if "nuclei" in layers:
        counts = summary.select(*t.keys, F.col("n_nuclei").alias("n"))
    else:
        top = label_sizes(t, "cells").groupBy(*t.keys).agg(F.max("label").alias("n"))
        counts = summary.select(*t.keys).join(top, list(t.keys), "left").na.fill(0, ["n"])
    sums = [F.sum(c).alias(c) for c in ("n_nuclei", "n_cells", "n_multinucleated", "n_seeds", "n_regions") if c in summary.columns]
    every = [F.bool_and("confluent").alias("confluent")] if "confluent" in summary.columns else []
    whole = summary.groupBy(*keys).agg(*sums, *every, F.count(F.lit(1)).alias("n_slices")).withColumn("status", F.lit("ok"))
    return {**dict.fromkeys(got), "tiles": offset_slices(t, layers, z, counts).cut(), "summary": whole}


def _from_junctions(t: Tiles, edge_image: str, p: Mapping[str, Any], border: int | None) -> dict[str, Any]:
    keys = list(t.keys)
    t = junction_seeds(t, edge_image, "seeds", p["seed_sigma"], p["seed_min_depth"]).cut()
    seeds = per_image_counts(t, "seeds", "n_seeds")
    t = smooth(t, edge_image, "edge", p["edge_sigma"])
    t = surface(t, "edge", "__h", p["edge_mode"], p["edge_sigma"]).cut()
    t = _drop(watershed(t, "__h", "seeds", "cells"), "__h").cut()
    t, taken = merge_without_junction(t, "cells", "edge", "seeds", p["junction_merge_ratio"], p["max_cell_area"], p["multinuc_band_px"])
    t = number(t, "cells").cut()
    counts = seeds.join(per_image_counts(t, "cells", "n_regions").drop("height", "width"), keys).withColumn(
        "confluent", F.col("n_regions") >= p["min_nuclei_confluent"]
    )
    skipped = F.lit(False)
    if p["nonconfluent_enabled"]:
        t = enclosed_mask(t, "edge", "__mask", p["edge_threshold"], p["edge_threshold_percentile"], p["nuc_dilation_rad"])
        t = t.with_scalar(counts.select(*keys, "confluent"))
        t = pointwise(t, ["cells", "__mask"], "cells", LABEL,
                      lambda b: b["cells"] if b.confluent else np.where(b["__mask"] > 0, b["cells"], 0), per_image=["confluent"])
        t = _drop(t, "__mask")
    elif p["sparse_policy"] == "skip":
        skipped = ~F.col("confluent")
        t = t.with_scalar(counts.select(*keys, "confluent"))
        t = pointwise(t, ["cells"], "cells", LABEL, lambda b: b["cells"] if b.confluent else np.zeros_like(b["cells"]), per_image=["confluent"])
    t = finish_cells(t, "cells", p["min_label_size"], border).cut()
    shapes = objects(t, "cells").withColumn("n_nuclei", F.lit(None).cast("bigint"))
    n = shapes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"))
    summary = counts.drop("height", "width").join(n, keys, "left").na.fill(0, ["n_cells"]).withColumn("n_nuclei", F.lit(None).cast("bigint")).withColumn(
        "n_multinucleated", F.lit(0).cast("bigint")
    ).withColumn("status", F.when(skipped, "skipped_sparse").otherwise("ok"))
    return {"tiles": t, "summary": summary, "raw_areas": None, "nuclei": None, "cells": shapes, "merged_pairs": taken,
            "adjacency": contacts(t, "cells", "edge").withColumn("junction_intensity", F.round("junction_intensity", 3))}
