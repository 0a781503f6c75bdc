"""Tile operators against brute force on small images, with tiles smaller than the image."""

import heapq

import numpy as np
import pytest

from tessera.operators import segment as sg
from tessera.operators.tiles import tile_images

RNG = np.random.default_rng(5)


def make(spark, arrays, size, **layers):
    """Tiles from {image id: {layer: array}}."""
    names = list(layers)
    rows = []
    for i, a in arrays.items():
        h, w = next(iter(a.values())).shape
        rows.append((i, h, w, *[bytearray(np.ascontiguousarray(a[n], layers[n]).tobytes()) for n in names]))
    df = spark.createDataFrame(rows, "scene int, height int, width int, " + ", ".join(f"{n} binary" for n in names))
    return tile_images(df, ["scene"], layers, size)


def back(t, layer):
    """{image id: array}"""
    out = {}
    for r in t.df.select("scene", "ty", "tx", "height", "width", layer).collect():
        a = out.setdefault(r.scene, np.zeros((r.height, r.width)))
        y, x = r.ty * t.size, r.tx * t.size
        h, w = min(t.size, r.height - y), min(t.size, r.width - x)
        a[y: y + h, x: x + w] = np.frombuffer(r[layer], t.layers[layer]).reshape(h, w)
    return out


def brute_components(mask, eight=False):
    lab, n = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if lab[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        lab[y, x] = n
        while stack:
            cy, cx = stack.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if (dy or dx) and (eight or not (dy and dx)):
                        ny, nx = cy + dy, cx + dx
                        if 0 <= ny < mask.shape[0] and 0 <= nx < mask.shape[1] and mask[ny, nx] and not lab[ny, nx]:
                            lab[ny, nx] = n
                            stack.append((ny, nx))
    return lab


@pytest.mark.parametrize("eight", [False, True])
def test_components_match_flood_fill(spark, eight):
    masks = {i: RNG.random((23, 31)) < 0.55 for i in range(3)}
    t = make(spark, {i: {"m": m} for i, m in masks.items()}, 8, m="u1")
    got = back(sg.number(sg.components(t, "m", "c", eight), "c"), "c")
    for i, m in masks.items():
        assert np.array_equal(got[i], brute_components(m, eight))


def test_fill_and_small_removal(spark):
    m = RNG.random((20, 26)) < 0.6
    t = make(spark, {1: {"m": m}}, 7, m="u1")
    inv = brute_components(~m)
    edge = set(inv[0]) | set(inv[-1]) | set(inv[:, 0]) | set(inv[:, -1])
    filled = m | ((inv > 0) & ~np.isin(inv, list(edge)))
    assert np.array_equal(back(sg.fill_holes(t, "m"), "m")[1] > 0, filled)
    lab = brute_components(m)
    n = np.bincount(lab.ravel())
    assert np.array_equal(back(sg.remove_small_objects(t, "m", 9), "m")[1] > 0, m & (n[lab] >= 9))
    n = np.bincount(inv.ravel())
    assert np.array_equal(back(sg.remove_small_holes(t, "m", 4), "m")[1] > 0, m | (n[inv] < 4))


def test_distance_and_blur(spark):
    m = RNG.random((19, 25)) < 0.9
    img = RNG.random((19, 25))
    t = make(spark, {1: {"m": m, "v": img}}, 6, m="u1", v="f8")
    bg = np.argwhere(~m)
    want = np.zeros(m.shape)
    for y, x in np.argwhere(m):
        want[y, x] = np.sqrt(((bg - [y, x]) ** 2).sum(axis=1).min())
    assert np.allclose(back(sg.distance(t, "m", "d"), "d")[1], want)

    w = sg.k.gaussian_weights(1.3)
    r = len(w) // 2
    p = np.pad(img, r, mode="edge")
    blur = sum(w[i] * w[j] * p[i: i + 19, j: j + 25] for i in range(len(w)) for j in range(len(w)))
    assert np.allclose(back(sg.smooth(t, "v", "s", 1.3), "s")[1], blur)


def brute_watershed(height, markers, mask):
    """Levels by a priority queue; labels in pop order with the smallest label on ties."""
    h, w = height.shape
    best = {}
    heap = [(height[y, x], 0, y, x) for y, x in np.argwhere((markers > 0) & mask)]
    heapq.heapify(heap)
    done = {}
    while heap:
        lv, st, y, x = heapq.heappop(heap)
        if (y, x) in done:
            continue
        done[y, x] = (lv, st)
        for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            q = y + dy, x + dx
            if 0 <= q[0] < h and 0 <= q[1] < w and mask[q] and q not in done:
                nl = max(lv, height[q])
                cand = (nl, st + 1 if lv >= height[q] else 0)
                if q not in best or cand < best[q]:
                    best[q] = cand
                    heapq.heappush(heap, (*cand, *q))
    lab = np.zeros(height.shape, int)
    for p in sorted(done, key=done.get):
        if markers[p] > 0:
            lab[p] = markers[p]
    for p in sorted(done, key=done.get):
        if lab[p]:
            continue
        near = [q for q in ((p[0], p[1] + 1), (p[0] + 1, p[1]), (p[0], p[1] - 1), (p[0] - 1, p[1])) if q in done]
        first = min(done[q] for q in near)
        lab[p] = min(lab[q] for q in near if done[q] == first)
    return lab


@pytest.mark.parametrize("size", [6, 64])
def test_watershed_does_not_depend_on_tiles(spark, size):
    height = RNG.integers(0, 6, (21, 22)).astype(float)
    markers = np.zeros((21, 22), int)
    for i, (y, x) in enumerate([(2, 3), (15, 4), (8, 18), (19, 19)], 1):
        markers[y, x] = i
    mask = RNG.random((21, 22)) < 0.93
    t = make(spark, {1: {"h": height, "m": markers, "k": mask}}, size, h="f8", m="i8", k="u1")
    got = back(sg.watershed(t, "h", "m", "w", "k"), "w")[1]
    assert np.array_equal(got, brute_watershed(height, markers, mask))


@pytest.mark.parametrize("size", [7, 64])
def test_peaks_are_greedy(spark, size):
    v = RNG.integers(0, 4, (24, 25)).astype(float)
    t = make(spark, {1: {"v": v, "m": np.ones_like(v)}}, size, v="f8", m="u1")
    got = back(sg.peaks(t, "v", "m", "p", 2), "p")[1]
    kept = []
    cand = []
    for y in range(2, 22):
        for x in range(2, 23):
            if v[y, x] > 0 and v[y, x] == v[y - 2: y + 3, x - 2: x + 3].max():
                cand.append((-v[y, x], y, x))
    for _, y, x in sorted(cand):
        if all(max(abs(y - a), abs(x - b)) > 2 for a, b in kept):
            kept.append((y, x))
    want = np.zeros_like(v)
    for i, (y, x) in enumerate(sorted(kept), 1):
        want[y, x] = i
    assert np.array_equal(got, want)


def test_deep_minima(spark):
    v = RNG.random((18, 20))
    t = make(spark, {1: {"v": v}}, 7, v="f8")
    depth = spark.createDataFrame([(1, 0.3)], "scene int, depth double")
    got = back(sg.deep_minima(t, "v", "o", depth), "o")[1] > 0
    fill = v + 0.3
    while True:
        p = np.pad(fill, 1, constant_values=np.inf)
        low = np.min([p[i: i + 18, j: j + 20] for i in range(3) for j in range(3)], axis=0)
        new = np.maximum(low, v)
        new = np.minimum(new, fill)
        if np.array_equal(new, fill):
            break
        fill = new
    assert np.array_equal(got, fill - v >= 0.3 - 1e-15)


def test_contacts_and_objects_match_pixels(spark):
    from tessera.operators import pixels as px

    lab = RNG.integers(0, 4, (15, 17))
    e = RNG.random((15, 17))
    t = make(spark, {1: {"l": lab, "e": e}}, 5, l="i8", e="f8")
    pix = t.pixels_table("l", "label int").join(t.pixels_table("e", "e double"), ["scene", "y", "x"])
    a = {(r.cell_id_a, r.cell_id_b): (r.contact_px, round(r.junction_intensity, 9)) for r in sg.contacts(t, "l", "e").collect()}
    b = {(r.cell_id_a, r.cell_id_b): (r.contact_px, round(r.junction_intensity, 9)) for r in px.contacts(pix, ["scene"], "e").collect()}
    assert a == b and a
    cols = ["area_px", "centroid_y", "centroid_x", "major_axis_px", "minor_axis_px", "eccentricity", "orientation_rad", "extent"]
    a = {r.label: [r[c] for c in cols] for r in sg.objects(t, "l").collect()}
    b = {r.label: [r[c] for c in cols] for r in px.regions(pix, ["scene"]).collect()}
    assert set(a) == set(b)
    for key in a:
        assert np.allclose(a[key], b[key])


def test_hand_made_label_image(spark):
    lab = np.array([[1, 1, 2, 2], [1, 1, 2, 2], [3, 3, 0, 2], [3, 3, 0, 0]])
    e = np.arange(16.0).reshape(4, 4)
    t = make(spark, {1: {"l": lab, "e": e}}, 3, l="i8", e="f8")
    got = sorted((r.cell_id_a, r.cell_id_b, r.contact_px, r.junction_intensity) for r in sg.contacts(t, "l", "e").collect())
    assert got == [(1, 2, 2, 3.5), (1, 3, 2, 6.5)]
    o = {r.label: r for r in sg.objects(t, "l").collect()}
    assert o[2].area_px == 5 and round(o[2].major_axis_px, 6) == 3.098387 and round(o[2].minor_axis_px, 6) == 1.788854
    assert round(o[2].eccentricity, 6) == 0.816497 and round(o[2].equivalent_diameter_px, 6) == 2.523133
    assert round(o[2].extent, 6) == 0.833333


def test_only_tiles_near_a_change_take_part(spark, tmp_path):
    """A wave along a strip of tiles: each round computes the tiles around the last change, not all of them."""
    h = np.zeros((6, 96))
    seen = tmp_path / "seen"
    seen.mkdir()
    t = make(spark, {1: {"h": h, "m": np.where(np.arange(96) == 0, 1, 0) * np.ones((6, 1))}}, 6, h="f8", m="i8")

    def run(b):
        with open(seen / f"{b.ty}-{b.tx}", "a") as f:
            f.write("x")
        far = b["m"].copy()
        far[:, 1:] = np.maximum.accumulate(far, axis=1)[:, 1:]
        after = far[b.core]
        return {"m": after, "changed": int((after != b["m"][b.core]).sum())}

    got = back(t.repeat(["h", "m"], {"m": "i8"}, run), "m")[1]
    assert (got == 1).all()
    counts = {p.name: len(p.read_text()) for p in seen.iterdir()}
    assert len(counts) == 16 and max(counts.values()) <= 5  # all sixteen rounds would be 17 each


@pytest.mark.parametrize("size", [5, 64])
def test_floods_with_plateaus_and_walls(spark, size):
    height = RNG.integers(0, 3, (23, 19)).astype(float)
    mask = np.ones(height.shape, bool)
    mask[4, :15] = mask[9, 5:] = mask[14, :12] = False  # a winding way through many tiles
    markers = np.zeros(height.shape, int)
    markers[0, 0], markers[22, 18], markers[7, 2] = 5, 2, 9
    t = make(spark, {1: {"h": height, "m": markers, "k": mask}, 2: {"h": height[:5, :5], "m": markers[:5, :5], "k": mask[:5, :5]}}, size, h="f8", m="i8", k="u1")
    got = back(sg.watershed(t, "h", "m", "w", "k"), "w")
    assert np.array_equal(got[1], brute_watershed(height, markers, mask))
    assert np.array_equal(got[2], brute_watershed(height[:5, :5], markers[:5, :5], mask[:5, :5]))
