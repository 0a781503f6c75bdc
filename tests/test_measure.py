import numpy as np
from test_tiles import RNG, make

from tessera.operators import measure as ms
from tessera.operators import segment as sg


def test_intensity_and_rim(spark):
    lab = RNG.integers(0, 4, (15, 17)) * (RNG.random((15, 17)) < 0.9)
    lab[3:9, 4:11] = 7
    v = np.round(RNG.random((15, 17)), 2)
    t = make(spark, {1: {"l": lab, "v": v}}, 6, l="i8", v="f8")
    got = {r.label: r for r in ms.channel_stats(t, "l", {"c": "v"}).collect()}
    for i in np.unique(lab[lab > 0]):
        x = v[lab == i]
        r = got[i]
        assert np.allclose([r.n, r["mean"], r["median"], r["std"], r["sum"]], [x.size, x.mean(), np.median(x), x.std(), x.sum()])
    for band in (1, 2):
        rim = {r.label: r for r in ms.boundary_stats(t, "l", {"c": "v"}, band).collect()}
        for i in np.unique(lab[lab > 0]):
            m = np.pad(lab == i, 2)
            e = m.copy()
            for _ in range(band):
                e = e & np.roll(e, 1, 0) & np.roll(e, -1, 0) & np.roll(e, 1, 1) & np.roll(e, -1, 1)
            x = v[(m & ~e)[2:-2, 2:-2]]
            assert np.allclose([rim[i].edge_mean, rim[i].edge_std], [x.mean(), x.std()])


def test_square_outline(spark):
    lab = np.zeros((20, 20), int)
    lab[4:14, 5:15] = 3  # ten by ten
    lab[16, 16] = 8  # one pixel
    a = {s: make(spark, {1: {"l": lab}}, s, l="i8") for s in (6, 64)}
    for t in a.values():
        p = {r.label: r.perimeter_px for r in ms.perimeters(t, "l").collect()}
        assert p == {3: 36.0, 8: 0.0}
        s = {r.label: r.convex_px for r in ms.solidity(t, "l").collect()}
        assert s == {3: 100, 8: 1}
    r = [{r.label: r.ruggedness for r in ms.ruggedness(t, "l").collect()} for t in a.values()]
    assert np.isclose(r[0][3], r[1][3]) and 1.0 < r[0][3] < 1.2


def test_hull_of_a_notched_shape(spark):
    lab = np.zeros((12, 12), int)
    lab[1:10, 1:3] = 1
    lab[8:10, 1:10] = 1
    t = make(spark, {1: {"l": lab}}, 5, l="i8")
    got = ms.solidity(t, "l").collect()[0].convex_px
    pts = [(y + dy, x + dx) for y, x in np.argwhere(lab) for dy, dx in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))]
    dirs = [(np.cos(a), np.sin(a)) for a in np.linspace(0, 2 * np.pi, 3600)]
    top = [max(p[0] * c + p[1] * s for p in pts) for c, s in dirs]
    want = sum(
        all(y * c + x * s <= m + 1e-3 for (c, s), m in zip(dirs, top)) for y in range(12) for x in range(12)
    )
    assert got == want


def test_rings(spark):
    lab = np.zeros((21, 24), int)
    lab[5:9, 5:9] = 2
    lab[12:15, 13:18] = 5
    t = make(spark, {1: {"l": lab}}, 7, l="i8")
    got = sg_back(ms.rings(t, "l", "r", 1.0, 2.5), "r")
    want = np.zeros_like(lab)
    for y in range(21):
        for x in range(24):
            d = {i: np.sqrt(((np.argwhere(lab == i) - [y, x]) ** 2).sum(1)).min() for i in (2, 5)}
            near = min(d, key=lambda i: (d[i], i))
            if 1.0 < d[near] <= 3.5:
                want[y, x] = near
    assert np.array_equal(got, want)


def sg_back(t, layer):
    from test_tiles import back

    return back(t, layer)[1]


def test_names():
    assert ms.unique_names(["a", "b", "a"], 4) == ["a_ch0", "b", "a_ch2", "ch3"]
    assert sg.LABEL == "i8"
