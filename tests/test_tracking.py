"""Assignment against brute force, linking against a frame-by-frame walk, and the worked cases."""

import itertools

import numpy as np
import pytest
from test_tiles import make  # noqa: F401

from tessera.operators import matching
from tessera.operators import tracking as tr
from tessera.operators.tiles import tile_images

FRAME = np.array([[1, 1, 0, 2], [1, 1, 0, 2], [0, 0, 0, 2], [3, 3, 3, 0]])
NEXT = np.array([[0, 5, 5, 7], [0, 5, 5, 7], [0, 0, 0, 7], [8, 8, 9, 9]])


def movie(spark, frames, size=3):
    rows = [(s, t, *f.shape, bytearray(f.astype("i8").tobytes())) for (s, t), f in frames.items()]
    df = spark.createDataFrame(rows, "scene string, timepoint int, height int, width int, l binary")
    return tile_images(df, ["scene", "timepoint"], {"l": "i8"}, size)


def table(tracks):
    return {(r.timepoint, r.cell_id): (r.track_id, r.parent_track_id, r.frames_bridged) for r in tracks.collect()}


def best_total(w):
    """The largest total over all one-to-one choices of a gain matrix."""
    small, big = (w, w.shape[1]) if w.shape[0] <= w.shape[1] else (w.T, w.shape[0])
    return max(sum(small[i, j] for i, j in enumerate(perm)) for perm in itertools.permutations(range(big), small.shape[0]))


def test_assignment_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, m = rng.integers(1, 6, 2)
        w = np.where(rng.random((n, m)) < 0.6, rng.integers(1, 20, (n, m)), 0)
        a, b = np.nonzero(w)
        picked, gap = matching.best_assignment(a.tolist(), b.tolist(), w[a, b].astype(float).tolist())
        assert len({a[i] for i in picked}) == len(picked) == len({b[i] for i in picked})
        assert sum(w[a[i], b[i]] for i in picked) == best_total(w)
        assert 0 <= gap <= (n + m) * matching.UNIT


def random_edges(rng, pairs, n, m, share, values):
    out, want = [], {}
    for k in range(pairs):
        w = np.where(rng.random((n, m)) < share, rng.choice(values, (n, m)), 0.0)
        out += [(k, int(a), int(b), float(w[a, b])) for a, b in zip(*np.nonzero(w))]
        if (w > 0).any():
            want[k] = best_total(w)
    return out, want


def totals(pairs):
    got = {}
    for r in pairs.collect():
        used = got.setdefault(r.k, ([], [], []))
        for c, v in zip(used, (r.a, r.b, r.iou)):
            c.append(v)
    assert all(len(set(a)) == len(a) and len(set(b)) == len(b) for a, b, _ in got.values())
    return {k: sum(g) for k, (_, _, g) in got.items()}


@pytest.mark.parametrize("block", [2, 3, 4096])
def test_blocks_do_not_change_the_total(spark, block):
    # many equal gains and many parts that span several blocks
    edges, want = random_edges(np.random.default_rng(5), 12, 6, 6, 0.4, [0.25, 0.3, 0.5, 0.5, 0.75])
    df = spark.createDataFrame(edges, "k int, a bigint, b bigint, iou double")
    assert totals(matching.assign(df, ["k"], block)) == pytest.approx(want, abs=1e-9)
    assert matching.assign(df.where("k < 0"), ["k"], block).count() == 0


def test_one_part_of_ten_thousand_objects(spark):
    # a chain: the best total follows from a recurrence over its edges
    n = 10_000
    gain = np.random.default_rng(7).uniform(0.3, 0.35, 2 * n - 1)
    best = [0.0, gain[0]]
    for g in gain[1:]:
        best.append(max(best[-1], best[-2] + g))
    edges = [(0, (i + 1) // 2, i // 2, float(g)) for i, g in enumerate(gain)]
    df = spark.createDataFrame(edges, "k int, a bigint, b bigint, iou double")
    assert totals(matching.assign(df, ["k"], 700))[0] == pytest.approx(best[-1], abs=1e-7)
    assert totals(matching.assign(df, ["k"]))[0] == pytest.approx(best[-1], abs=1e-7)


def test_worked_division(spark):
    t = movie(spark, {("s", 0): FRAME, ("s", 1): NEXT})
    got = table(tr.track_tiles(t, "l"))
    assert got == {
        (0, 1): (1, None, 0), (0, 2): (2, None, 0), (0, 3): (3, None, 0),
        (1, 5): (1, None, 0), (1, 7): (2, None, 0), (1, 8): (3, None, 0), (1, 9): (4, 3, 0),
    }
    got = table(tr.track_tiles(t, "l", min_iou=0.5))
    assert got[1, 5] == (4, 1, 0) and got[1, 9] == (5, 3, 0)
    assert table(tr.track_tiles(t, "l", split_fraction=0.6))[1, 9] == (4, None, 0)
    s = {r.track_id: r for r in tr.track_summary(tr.track_tiles(t, "l"), ["scene"]).collect()}
    assert s[3].n_daughters == 1 and s[3].whole_series and s[4].parent_track_id == 3 and not s[4].whole_series


def test_gap(spark):
    t = movie(spark, {("s", 0): FRAME, ("s", 2): FRAME})
    got = table(tr.track_tiles(t, "l", max_gap=1))
    assert all(got[2, c] == (c, None, 1) for c in (1, 2, 3))
    got = table(tr.track_tiles(t, "l", max_gap=0))
    assert sorted(got[2, c][0] for c in (1, 2, 3)) == [4, 5, 6] and got[2, 1][1] is None


def walk(frames, min_iou, max_gap, split):
    """Frame by frame, with brute-force assignment."""
    seen, out, nxt = [], {}, 1
    for t in sorted(frames):
        cur = frames[t]
        ids = [i for i in np.unique(cur) if i]
        got = {}

        def overlaps(old):
            res = []
            for a in np.unique(old[old > 0]):
                for b in ids:
                    sh = ((old == a) & (cur == b)).sum()
                    if sh:
                        res.append((a, b, sh / ((old == a) | (cur == b)).sum(), sh / (cur == b).sum()))
            return res

        def best(pairs):
            top = (0, [])
            for n in range(len(pairs) + 1):
                for c in itertools.combinations(pairs, n):
                    if len({p[0] for p in c}) == n == len({p[1] for p in c}):
                        s = sum(p[2] for p in c)
                        if s > top[0] + 1e-12:
                            top = (s, c)
            return top[1]

        used = set()
        for depth, (t0, old, assigned) in enumerate(reversed(seen)):
            gap = t - t0 - 1
            if gap > max_gap:
                break
            later = {tr_ for t1, _, a1 in seen if t1 > t0 for tr_ in a1.values()}
            pairs = [p for p in overlaps(old) if p[2] >= min_iou and p[1] not in got]
            if depth:
                pairs = [p for p in pairs if assigned[p[0]] not in later and assigned[p[0]] not in used]
            for a, b, iou, _ in best(pairs):
                got[b] = (assigned[a], None, gap)
                used.add(assigned[a])
        parents = {}
        if seen and t - seen[-1][0] - 1 <= max_gap:
            for a, b, _, share in sorted(overlaps(seen[-1][1])):
                if share >= split and share > parents.get(b, (0, 0))[0]:
                    parents[b] = (share, seen[-1][2][a])
        for b in ids:
            if b not in got:
                got[b] = (nxt, parents.get(b, (0, None))[1], 0)
                nxt += 1
        for b in ids:
            out[t, b] = got[b]
        seen.append((t, cur, {b: got[b][0] for b in ids}))
        seen = seen[-(max_gap + 1):]
    return out


@pytest.mark.parametrize("max_gap", [0, 2])
def test_linking_matches_a_frame_by_frame_walk(spark, max_gap):
    rng = np.random.default_rng(11)
    scenes = {}
    for s in "ab":
        for t in (0, 1, 2, 4, 5, 7):
            f = np.zeros((7, 9), int)
            for i in range(1, 4):
                if rng.random() < 0.75:
                    y, x = 2 * (i - 1) + rng.integers(0, 2), rng.integers(0, 4)
                    f[y: y + 2, x: x + 4 + rng.integers(0, 2)] = i
            f[f == 0] = 0
            scenes[s, t] = f
    # areas chosen so that no two assignments tie
    t = movie(spark, scenes, 4)
    got = tr.track_tiles(t, "l", min_iou=0.2, max_gap=max_gap).collect()
    for s in "ab":
        want = walk({t: f for (q, t), f in scenes.items() if q == s}, 0.2, max_gap, 0.5)
        mine = {(r.timepoint, r.cell_id): (r.track_id, r.parent_track_id, r.frames_bridged) for r in got if r.scene == s}
        assert mine == {k: tuple(None if x is None else int(x) for x in v) for k, v in want.items()}
