"""Array helpers for one tile.  Each is a few vectorised numpy steps; tiles are small and
Spark decides where they run."""

from __future__ import annotations

import numpy as np

FOUR = ((0, 1), (1, 0))
EIGHT = ((0, 1), (1, 0), (1, 1), (1, -1))


def gaussian_weights(sigma: float) -> np.ndarray:
    radius = int(4.0 * sigma + 0.5)
    if sigma <= 0 or radius == 0:
        return np.ones(1)
    x = np.arange(-radius, radius + 1)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    return w / w.sum()


def convolve_valid(a: np.ndarray, w: np.ndarray, axis: int) -> np.ndarray:
    """Weighted sum along one axis without padding."""
    n = a.shape[axis] - len(w) + 1
    out = np.zeros(a.shape[:axis] + (n,) + a.shape[axis + 1:])
    for i, wi in enumerate(w):
        out += wi * np.take(a, range(i, i + n), axis=axis)
    return out


def extreme_valid(a: np.ndarray, size: int, largest: bool) -> np.ndarray:
    """Maximum (minimum) over every ``size`` x ``size`` window, without padding."""
    pick = np.maximum if largest else np.minimum
    for axis in (0, 1):
        n = a.shape[axis] - size + 1
        out = np.take(a, range(0, n), axis=axis)
        for i in range(1, size):
            out = pick(out, np.take(a, range(i, i + n), axis=axis))
        a = out
    return a


def disk_offsets(radius: int) -> list[tuple[int, int]]:
    r = range(-radius, radius + 1)
    return [(dy, dx) for dy in r for dx in r if dy * dy + dx * dx <= radius * radius]


def spread_mask(mask: np.ndarray, offsets, grow: bool) -> np.ndarray:
    """Binary dilation (erosion) of the inside; what lies beyond the array is background."""
    r = max(max(abs(dy), abs(dx)) for dy, dx in offsets)
    p = np.pad(mask, r)
    h, w = mask.shape
    out = np.zeros_like(mask) if grow else np.ones_like(mask)
    for dy, dx in offsets:
        part = p[r + dy: r + dy + h, r + dx: r + dx + w]
        out = (out | part) if grow else (out & part)
    return out


def shifted_pairs(shape, steps):
    """Index slices of both ends of every neighbour step."""
    h, w = shape
    for dy, dx in steps:
        if dx >= 0:
            yield (slice(0, h - dy), slice(0, w - dx)), (slice(dy, h), slice(dx, w))
        else:
            yield (slice(0, h - dy), slice(-dx, w)), (slice(dy, h), slice(0, w + dx))


def components(mask: np.ndarray, eight: bool = False) -> np.ndarray:
    """Component of every pixel as the flat index of its first pixel, -1 outside."""
    flat = np.arange(mask.size).reshape(mask.shape)
    ii, jj = [], []
    for a, b in shifted_pairs(mask.shape, EIGHT if eight else FOUR):
        both = mask[a] & mask[b]
        ii.append(flat[a][both])
        jj.append(flat[b][both])
    i, j = np.concatenate(ii), np.concatenate(jj)
    parent = np.arange(mask.size)
    while len(i):
        pi, pj = parent[i], parent[j]
        apart = pi != pj
        i, j, pi, pj = i[apart], j[apart], pi[apart], pj[apart]
        np.minimum.at(parent, np.maximum(pi, pj), np.minimum(pi, pj))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return np.where(mask, parent.reshape(mask.shape), -1)


def _framed(a, value):
    """The flat array with a border of one pixel, so that every neighbour has an index."""
    return np.pad(a, 1, constant_values=value).ravel()


def _inner(flat, shape):
    return flat.reshape(shape[0] + 2, shape[1] + 2)[1:-1, 1:-1]


def settle_levels(height, inside, level, steps):
    """Flood levels: lowest possible highest point of a way to a marker, then the number of
    steps since that level was reached.  Only pixels that changed are looked at again."""
    wide = height.shape[1] + 2
    hp, ip = _framed(height, np.inf), _framed(inside, False)
    lp, sp = _framed(level, np.inf), _framed(steps, np.iinfo(np.int64).max // 2)
    front = np.flatnonzero(np.isfinite(lp))
    while len(front):
        moved = []
        for step in (1, -1, wide, -wide):
            to = front + step
            open_ = ip[to]
            src, to = front[open_], to[open_]
            lv = np.maximum(lp[src], hp[to])
            st = np.where(lp[src] >= hp[to], sp[src] + 1, 0)
            better = (lv < lp[to]) | ((lv == lp[to]) & (st < sp[to]))
            to = to[better]
            lp[to], sp[to] = lv[better], st[better]
            moved.append(to)
        front = np.unique(np.concatenate(moved))
    return _inner(lp, height.shape), _inner(sp, height.shape)


def settle_labels(level, steps, fixed, label):
    """Every flooded pixel takes the label of its earliest flooded neighbour, the smallest
    label when several are equally early.  Only pixels beside a changed one are looked at again."""
    wide = level.shape[1] + 2
    most, top = np.iinfo(np.int64).max, np.iinfo(np.int64).max
    lp, sp, out = _framed(level, np.inf), _framed(steps, most), _framed(label, 0)
    free = _framed(np.isfinite(level) & ~fixed, False)
    around = np.array([-1, 1, -wide, wide])
    at = np.flatnonzero(free)
    near = at[:, None] + around
    lv = lp[near]
    best_l = lv.min(axis=1, keepdims=True)
    st = np.where(lv == best_l, sp[near], most)
    first = (lv == best_l) & (st == st.min(axis=1, keepdims=True)) & np.isfinite(best_l)
    place = np.full(len(lp), -1)
    place[at] = np.arange(len(at))
    todo = np.arange(len(at))
    while len(todo):
        lab = out[near[todo]]
        lab = np.where(first[todo] & (lab > 0), lab, top).min(axis=1)
        moved = (lab < top) & (lab != out[at[todo]])
        here = at[todo[moved]]
        out[here] = lab[moved]
        todo = place[(here[:, None] + around).ravel()] if len(here) else here
        todo = np.unique(todo[todo >= 0])
    return _inner(out, level.shape)


def settle_fill(image, level):
    """Reconstruction by erosion with 8 neighbours: levels sink as far as the image allows."""
    wide = image.shape[1] + 2
    hp, lp = _framed(image, np.inf), _framed(level, np.inf)
    real = _framed(np.ones(image.shape, bool), False)
    front = np.flatnonzero(real)
    while len(front):
        moved = []
        for step in (1, -1, wide, -wide, wide + 1, wide - 1, 1 - wide, -1 - wide):
            to = front + step
            lv = np.maximum(lp[front], hp[to])
            better = real[to] & (lv < lp[to])
            to = to[better]
            lp[to] = lv[better]
            moved.append(to)
        front = np.unique(np.concatenate(moved))
    return _inner(lp, image.shape)


def settle_peaks(value, state, order, reach, core):
    """Greedy spacing of candidates: 0 open, 1 kept, 2 dropped, 3 no candidate.

    An open candidate of the core is dropped next to a kept one that ranks before it and
    kept when nothing open or kept ranks before it nearby.
    """
    ys, xs = np.nonzero(state != 3)
    rank = {(y, x): (-value[y, x], order[y, x]) for y, x in zip(ys.tolist(), xs.tolist())}
    cy, cx = core
    for p in sorted(rank, key=rank.get):
        if state[p] or not (cy.start <= p[0] < cy.stop and cx.start <= p[1] < cx.stop):
            continue
        y0, x0 = max(0, p[0] - reach), max(0, p[1] - reach)
        near = np.argwhere(state[y0: p[0] + reach + 1, x0: p[1] + reach + 1] < 2)
        before = [
            state[q] for q in ((y0 + y, x0 + x) for y, x in near.tolist()) if q != p and rank[q] < rank[p]
        ]
        if 1 in before:
            state[p] = 2
        elif 0 not in before:
            state[p] = 1
    return state


def column_distances(mask: np.ndarray) -> np.ndarray:
    """Distance to the nearest background pixel of the same column (a large number if none)."""
    h = mask.shape[0]
    far = 1 << 40
    y = np.arange(h)[:, None]
    last = np.maximum.accumulate(np.where(mask, -far, y), axis=0)
    following = np.minimum.accumulate(np.where(mask, far, y)[::-1], axis=0)[::-1]
    return np.minimum(y - last, following - y)


def row_envelope(squared: np.ndarray) -> np.ndarray:
    """min over x' of squared[y, x'] + (x - x')^2, widening until nothing can improve."""
    best = squared.copy()
    w = best.shape[1]
    d = 1
    while d < w and d * d < best.max():
        best[:, d:] = np.minimum(best[:, d:], squared[:, :-d] + d * d)
        best[:, :-d] = np.minimum(best[:, :-d], squared[:, d:] + d * d)
        d += 1
    return best
