"""One-to-one matching of two sides with the largest total gain, by an auction.

Nodes may stay unmatched.  To let prices start anywhere, every side gets a mirror: node ``a`` may also take its own
mirror object, and the mirror bidder of ``b`` takes ``b`` itself or the mirror of a neighbour, all for no gain.  A
perfect matching of that doubled graph always exists and has the gain of its (a, b) part.

Bidders raise the price of the object they like best by their advantage over the second best plus a step.  When all
hold an object, the total is within one step per bidder of the sum of prices and best profits, which no matching
exceeds; steps shrink to ``UNIT``.  Gains are whole multiples of ``UNIT``, so the comparison is exact.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from tessera.operators.tiles import gather
from tessera.session import cut

BITS = 42
#: Gains are counted in this unit; a total is at most this much per node below the largest possible one.
UNIT = 2.0**-BITS
#: Price steps in units, from coarse to one.
STEPS = [1 << s for s in range(36, -1, -4)]
#: Numbers of ``a`` that one task settles together.
BLOCK = 4096


def best_assignment(a: Sequence[int], b: Sequence[int], gain: Sequence[float]) -> tuple[list[int], float]:
    """Edges of a best one-to-one matching, and how far its total can be below the largest one."""
    whole = [round(g / UNIT) for g in gain]
    # bidders and objects by number: 2a is a node of the left side or its mirror, 2b + 1 one of the right side
    options: dict[int, list[tuple[int, int, int]]] = {}
    for i, (u, v, g) in enumerate(zip(a, b, whole)):
        x, y = 2 * int(u), 2 * int(v) + 1
        options.setdefault(x, [(x, 0, -1)]).append((y, g, i))
        options.setdefault(y, [(y, 0, -1)]).append((x, 0, -1))
    price = dict.fromkeys(options, 0)
    for step in STEPS:
        owner: dict[int, tuple[int, int]] = {}
        waiting = deque(options)
        while waiting:
            x = waiting.popleft()
            first = second = pick = None
            for option in options[x]:
                profit = option[1] - price[option[0]]
                if first is None or profit > first:
                    first, second, pick = profit, first, option
                elif second is None or profit > second:
                    second = profit
            y = pick[0]
            price[y] += first - second + step
            if y in owner:
                waiting.append(owner[y][0])
            owner[y] = x, pick[2]
    picked = sorted(i for _, i in owner.values() if i >= 0)
    bound = sum(price.values()) + sum(max(g - price[y] for y, g, _ in seen) for seen in options.values())
    return picked, (bound - sum(whole[i] for i in picked)) * UNIT


def _other_best(node: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """For every edge the largest gain among the other edges of its node, 0 without one."""
    at = np.lexsort((-gain, node))
    s, g = node[at], gain[at]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    size = np.diff(np.r_[first, len(s)])
    other = np.repeat(g[first], size)
    more = size > 1
    other[first] = 0.0
    other[first[more]] = g[first[more] + 1]
    out = np.empty(len(gain))
    out[at] = other
    return out


def settle(edges: pd.DataFrame) -> pd.DataFrame:
    """What can be decided from some groups of edges (group, a, b, iou, open): chosen edges and those still undecided.

    ``open`` says that ``b`` has edges elsewhere.  All edges of an ``a`` are here.  An edge that outweighs the best
    alternatives of both ends together is in every best matching; parts without an open end go to the auction.
    """
    u = edges.groupby(["group", "a"], sort=False).ngroup().to_numpy()
    v = edges.groupby(["group", "b"], sort=False).ngroup().to_numpy()
    gain, open_ = edges["iou"].to_numpy(float), edges["open"].to_numpy(bool)
    left, chosen = np.arange(len(edges)), []
    while len(left):
        g = gain[left]
        rivals = np.where(open_[left], np.inf, _other_best(u[left], g) + _other_best(v[left], g))
        sure = left[g > rivals]
        chosen.append(sure)
        before = len(left)
        left = left[~(np.isin(u[left], u[sure]) | np.isin(v[left], v[sure]))]
        if before - len(left) < before / 8:  # the rest does not fall apart any more: the auction takes it
            break
    parent: dict[int, int] = {}

    def top(n):
        parent.setdefault(n, n)
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    for i in left:
        parent[top(int(u[i]))] = top(-1 - int(v[i]))
    reaches = {top(-1 - int(v[i])) for i in left[open_[left]]}
    stays = np.array([top(int(u[i])) in reaches for i in left], bool)
    here = left[~stays]
    here = here[np.lexsort((edges["b"].to_numpy()[here], edges["a"].to_numpy()[here], u[here]))]
    picked, _ = best_assignment(u[here], v[here], gain[here])
    taken = np.concatenate([*chosen, here[picked]]) if len(left) or chosen else left
    out = edges.iloc[np.r_[taken, left[stays]].astype(int)].copy()
    out["settled"] = np.r_[np.ones(len(taken), bool), np.zeros(stays.sum(), bool)]
    return out


def _settle_blocks(rest: DataFrame, keys: list[str], block: int, shift: int) -> DataFrame:
    """(keys, a, b, iou, settled) of what is decided within blocks of ``a`` and what is left."""
    home = F.floor((F.col("a") + shift) / block)
    ends = Window.partitionBy(*keys, "b")
    dealt = rest.withColumn("home", home).withColumn("open", F.min("home").over(ends) != F.max("home").over(ends))
    schema = StructType([rest.schema[c] for c in [*keys, "a", "b"]] + [StructField("iou", DoubleType()), StructField("settled", BooleanType())])

    def run(batches):
        for pdf in batches:
            sizes = pdf["a"].map(len).to_numpy()
            edges = pd.DataFrame({c: np.concatenate(pdf[c].to_list()) for c in ("a", "b", "iou", "open")})
            edges["group"] = np.repeat(np.arange(len(pdf)), sizes)
            out = settle(edges)
            yield pdf[keys].iloc[out["group"].to_numpy()].reset_index(drop=True).join(
                out[["a", "b", "iou", "settled"]].reset_index(drop=True)
            )

    return gather(dealt, [*keys, "home"], ["a", "b", "iou", "open"]).mapInPandas(run, schema)


def assign(candidates: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """One-to-one pairs (keys, a, b, iou) with the largest summed IoU per key.

    Blocks of numbers settle what does not reach beyond them, first as they are, then shifted by half a block; blocks
    are four times as large for what is left, until nothing is.  A task holds the undecided edges of one block of one key.
    """
    keys = list(keys)
    rest, out = candidates.select(*keys, "a", "b", F.col("iou").cast("double").alias("iou")), None
    while True:
        for shift in (0, block // 2):
            done = cut(_settle_blocks(rest, keys, block, shift))
            settled = done.where("settled").drop("settled")
            out = settled if out is None else out.unionByName(settled)
            rest = done.where("not settled").drop("settled")
            if rest.isEmpty():
                return out
        block *= 4
