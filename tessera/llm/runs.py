"""Periodic runs: words that repeat one stretch at least three times in a row are collapsed to its first copy.

Method.  A document's word ids are compressed by Re-Pair: the pair of neighbouring symbols that occurs most often becomes a rule, until
no pair occurs twice; of pairs that occur equally often the oldest is taken, which keeps rules balanced.  What is left is split into halves again and again.  Every run
crosses the boundary between the two parts of exactly one smallest node that holds it, so runs are computed once for each rule and
each half: a period q is a candidate if the four words at the boundary stand again q words away (the longer side of a run of 24 words and three
periods always shows that), and both ways of extending it are found by bisection over Rabin-Karp hashes, inside the node.  Runs of
a rule are translated to all places where the rule was applied, and intervals with one period that overlap by it merge.

A *run* is a stretch of words with smallest period q and a length of at least ``max(24, 3 * q)`` that no neighbouring word extends.

Shape.  One pass without a shuffle: a document is the unit, boundaries of about 4 MB of documents are computed at once.

Edge cases.  Null, empty and short texts have no runs; rows that repeat are separate documents; a null doc_id stays null; extra
columns are ignored; an empty table gives no rows.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import SPACE, _Powers, buffers, mix, run_hashes, slices, spans

LEAST, TIMES = 24, 3
#: So many words at a boundary must stand again one period away; for the lengths above, four is the least that any run shows.
SEED = 4
#: Candidates extended at once.
AT_ONCE = 1 << 20

_ROLL = _Powers(0x9FB21C651E98DF25)


def rules(ids: list[int]) -> tuple[list[tuple[int, int, list[int]]], list[int]]:
    """Re-Pair: (length of the left part, whole length, places) of every rule, and where the symbols that are left begin."""
    pairs = list(zip(ids, ids[1:]))
    often = {p for p, n in Counter(pairs).items() if n > 1}
    places: dict[tuple[int, int], list[int]] = {}
    for i, p in enumerate(pairs):
        if p in often:
            places.setdefault(p, []).append(i)
    heap = [(-len(at), k, p) for k, (p, at) in enumerate(places.items())]
    heapify(heap)
    serial = len(heap)
    n = len(ids)
    symbol, after, before = [*ids, -1], list(range(1, n + 2)), list(range(-1, n))
    fresh = max(ids, default=0) + 1
    length: dict[int, int] = {}
    made = []
    while heap:
        count, _, pair = heappop(heap)
        a, b = pair
        at, last = [], -1
        for i in places[pair]:  # pairs that were broken up, or overlap the one before, do not count
            if symbol[i] == a and i != last and symbol[after[i]] == b:
                at.append(i)
                last = after[i]
        if len(at) < -count:
            if len(at) > 1:
                places[pair] = at
                heappush(heap, (-len(at), serial, pair))
                serial += 1
            continue
        new, fresh = fresh, fresh + 1
        left = length.get(a, 1)
        length[new] = left + length.get(b, 1)
        made.append((left, length[new], at))
        del places[pair]
        seen: dict[tuple[int, int], list[int]] = {}
        for i in at:
            gone = after[i]
            symbol[i], symbol[gone] = new, -2
            after[i] = then = after[gone]
            if then <= n:
                before[then] = i
            if before[i] >= 0:
                seen.setdefault((symbol[before[i]], new), []).append(before[i])
        for i in at:
            if after[i] < n and symbol[after[i]] != new:
                seen.setdefault((new, symbol[after[i]]), []).append(i)
        for p, at in seen.items():
            if len(at) > 1:
                places[p] = at
                heappush(heap, (-len(at), serial, p))
                serial += 1
    left, i = [], 0
    while i < n:
        left.append(i)
        i = after[i]
    return made, left


def halves(begins: np.ndarray) -> np.ndarray:
    """(low, middle, high) of the nodes that split symbols beginning at ``begins[:-1]`` into halves."""
    out, low, high = [], np.array([0]), np.array([len(begins) - 1])
    while True:
        split = high - low > 1
        low, high = low[split], high[split]
        if not len(low):
            return np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        middle = (low + high) // 2
        out.append(begins[np.stack([low, middle, high])])
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])


class Places:
    """Equality of stretches of one sequence of hashes."""

    def __init__(self, w: np.ndarray):
        self.w = w
        up, self.down = _ROLL.to(len(w) + 1)
        self.sums = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(w * up[: len(w)], out=self.sums[1:])
        n = max(len(w) - SEED + 1, 0)
        seeds = mix((self.sums[SEED:] - self.sums[:n]) * self.down[:n]) if n else np.zeros(0, np.uint64)
        order = np.argsort(seeds, kind="stable")
        g = seeds[order]
        group = np.cumsum(np.append(False, g[1:] != g[:-1])[: len(g)])
        self.key = group << 32 | order  # seeds in order, their places in order
        self.order, self.group = order, np.empty(n, np.int64)
        self.group[order] = group

    def same(self, a, b, n):
        """Whether the ``n`` words from ``a`` equal those from ``b``."""
        return (self.sums[a + n] - self.sums[a]) * self.down[a] == (self.sums[b + n] - self.sums[b]) * self.down[b]

    def alike(self, a, b, most, sign: int):
        """How many words from ``a`` on equal those from ``b`` on (sign 1), or those before them (-1)."""
        good, bad = np.zeros(len(a), np.int64), most + 1
        while True:
            open_ = bad - good > 1
            if not open_.any():
                return good
            n = (good + bad) // 2
            ok = self.same(a, b, n) if sign > 0 else self.same(a - n, b - n, n)
            good, bad = np.where(open_ & ok, n, good), np.where(open_ & ~ok, n, bad)

    def crossing(self, low, middle, high):
        """(node, start, end, period) of runs inside each node that hold the words on both sides of its middle."""
        found = []
        reach = (high - low) // TIMES
        for side in (1, -1):
            if side > 0:  # the seed at the middle stands again behind it
                usable = np.flatnonzero(middle + SEED <= high)
                seed, limit = middle[usable], np.minimum(high[usable] - SEED, middle[usable] + reach[usable])
            else:  # the seed before the middle stands before it once more
                usable = np.flatnonzero(middle - SEED >= low)
                seed = middle[usable] - SEED
                limit = np.maximum(low[usable], seed - reach[usable])
            base = self.group[seed] << 32
            own = np.searchsorted(self.key, base | seed)
            far = np.searchsorted(self.key, base | np.maximum(limit, 0), "right" if side > 0 else "left")
            n = np.maximum((far - own - 1) if side > 0 else (own - far), 0)
            ends = np.cumsum(n)
            begin = 0
            while begin < len(n):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + AT_ONCE, "right")))
                k = n[begin:end]
                if k.any():
                    node = np.repeat(usable[begin:end], k)
                    step = np.arange(len(node)) - np.repeat(np.cumsum(k) - k, k)
                    first = np.repeat(own[begin:end] + 1 if side > 0 else far[begin:end], k)
                    at = self.order[first + step]
                    found.append(self.extended(node, np.abs(at - np.repeat(seed[begin:end], k)), side, low, middle, high))
                begin = end
        return np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)

    def extended(self, node, q, side, low, middle, high):
        lo, mid, hi = low[node], middle[node], high[node]
        need = np.maximum(LEAST // 2 - q, (q + 1) // 2)  # the longer side is at least half of the run
        fits = (mid + q + need <= hi) if side > 0 else (mid - q - need >= lo)
        node, q, lo, mid, hi, need = (x[fits] for x in (node, q, lo, mid, hi, need))
        ok = self.same(mid, mid + q, need) if side > 0 else self.same(mid - need, mid - q - need, need)
        node, q, lo, mid, hi = (x[ok] for x in (node, q, lo, mid, hi))
        a, b = (mid, mid + q) if side > 0 else (mid - q, mid)
        s, e = a - self.alike(a, b, a - lo, -1), b + self.alike(a, b, hi - b, 1)
        ok = (s < mid) & (e > mid) & (e - s >= np.maximum(LEAST, TIMES * q))
        return np.stack([node[ok], s[ok], e[ok], q[ok]])


def _smallest(first, s, e, q):
    """Of rows with equal ``first``, start and end, the one with the smallest period."""
    order = np.lexsort((q, e, s, first))
    first, s, e, q = first[order], s[order], e[order], q[order]
    new = np.append(True, (first[1:] != first[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1]))[: len(s)]
    return first[new], s[new], e[new], q[new]


def runs_of(w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs of the texts whose ``n`` word hashes follow each other in ``w``, by start, then end."""
    none = (np.zeros(0, np.int64),) * 3
    begins = np.cumsum(n) - n
    ids = np.unique(w, return_inverse=True)[1]
    nodes, applied = [], []  # (low, middle, high); the places of a rule
    for begin, size in zip(begins.tolist(), n.tolist()):
        if size < LEAST:
            continue
        made, left = rules(ids[begin : begin + size].tolist())
        if made:
            nodes.append(np.array([(at[0], at[0] + part, at[0] + whole) for part, whole, at in made], np.int64).T + begin)
            applied += [(begin, at) for _, _, at in made]
        rest = halves(np.array([*left, size], np.int64)) + begin
        nodes.append(rest)
        applied += [None] * rest.shape[1]
    if not nodes:
        return none
    low, middle, high = np.concatenate(nodes, axis=1)
    long = np.flatnonzero(high - low >= LEAST)
    node, s, e, q = Places(w).crossing(low[long], middle[long], high[long])
    if not len(s):
        return none
    node, s, e, q = _smallest(long[node], s, e, q)
    copies = [np.zeros(1, np.int64) if (x := applied[k]) is None else np.array(x[1], np.int64) - x[1][0] for k in node]
    sizes = [len(c) for c in copies]
    shift = np.concatenate(copies)
    s, e, q = np.repeat(s, sizes) + shift, np.repeat(e, sizes) + shift, np.repeat(q, sizes)
    # stretches with one period that share a period's length are parts of one run
    order = np.lexsort((s, q))
    s, e, q = s[order], e[order], q[order]
    wide = np.int64(len(w) + 1)
    reach = np.maximum.accumulate(q * wide + e)
    new = np.append(True, (q[1:] != q[:-1]) | (q[1:] * wide + s[1:] + q[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    ends = np.append(first[1:], len(s)) - 1
    _, s, e, q = _smallest(np.zeros(len(first), np.int64), s[first], reach[ends] - q[first] * wide, q[first])
    return s, e, q


def collapse_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): each document's runs by start, then period, and its text without the repetitions of a run's first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                data, offsets = buffers(part.column(1))
                s, e, n = spans(~SPACE[data], offsets)
                start, end, period = runs_of(run_hashes(data, s, e), n)
                begins = np.cumsum(n) - n
                order = np.lexsort((period, start))
                start, end, period = start[order], end[order], period[order]
                ends = np.searchsorted(start, np.append(begins, n.sum()))
                texts = []
                for k, text in enumerate(part.column(1).to_pylist()):
                    words = (text or "").encode().split()
                    mine = slice(ends[k], ends[k + 1])
                    if mine.stop > mine.start:
                        keep = np.ones(len(words), bool)
                        for x, y in zip((start[mine] + period[mine] - begins[k]).tolist(), (end[mine] - begins[k]).tolist()):
                            keep[x:y] = False
                        words = list(compress(words, keep.tolist()))
                    texts.append(b" ".join(words).decode())
                owner = np.repeat(np.arange(len(n)), np.diff(ends))
                fields = [pa.array(x) for x in (start - begins[owner], end - start, period)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), lists, pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def with_loops(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of one document in ten, the words from a drawn place on repeat a drawn stretch; the draw is the CRC of the id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    n, a = F.size("w"), F.col("a")
    drawn = drawn.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int")).withColumn("p", (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int"))
    at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % F.col("p"))
    looped = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", at(i))), " ")
    return drawn.select("doc_id", F.when(a.isNotNull(), looped).otherwise(F.col("text")).alias("text"))


def digests(runs: DataFrame) -> DataFrame:
    """Runs and collapsed texts as one line per document: count, the run with most periods, hashes of the rest."""
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    # runs come by start, then period, so the first of those with most periods is taken
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(more(y, x), y).otherwise(x))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    return runs.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
