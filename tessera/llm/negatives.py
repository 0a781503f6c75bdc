"""Hard negatives: for each anchor and positive, the best rows of other labels whose score is a given share of the positive's.

Method.  Anchors are gathered into groups of at most ``GROUP`` that lie near each other, and each group gets a minimum spanning tree of its
vectors.  A block of candidates is scored in full against the root.  Along an edge of length d, a candidate of norm
r has a score within ``d * r`` of its score (or of the bounds of it) at the parent; only candidates whose bounds overlap what the anchor looks for are
scored again, and their bounds become exact.  First that is the least score that can be among the anchor's best of its own label (its positives),
then the windows that the positives' scores open.

Shape.  All rows are dealt into blocks by a hash of the id; groups are sent to every block and read there one after another, behind the block's
rows, so a task holds one block and one group.  No label, vector or id is a key of the shuffle, so none can be hot.  A block reports its best rows per anchor or
anchor and positive; ranks over those reports give the result.

Edge cases.  Rows with a null id, label or vector, or with a null or non-finite component, take no part.  Of rows that share an id one takes part, that with
the smallest label and then the smallest vector.  Of vectors of unlike lengths the shorter counts as followed by zeros.  Scores beyond 64 bits count as the largest or
smallest long.  Ties go to the smaller id; an anchor without positives, or a positive with a score below zero, gives no rows; so does an
empty table.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import cut

EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 100, 5, 10, 30, 90
GROUP = 512
BLOCK = 8192
#: Directions whose signs put near anchors side by side.
SIGNS = 16
EXACT = 2.0**53
LONG = np.iinfo(np.int64)

#: Rows of a block's table: candidates (kind 0) and groups (kind 1).
_KINDS = {
    "part": "int", "kind": "int", "team": "long", "ids": "array<long>", "labels": "array<long>", "v": "array<double>", "parents": "array<long>",
    "edges": "array<double>", "wins": "array<struct<node:int,id:long,score:long>>",
}


def _row(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in _KINDS.items()])


def prepared(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part: components as whole numbers, labels of every seventh id moved on."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col("label").cast("long")
    # doubles from 2**52 on are whole already
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    there = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~odd)
    return there.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: whole(x.cast("double") * 256)).alias("v"),
    )


def matrix(lists: pa.Array) -> np.ndarray:
    """Vectors as rows, the shorter ones followed by zeros."""
    flat, ends = np.asarray(lists.flatten(), np.float64), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def scores(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Whole inner products of the rows of ``x`` with ``a``."""
    m = min(x.shape[1], len(a))
    x, a = x[:, :m], a[:m]
    if m == 0 or np.abs(x).max(initial=0) * np.abs(a).max(initial=0) * m < EXACT:
        return (x @ a).astype(np.int64)
    a = [int(y) for y in a]
    return np.array([min(max(sum(int(p) * q for p, q in zip(row, a)), LONG.min), LONG.max) for row in x], np.int64)


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's tree from row 0, depth first: order of the rows, place of each one's parent in it (-1 for the root), edge lengths."""
    n = len(v)
    near, parent, edge, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n), np.zeros(n, bool)
    now = 0
    for _ in range(n - 1):
        done[now] = True
        d = np.sqrt(np.square(v - v[now]).sum(axis=1))
        closer = ~done & (d < near)
        near[closer], parent[closer] = d[closer], now
        now = int(np.argmin(np.where(done, np.inf, near)))
        edge[now] = near[now]
    children: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        children[parent[k]].append(k)
    order, stack = [], [0]
    while stack:
        order.append(stack.pop())
        stack += children[order[-1]][::-1]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return np.array(order), np.where(parent[order] < 0, -1, place[parent[order]]), edge[order]


def trees(anchors: DataFrame) -> DataFrame:
    """One row per group of near anchors: its first id, ids, labels and vectors in tree order, parents and edge lengths."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(2))
            directions = np.random.Generator(np.random.PCG64(7)).standard_normal((v.shape[1], SIGNS))
            bits = ((v @ directions > 0) << np.arange(SIGNS)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int32()), *b.columns], ["near", *b.schema.names])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), GROUP):
                ids, labels, v = (b.column(k).slice(at, GROUP) for k in (1, 2, 3))
                v = matrix(v)
                order, parents, edges = spanning_tree(v)
                ids, labels = ids.to_numpy()[order], labels.to_numpy()[order]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (ids[0], ids, labels, v[order].ravel(), parents, edges)], ["team", "ids", "labels", "v", "parents", "edges"])

    n = 1 + anchors.count() // 4096
    placed = anchors.mapInArrow(sign, "near int, vec_id long, label long, v array<double>").repartitionByRange(n, "near", "vec_id").sortWithinPartitions("near", "vec_id")
    return cut(placed.mapInArrow(grow, "team long, ids array<long>, labels array<long>, v array<double>, parents array<long>, edges array<double>"))


class Block:
    """Candidates of one block, and the search through a tree of anchors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.lexsort((*x.T[::-1], labels, ids)) if x.shape[1] else np.lexsort((labels, ids))
        order = order[np.append(True, ids[order][1:] != ids[order][:-1])[: len(order)]]
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.norms = np.sqrt(np.square(self.x).sum(axis=1))

    def walk(self, v: np.ndarray, parents: np.ndarray, edges: np.ndarray, wanted):
        """(node, rows, their scores) in tree order; ``wanted(node, low, high)`` says which rows' bounds call for a score."""
        waiting = np.bincount(parents[1:], minlength=len(v)) if len(v) > 1 else np.zeros(len(v), int)
        bounds = {}
        for k, p in enumerate(parents):
            if p < 0:
                low = high = scores(self.x, v[k]).astype(np.float64)
            else:
                slack = edges[k] * self.norms * (1 + 1e-9) + 1
                low, high = bounds[p][0] - slack, bounds[p][1] + slack
                waiting[p] -= 1
                if not waiting[p]:
                    del bounds[p]
            rows = np.flatnonzero(wanted(k, low, high))
            exact = scores(self.x[rows], v[k])
            if waiting[k]:
                low, high = low.copy(), high.copy()
                low[rows] = high[rows] = exact
                bounds[k] = low, high
            yield k, rows, exact

    def best(self, rows: np.ndarray, exact: np.ndarray, n: int):
        if len(rows) > 4 * n:  # ties at the n-th score stay in
            some = exact >= np.partition(exact, len(exact) - n)[len(exact) - n]
            rows, exact = rows[some], exact[some]
        order = np.lexsort((self.ids[rows], -exact.astype(object) if len(exact) and exact.min() == LONG.min else -exact))[:n]
        return self.ids[rows[order]], exact[order]

    def positives(self, team: dict):
        """(anchor, row, score): the best rows of the anchor's label in this block."""

        def wanted(k, low, high):
            mine = (self.labels == team["labels"][k]) & (self.ids != team["ids"][k])
            if mine.sum() <= POSITIVES:
                return mine
            least = np.partition(low[mine], -POSITIVES)[-POSITIVES]
            return mine & (high >= least)

        for k, rows, exact in self.walk(team["v"], team["parents"], team["edges"], wanted):
            for i, s in zip(*self.best(rows, exact, POSITIVES)):
                yield team["ids"][k], i, s, None, None

    def negatives(self, team: dict):
        """(anchor, positive, its score, row, score): the best rows of other labels in each window of this block."""
        windows: dict[int, list] = {}
        for w in team["wins"]:
            if w["score"] >= 0:
                windows.setdefault(w["node"], []).append((-(-LOW * w["score"] // 100), HIGH * w["score"] // 100, w["id"], w["score"]))

        def wanted(k, low, high):
            hit = np.zeros(len(self.ids), bool)
            for least, most, _, _ in windows.get(k, ()):
                hit |= (high >= least) & (low <= most)
            return hit & (self.labels != team["labels"][k])

        for k, rows, exact in self.walk(team["v"], team["parents"], team["edges"], wanted):
            for least, most, positive, score in windows.get(k, ()):
                inside = (exact >= least) & (exact <= most)
                for i, s in zip(*self.best(rows[inside], exact[inside], NEGATIVES)):
                    yield team["ids"][k], positive, score, i, s


def reports(rows: DataFrame, groups: DataFrame, parts: int, what: str) -> DataFrame:
    """(anchor_id, id, score, negative_id, negative_score): what the blocks find for all groups."""
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts))
    one = _row(rows, part=part, kind=F.lit(0), ids=F.array("vec_id"), labels=F.array("label"), v=F.col("v"))
    every = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    many = _row(every, part=F.col("part"), kind=F.lit(1), **{c: F.col(c) for c in groups.columns})
    dealt = one.unionByName(many).repartition(parts, "part").sortWithinPartitions("part", "kind", "team")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, gathered = None, None, []
        for b in batches:
            kinds, places = b.column(1).to_numpy(), b.column(0).to_numpy()
            turns = np.flatnonzero(np.append(True, (kinds[1:] != kinds[:-1]) | (places[1:] != places[:-1])))
            for at, end in zip(turns, np.append(turns[1:], len(b))):
                piece = b.slice(at, end - at)
                if places[at] != now:
                    now, block, gathered = places[at], None, []
                if kinds[at] == 0:
                    gathered.append((piece.column(3).flatten().to_numpy(), piece.column(4).flatten().to_numpy(), piece.column(5)))
                    continue
                if block is None and gathered:
                    lists = pa.concat_arrays([g[2] for g in gathered])
                    block = Block(np.concatenate([g[0] for g in gathered]), np.concatenate([g[1] for g in gathered]), matrix(lists))
                    gathered = []
                for k in range(len(piece) if block else 0):
                    ids, labels, v, parents, edges = (np.asarray(piece.column(c)[k].values) for c in (3, 4, 5, 6, 7))
                    team = {"ids": ids, "labels": labels, "v": v.reshape(len(ids), -1), "parents": parents, "edges": edges, "wins": piece.column(8)[k].as_py() or []}
                    found = list(getattr(block, what)(team))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["anchor_id", "id", "score", "negative_id", "negative_score"])

    return dealt.mapInArrow(run, "anchor_id long, id long, score long, negative_id long, negative_score long")


def mine(embeddings: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    rows = prepared(embeddings)
    once = rows.where(F.col("vec_id") % EVERY == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.label", "m.v")
    groups = trees(once)
    parts = 1 + rows.count() // BLOCK

    own = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    positives = cut(reports(rows, groups, parts, "positives").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= POSITIVES).select("anchor_id", "id", "score"))
    members = groups.select("team", F.posexplode("ids").alias("node", "anchor_id"))
    wins = members.join(positives, "anchor_id").groupBy("team").agg(F.collect_list(F.struct("node", "id", "score")).alias("wins"))  # at most POSITIVES * GROUP
    pair = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = reports(rows, groups.join(wins, "team"), parts, "negatives").withColumnsRenamed({"id": "positive_id", "score": "positive_score"})
    return found.withColumn("rank", F.row_number().over(pair)).where(F.col("rank") <= NEGATIVES).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
