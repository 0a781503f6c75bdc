"""Components and constrained merging on edge tables.

Components work in rounds of joins and minima over the edges, so a component of any size stays distributed; the number of
rounds grows with the logarithm of the longest chain.  Merging works on blocks of bounded size.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tessera.operators.tiles import HELD_ROWS
from tessera.session import cut


def connected(edges: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """(keys, node, root): the smallest node of every component of an undirected graph."""
    keys = list(keys)
    both = edges.select(*keys, F.col(a).alias("u"), F.col(b).alias("v"))
    both = cut(both.unionByName(both.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    state = both.groupBy(*keys, F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("root"))
    while True:  # ends: roots only fall
        near = (
            both.join(state.select(*keys, F.col("node").alias("v"), "root"), [*keys, "v"])
            .groupBy(*keys, F.col("u").alias("node")).agg(F.min("root").alias("near"))
        )
        hooked = state.join(near, [*keys, "node"]).select(
            *keys, "node", F.col("root").alias("was"), F.least("root", "near").alias("mid")
        )
        # a root that lost takes its members along, then everybody follows the pointer once
        moved = hooked.groupBy(*keys, F.col("was").alias("node")).agg(F.min("mid").alias("to"))
        hooked = hooked.join(moved, [*keys, "node"], "left").select(
            *keys, "node", "was", F.least("mid", F.coalesce("to", "mid")).alias("mid")
        )
        up = hooked.select(*keys, F.col("node").alias("mid"), F.col("mid").alias("up"))
        step = cut(
            hooked.join(up, [*keys, "mid"], "left").select(
                *keys, "node", F.least("mid", F.coalesce("up", "mid")).alias("root"), "was"
            )
        )
        state = step.drop("was")
        if step.where("root <> was").isEmpty():
            return state


#: An image with at most so many edges is merged in one task; a larger one in blocks of so many node numbers.
BLOCK_EDGES, BLOCK_NODES = 1 << 18, 1 << 16

Edge = namedtuple("Edge", "a b weight ra rb la lb cap inside")


def merge_weakest_first(
    edges: DataFrame, nodes: DataFrame, keys: Sequence[str], cap: Column, block_edges: int = BLOCK_EDGES, block_nodes: int = BLOCK_NODES,
) -> tuple[DataFrame, DataFrame]:
    """Union nodes along edges (keys, a, b, weight), weakest first, unless the union exceeds ``cap``.

    ``nodes`` is (keys, node, load).  Returns (keys, node, root) and the accepted edges.  Equal weights are taken by (a, b).

    What happens to an edge depends on lower edges at its two ends only.  So a task that holds the edges between the nodes of one block
    can settle them in order, up to the first edge at either end that leaves the block.  An image of ``block_edges`` edges or
    fewer is one block and is done after one round, however long its chains are.  A larger image is cut into ranges of
    ``block_nodes`` node numbers, shifted from round to round, and edges that rank first at both of their ends are taken between the
    rounds, so every round settles at least one edge of each image.  Loads only grow: an edge over the cap never comes back.
    """
    keys = list(keys)
    state = cut(nodes.select(*keys, "node", F.col("node").cast("bigint").alias("root"), F.col("load").cast("bigint").alias("load")))
    ends = [F.col(c).cast("bigint") for c in ("a", "b")]
    open_edges = edges.select(*keys, "a", "b", F.col("weight").cast("double").alias("weight"), ends[0].alias("ra"), ends[1].alias("rb"))
    accepted = []
    turn = 0
    while True:  # ends: each round settles an edge or finds none
        live = cut(_live(open_edges, state, keys, cap))
        if live.isEmpty():
            break
        taken, moved, rest, whole = _merge_blocks(live, keys, cap, block_edges, block_nodes, turn)
        accepted.append(taken)
        state = cut(_moved(state, moved, keys))
        if whole:
            break
        live = cut(_live(rest, state, keys, cap))
        if live.isEmpty():
            break
        taken, moved = _merge_first_at_both_ends(live, keys)
        accepted.append(taken)
        state = cut(_moved(state, moved, keys))
        open_edges = cut(_renamed(live, moved, keys))
        turn += 1
    taken = edges.select(*keys, "a", "b", F.col("weight").cast("double").alias("weight")).limit(0)
    for more in accepted:
        taken = taken.unionByName(more)
    return state.select(*keys, "node", "root"), taken


def _live(edges: DataFrame, state: DataFrame, keys: list[str], cap: Column) -> DataFrame:
    """Edges between different unions that could still be joined, with the loads of both."""
    loads = state.where("node = root").select(*keys, F.col("root").alias("r"), "load")
    return (
        edges.select(*keys, "a", "b", "weight", "ra", "rb")
        .join(loads.select(*keys, F.col("r").alias("ra"), F.col("load").alias("la")), [*keys, "ra"])
        .join(loads.select(*keys, F.col("r").alias("rb"), F.col("load").alias("lb")), [*keys, "rb"])
        .where((F.col("ra") != F.col("rb")) & (F.col("la") + F.col("lb") <= cap))
    )


def _moved(state: DataFrame, moved: DataFrame, keys: list[str]) -> DataFrame:
    """The state after unions ``root`` became part of ``keep`` with the load ``sum``."""
    return state.join(moved, [*keys, "root"], "left").select(
        *keys, "node", F.coalesce("keep", "root").alias("root"), F.coalesce("sum", "load").alias("load")
    )


def _renamed(edges: DataFrame, moved: DataFrame, keys: list[str]) -> DataFrame:
    out = edges.select(*keys, "a", "b", "weight", "ra", "rb")
    for end in ("ra", "rb"):
        out = out.join(moved.select(*keys, F.col("root").alias(end), "keep"), [*keys, end], "left").withColumn(
            end, F.coalesce("keep", end)
        ).drop("keep")
    return out


def _merge_blocks(live: DataFrame, keys: list[str], cap: Column, block_edges: int, block_nodes: int, turn: int):
    """(accepted edges, moves, edges left, whether nothing is left): every block merged as far as its own edges tell."""
    counts = cut(live.groupBy(*keys).agg((F.count(F.lit(1)) > block_edges).alias("wide")))
    whole = counts.where("wide").isEmpty()
    shift = (turn % 2) * (block_nodes // 2)

    def block(end: str) -> Column:
        return F.when(F.col("wide"), F.floor((F.col(end) + shift) / block_nodes)).otherwise(F.lit(0)).cast("bigint")

    placed = live.join(counts, keys).withColumn("block", block("ra")).withColumn("other", block("rb")).withColumn("cap", cap.cast("bigint"))
    columns = [*keys, "block", "a", "b", "weight", "ra", "rb", "la", "lb", "cap", "inside"]
    rows = placed.where("block = other").withColumn("inside", F.lit(True)).select(columns)
    across = placed.where("block <> other")
    if not whole:
        # of the edges that leave a block only the first one at each end matters
        rank = F.struct("weight", "a", "b").alias("rank")
        sides = across.select(*keys, "block", F.col("ra").alias("r"), rank).unionByName(across.select(*keys, F.col("other").alias("block"), F.col("rb").alias("r"), rank))
        first = sides.groupBy(*keys, "block", "r").agg(F.min("rank").alias("rank"))
        rows = rows.unionByName(first.select(
            *keys, "block", F.col("rank.a").alias("a"), F.col("rank.b").alias("b"), F.col("rank.weight").alias("weight"), F.col("r").alias("ra"), F.col("r").alias("rb"),
            *[F.lit(0).cast("bigint").alias(c) for c in ("la", "lb", "cap")], F.lit(False).alias("inside"),
        ))
    fields = [StructField("kind", StringType()), *[StructField(c, LongType()) for c in ("a", "b")], StructField("weight", DoubleType()),
              *[StructField(c, LongType()) for c in ("ra", "rb", "sum")]]
    schema = StructType([live.schema[c] for c in keys] + fields)

    at, ends = [*keys, "block"], columns[len(keys) + 1:]

    def settle(batches):
        # a block may lie in several batches, and a batch usually holds many blocks: rows of one block follow each other
        group, held, out = None, [], []
        for pdf in batches:
            for where, row in zip(zip(*[pdf[c].tolist() for c in at]), zip(*[pdf[c].tolist() for c in ends])):
                if where != group:
                    out += [(*group[: len(keys)], *r) for r in settled(held)] if held else []
                    group, held = where, []
                    if len(out) >= HELD_ROWS:
                        yield _frame(out, schema)
                        out = []
                held.append(row)
        if held:
            out += [(*group[: len(keys)], *r) for r in settled(held)]
        if out:
            yield _frame(out, schema)

    # edges that leave the block come first, then the others in their order
    placed = rows.repartition(*at).sortWithinPartitions(*at, "inside", "weight", "a", "b")
    done = cut(placed.mapInPandas(settle, schema))
    taken = done.where("kind = 'taken'").select(*keys, "a", "b", "weight")
    moved = done.where("kind = 'moved'").select(*keys, F.col("ra").alias("root"), F.col("rb").alias("keep"), "sum")
    left = done.where("kind = 'left'").select(*keys, "a", "b", "weight", "ra", "rb")
    return taken, moved, left if whole else left.unionByName(_renamed(across, moved, keys)), whole


def _frame(rows: list[tuple], schema: StructType) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=schema.fieldNames()).astype({c: "Int64" for c in ("a", "b", "ra", "rb", "sum")})


def settled(rows: list[tuple]) -> list[tuple]:
    """(kind, a, b, weight, ra, rb, sum) of one block: accepted edges, moved unions, and edges that wait for one outside of the block.

    ``rows`` are (a, b, weight, ra, rb, la, lb, cap, inside): those that leave the block first, then the others by (weight, a, b).
    """
    parent: dict[int, int] = {}
    load: dict[int, int] = {}
    waits: dict[int, tuple] = {}  # the first edge at a union that is not settled here

    def find(u: int) -> int:
        top = u
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(u, u) != top:
            parent[u], u = top, parent[u]
        return top

    def wait(u: int, rank: tuple) -> None:
        waits[u] = min(waits.get(u, rank), rank)

    taken, left = [], []
    for e in map(Edge._make, rows):
        if not e.inside:
            wait(e.ra, (e.weight, e.a, e.b))
            continue
        for u, n in ((e.ra, e.la), (e.rb, e.lb)):
            parent.setdefault(u, u)
            load.setdefault(u, n)
        u, v = find(e.ra), find(e.rb)
        rank = (e.weight, e.a, e.b)
        if u == v or load[u] + load[v] > e.cap:
            continue
        if any(w in waits and waits[w] < rank for w in (u, v)):
            wait(u, rank), wait(v, rank)
            left.append(e)
            continue
        keep, gone = min(u, v), max(u, v)
        parent[gone] = keep
        load[keep] += load[gone]
        if gone in waits:
            wait(keep, waits[gone])
        taken.append(("taken", e.a, e.b, e.weight, None, None, None))
    tops = {u: find(u) for u in parent}
    joined = set(u for u, top in tops.items() if u != top) | set(top for u, top in tops.items() if u != top)
    moved = [("moved", None, None, None, u, tops[u], load[tops[u]]) for u in joined]
    return taken + moved + [("left", e.a, e.b, e.weight, find(e.ra), find(e.rb), None) for e in left]


def _merge_first_at_both_ends(live: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted edges, moves): edges that rank first at both of their ends."""
    e = live.withColumn("rank", F.struct("weight", "a", "b"))
    ends = e.select(*keys, F.col("ra").alias("r"), "rank").unionByName(e.select(*keys, F.col("rb").alias("r"), "rank"))
    first = ends.groupBy(*keys, "r").agg(F.min("rank").alias("first"))
    now = cut(
        e.join(first.select(*keys, F.col("r").alias("ra"), F.col("first").alias("fa")), [*keys, "ra"])
        .join(first.select(*keys, F.col("r").alias("rb"), F.col("first").alias("fb")), [*keys, "rb"])
        .where("rank = fa and rank = fb")
        .select(*keys, "a", "b", "weight", F.least("ra", "rb").alias("keep"), F.greatest("ra", "rb").alias("gone"), (F.col("la") + F.col("lb")).alias("sum"))
    )
    moved = now.select(*keys, F.explode(F.array("gone", "keep")).alias("root"), "keep", "sum")
    return now.select(*keys, "a", "b", "weight"), moved
