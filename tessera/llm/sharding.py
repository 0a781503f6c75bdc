"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

Method.  Shards are leaves of a tree of regions and racks; the weight of an inner node is the sum of its leaves'.  A row
descends from the root: at each level every child draws ``-ln(u) / weight`` with u from a hash of (key, child), and the smallest draw wins.
So a child gets its share of the weight, a child's draw depends on nothing but its own name and weight, and a changed weight moves rows
only into (or out of) the subtree that holds the change.  Shards beyond the base tree each open a region of
their own, so that one more shard takes rows into itself and moves no other.

Slots.  Rows of a shard are numbered without a gap in the order of (cell, doc_id, ...), where a cell is a hash range of doc_id.
The number of cells grows with the rows, their counts are added up per shard, and only the rows of one cell are ever sorted
together; rows that repeat one key are split further by a running id.

Edge cases.  A null text counts 16 bytes and crc32 0; a null doc_id is a key like any other; repeated rows share a shard and get slots of their own;
an empty table gives no rows; of extra columns none is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import SMALL_SIDE
from tessera.session import cut

REGIONS, RACKS, LEAVES = 5, 2, 4
#: Rows that are numbered by one window at most, about.
CELL_ROWS = 20_000
OVERHEAD = 16

Tree = dict[int, dict[int, dict[int, float]]]


def tree(shards: int, weights: Sequence[float] | None = None) -> Tree:
    """region -> rack -> shard -> weight for shards numbered from 0."""
    weights = weights or [1.0] * shards
    base, found = REGIONS * RACKS * LEAVES, {}
    for s in range(shards):
        region, rack = (s // (RACKS * LEAVES), s // LEAVES % RACKS) if s < base else (REGIONS + s - base, 0)
        found.setdefault(region, {}).setdefault(rack, {})[s] = float(weights[s])
    return found


def _winner(key: Column, level: str, children: dict[int, float]) -> Column:
    """The child with the smallest weighted draw; ties, practically impossible, go to the smaller number."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    span = float(1 << 53)

    def draw(child: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level}{child}")), 11).cast("double") + 0.5) / span
        return F.struct((-F.log(u) / weight).alias("draw"), F.lit(child).alias("child"))

    return F.array_min(F.array(*[draw(c, w) for c, w in sorted(children.items())]))["child"]


def shard_of(key: Column, t: Tree) -> Column:
    """The leaf that ``key`` descends to."""

    def weight(node) -> float:
        return sum(map(weight, node.values())) if isinstance(node, dict) else node

    def chosen(pick: Column, options: dict[int, Column]) -> Column:
        if len(options) == 1:
            return next(iter(options.values()))
        out = F.when(F.lit(False), F.lit(0))
        for number, value in options.items():
            out = out.when(pick == number, value)
        return out

    racks = {
        region: chosen(
            _winner(key, f"k{region}-", {k: weight(v) for k, v in under.items()}),
            {rack: _winner(key, f"s{region}-{rack}-", leaves) for rack, leaves in under.items()},
        )
        for region, under in t.items()
    }
    return chosen(_winner(key, "r", {k: weight(v) for k, v in t.items()}), racks).cast("int")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32): UTF-8 bytes of the text and OVERHEAD, unsigned checksum of the text."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))


def with_slots(rows: DataFrame, shard: str = "shard", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds ``slot``, a gapless number of each row within its shard; ``rows`` must have been cut."""
    cells = max(1, rows.count() // (cell_rows * 16))
    # running ids of a stored table do not change when a task is repeated
    placed = rows.withColumn("__id", F.monotonically_increasing_id()).withColumn("__cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells)))
    per_key = rows.groupBy("doc_id").count().where(F.col("count") > cell_rows)
    if per_key.isEmpty():
        placed = placed.withColumn("__part", F.lit(0).cast("long"))
    else:
        hot = F.broadcast(per_key) if per_key.count() * 64 < SMALL_SIDE else per_key
        marked = placed.join(hot.select(F.struct("doc_id").alias("__k"), F.lit(True).alias("__hot")), F.struct("doc_id") == F.col("__k"), "left")
        # the high bits of a running id are its task, and a task's ids are dense
        placed = marked.withColumn("__part", F.when(F.col("__hot"), F.floor(F.col("__id") / cell_rows)).otherwise(0)).drop("__k", "__hot")
    counts = placed.groupBy(shard, "__cell", "__part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(shard).orderBy("__cell", "__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(counts.select(shard, "__cell", "__part", before.alias("__start")))
    starts = F.broadcast(starts) if starts.count() * 64 < SMALL_SIDE else starts
    order = Window.partitionBy(shard, "__cell", "__part").orderBy("doc_id", "__id")
    numbered = placed.withColumn("__k", F.row_number().over(order) - 1)
    return numbered.join(starts, [shard, "__cell", "__part"]).withColumn("slot", F.col("__start") + F.col("__k")).drop("__id", "__cell", "__part", "__k", "__start")


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document, under the law ``key``."""
    key = F.col("doc_id")
    rows = sizes(docs).select(
        "*", F.lit("key").alias("law"), shard_of(key, tree(shards)).alias("shard"), shard_of(key, tree(shards + 1)).alias("grown_shard")
    )
    return with_slots(cut(rows)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
