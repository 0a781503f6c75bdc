"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Method.  Documents become pieces of at most ``capacity`` tokens.  Pieces are dealt into groups of about ``GROUP``; a group
is packed by ``ISLANDS`` independent populations (one Spark row each).  A solution is a list of bins.  Crossover injects
whole well-filled bins of one parent into the other, removes the bins that then hold a piece twice, and puts the displaced pieces
back by best fit, longest first; mutation empties the worst bins the same way.  Between epochs each island receives
the elite of its neighbour.  The best island's bins count.

Levels.  Well-filled bins of a group are final.  The pieces of the other bins of all groups form the next, much smaller
level and are dealt and packed again, until one group is left or packing them anew would not save a sequence worth the pass.  So no
task or group grows with the input, and only a last handful of sequences stays partly empty.

Edge cases.  A null or empty text is the end token alone; repeated rows and ids are separate documents; an empty table packs into
nothing; pieces of full length are sequences of their own.  Other columns are ignored.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidied
from tessera.llm.text import slices
from tessera.llm.tokens import word_ids
from tessera.session import cut

CAPACITY = 2048
GROUP = 2048
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 6
POPULATION = 4
#: A bin with at most this share of free tokens is well filled.
FREE = 0.01

ITEM = "struct<doc_id:long,piece:int,start:long,length:int,ids_crc32:long>"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and the end token 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path)
        for b in batches:
            for part in slices(b, "text"):
                rows, piece, start, length, crc = [], [], [], [], []
                ids, ends = known.of_all(part.column("text"))
                # the end token behind every document
                ids = np.insert(ids, ends, 0)
                data = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
                at = 0
                for r, end in enumerate((ends + np.arange(1, len(ends) + 1)).tolist()):
                    for k in range(at, end, capacity):
                        stop = min(end, k + capacity)
                        rows.append(r), piece.append((k - at) // capacity), start.append(k - at)
                        length.append(stop - k), crc.append(zlib.crc32(data[4 * k : 4 * stop]))
                    at = end
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, piece int, start long, length int, ids_crc32 long")


class Packer:
    """Solutions of one group: a solution is a list of bins, a bin a tuple of item numbers."""

    def __init__(self, lengths: list[int], capacity: int, seed: int):
        self.lengths, self.capacity, self.draw = lengths, capacity, random.Random(seed)

    def free(self, items) -> int:
        return self.capacity - sum(self.lengths[i] for i in items)

    def insert(self, bins: list[tuple], displaced: list[int]) -> list[tuple]:
        """Best fit: each item, longest first, goes where the least room is left."""
        made = [list(b) for b in bins]
        by_room: dict[int, list[int]] = {}
        rooms = 0  # a bit for each room that some bin has
        for k, b in enumerate(made):
            room = self.free(b)
            by_room.setdefault(room, []).append(k)
            rooms |= 1 << room
        for i in sorted(displaced, key=lambda i: -self.lengths[i]):
            size = self.lengths[i]
            fitting = rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                k = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
                made[k].append(i)
            else:
                room, k = self.capacity, len(made)
                made.append([i])
            by_room.setdefault(room - size, []).append(k)
            rooms |= 1 << (room - size)
        return [tuple(b) for b in made]

    def fitness(self, bins: list[tuple]) -> tuple[int, float]:
        """Fewer bins first, then fuller ones; smaller is better."""
        return len(bins), -sum((1 - self.free(b) / self.capacity) ** 2 for b in bins)

    def first(self) -> list[list[tuple]]:
        """Best fit, longest first, and variants that start from randomly kept bins."""
        best = self.insert([], list(range(len(self.lengths))))
        return [best] + [self.mutate(best, 0.3) for _ in range(POPULATION - 1)]

    def cross(self, a: list[tuple], b: list[tuple]) -> list[tuple]:
        good = [x for x in b if self.free(x) <= FREE * self.capacity] or sorted(b, key=self.free)[:1]
        given = self.draw.sample(good, max(1, len(good) // 4))
        inside = {i for x in given for i in x}
        kept = [x for x in a if inside.isdisjoint(x)]
        displaced = [i for x in a if not inside.isdisjoint(x) for i in x if i not in inside]
        return self.insert(kept + given, displaced)

    def mutate(self, a: list[tuple], share: float = 0.05) -> list[tuple]:
        """Empties the least filled bins and a few others."""
        order = sorted(a, key=self.free)
        worst = order[len(order) - max(1, int(len(order) * share)) :]
        rest = order[: len(order) - len(worst)]
        k = min(len(rest), max(1, len(worst) // 2))
        also = set(self.draw.sample(range(len(rest)), k))
        return self.insert([x for j, x in enumerate(rest) if j not in also], [i for x in worst for i in x] + [i for j in also for i in rest[j]])

    def evolve(self, start: list[list[tuple]], generations: int) -> list[tuple]:
        population = sorted(start, key=self.fitness)[:POPULATION]
        least = -(-sum(self.lengths) // self.capacity)
        for _ in range(generations):
            if len(population[0]) <= least and len(population) > 1 and self.fitness(population[0]) == self.fitness(population[1]):
                break
            children = [self.cross(*self.draw.sample(population, 2)) for _ in range(POPULATION // 2)] if len(population) > 1 else []
            children.append(self.mutate(population[0]))
            population = sorted(population + children, key=self.fitness)[:POPULATION]
        return population[0]


def _bins(numbers: list[int]) -> list[tuple]:
    found: dict[int, list[int]] = {}
    for i, k in enumerate(numbers):
        found.setdefault(k, []).append(i)
    return [tuple(found[k]) for k in sorted(found)]


def evolved(islands: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """One epoch of every island: rows (grp, island, lengths, own, guest) to (grp, island, lengths, own); bin numbers per item."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                p = Packer(row["lengths"], capacity, hash((row["grp"], row["island"], epoch)))
                start = p.first()
                for known in (row["own"], row["guest"]):
                    if known is not None:
                        bins = _bins(known)
                        start += [bins, p.mutate(bins)]
                best = p.evolve(start, GENERATIONS)
                own = np.empty(len(row["lengths"]), np.int32)
                for k, x in enumerate(best):
                    own[list(x)] = k
                score = p.fitness(best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["grp"]], pa.int64()), pa.array([row["island"]], pa.int32()), pa.array([row["lengths"]], pa.list_(pa.int32())), pa.array([own.tolist()], pa.list_(pa.int32())), pa.array([score[0]], pa.int32()), pa.array([score[1]], pa.float64())],
                    ["grp", "island", "lengths", "own", "n_bins", "loss"],
                )

    return islands.select("grp", "island", "lengths", "own", "guest").mapInArrow(tidied(run), "grp long, island int, lengths array<int>, own array<int>, n_bins int, loss double")


def pack_level(items: DataFrame, groups: int, capacity: int, tasks: int) -> DataFrame:
    """(grp, bin, room, items): the bins of all groups, with their free tokens."""
    # rows are dealt by place, so copies of one document do not meet in one group
    dealt = items.select("item", F.pmod(F.xxhash64(F.monotonically_increasing_id(), "item"), F.lit(groups)).alias("grp"))
    grouped = cut(dealt.groupBy("grp").agg(F.collect_list("item").alias("items")))
    own = F.lit(None).cast("array<int>")
    islands = (
        grouped.select("grp", F.col("items.length").alias("lengths"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
        .withColumns({"own": own, "guest": own})
    )
    for epoch in range(EPOCHS):
        state = cut(evolved(islands.repartition(tasks, "grp", "island"), capacity, epoch))
        guests = state.select("grp", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("own").alias("guest"))
        islands = state.select("grp", "island", "lengths", "own").join(guests, ["grp", "island"])
    best = state.groupBy("grp").agg(F.min_by("own", F.struct("n_bins", "loss", "island")).alias("own"))
    placed = grouped.join(best, "grp").select("grp", F.explode(F.arrays_zip("items", "own")).alias("x")).select("grp", F.col("x.own").alias("bin"), F.col("x.items").alias("item"))
    return placed.groupBy("grp", "bin").agg((capacity - F.sum("item.length")).alias("room"), F.collect_list("item").alias("items"))


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for the rows of ``pieces``."""
    item = F.struct(*[F.col(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]).cast(ITEM).alias("item")
    all_items = cut(items.select(item))
    tasks = int(all_items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = F.col("item.length") == capacity
    done = [all_items.where(full).select((-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.array("item").alias("items"))]
    rest = all_items.where(~full)
    level, n = 0, rest.count()
    while n:
        groups = max(1, round(n / group))
        bins = cut(pack_level(rest, groups, capacity, max(1, min(tasks, groups * ISLANDS))))
        name = (F.lit(level << 58) + F.col("grp") * (1 << 20) + F.col("bin")).alias("sequence_id")
        last = groups == 1
        if not last:
            open_bins = bins.where(F.col("room") > FREE * capacity)
            found = open_bins.agg(F.count(F.lit(1)).alias("bins"), F.sum("room").alias("room"), F.sum(F.size("items")).alias("items")).first()
            # a sequence can be saved only where the free tokens together make one up, and a next level must be smaller
            last = not found.bins or found.room < capacity or found.items > 0.7 * n
        done.append((bins if last else bins.where(F.col("room") <= FREE * capacity)).select(name, "items"))
        if last:
            break
        rest, n, level = open_bins.select(F.explode("items").alias("item")), found["items"], level + 1
    sequences = done[0]
    for d in done[1:]:
        sequences = sequences.unionByName(d)
    at = F.posexplode("items").alias("k", "item")
    before = F.aggregate(F.slice("items", 1, F.col("k")), F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return (
        sequences.select("sequence_id", "items", at)
        .select("item.doc_id", "item.piece", "item.start", F.col("item.length").cast("long").alias("length"), "item.ids_crc32", "sequence_id", before.alias("offset"))
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public tokenizer file lies; the executors' installation has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, path or tokenizer_path(), capacity), capacity)
