"""Near-duplicate documents by a grouped prefix join on five-word shingles.

Method.  A text is the set of its distinct shingle hashes (64 bits).  All sets are ordered by one global order,
rare shingles first, so two sets with Jaccard similarity of at least ``percent`` share an element of their
prefixes.  Documents with equal sets are one *node*; nodes with equal prefix and size are one *group*, and only
groups are indexed and filtered (by size and by the number of shared prefix elements).  Pairs of groups that pass are expanded to
their nodes, and every expanded pair is verified on whole sets.

Hot groups.  Thousands of near copies share many prefix elements.  Their pairs are not enumerated: first every node is
verified against one leader (of its group, or, of the leaders of its prefix elements, the one it shares most of them with; an element's
leader is the group with most elements that others hold too, so it stands in the middle of its family), which joins a family by one link per node.  Afterwards only pairs whose nodes lie in different components can add anything,
and exactly those are expanded and verified, with the smaller side of each prefix element as the driving side.  No pair that
passes the filters is skipped unless its nodes are connected already, so components are exact.

The order.  Counts of all shingles of all documents, kept in a table of ``2**SKETCH_BITS`` cells addressed by the hash
(2 MB at any input size), then the hash.  Any function of the shingle gives right results; this one puts passages that
many documents share last.

Edge cases.  Null, empty and blank texts have an empty set and link with nothing; rows with the same doc_id are separate
documents with one id; a null doc_id is never smaller than another; extra columns are ignored by ``near_duplicates`` and kept
by ``one_of_each``, which decides by row, also where an id stands beside several texts.  Sets are compared by 64-bit hashes: two different shingles of one pair collide with a chance of about n * n / 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from pyspark.sql.window import Window

from tessera.llm.common import beside, components, tidied
from tessera.llm.text import FINE, mix, shingles, slices, words
from tessera.session import cut

SKETCH_BITS = 18
_SHIFT = np.uint64(64 - SKETCH_BITS)


def sets_of(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    w, counts = words(column)
    end = 0
    for n in counts:
        end += n
        yield shingles(w[end - n : end], size)


def node_of(s: np.ndarray) -> np.int64:
    """One number for a set: equal sets have equal numbers."""
    total = np.array([s.sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)
    return (mix(total) ^ np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))))[0].view(np.int64)


def shingle_counts(docs: DataFrame, size: int = 5) -> np.ndarray:
    """How many (document, shingle) pairs fall into each cell; an array of fixed size, from all documents."""

    def run(batches):
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            for part in slices(b, "text", FINE):
                found = [s >> _SHIFT for s in sets_of(part.column(0), size)]
                cells += np.bincount(np.concatenate(found).astype(np.int64), minlength=len(cells))
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(cells[at])], ["cell", "n"])

    rows = docs.select("text").mapInArrow(tidied(run), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cells = np.zeros(1 << SKETCH_BITS, np.int64)
    cells[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return cells


def prefixes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, node, n, prefix): the set's number, its size, and its rarest elements in the global order."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, size))

    def run(batches):
        cells = counts.value
        for b in batches:
            for part in slices(b, "text", FINE):
                node, n, prefix, ends = [], [], [], [0]
                for s in sets_of(part.column(1), size):
                    k = len(s)
                    length = k - -(-percent * k // 100) + 1 if k else 0
                    order = np.argsort(cells[s >> _SHIFT], kind="stable")[:length]  # s is sorted: ties by hash
                    node.append(node_of(s))
                    n.append(k)
                    prefix.append(s[order].view(np.int64))
                    ends.append(ends[-1] + length)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefix)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node, pa.int64()), pa.array(n, pa.int64()), lists], ["doc_id", "node", "n", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, node long, n long, prefix array<long>")


def whole_sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(node, items): sets of the nodes in ``members`` (doc_id, node), computed again from the texts of one document each."""

    def run(batches):
        for b in batches:
            for part in slices(b, "text", FINE):
                keep, items, ends = [], [], [0]
                for want, s in zip(part.column(1).to_pylist(), sets_of(part.column(0), size)):
                    if len(s) and node_of(s) == want:
                        keep.append(want)
                        items.append(s.view(np.int64))
                        ends.append(ends[-1] + len(s))
                if keep:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(items)))
                    yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), lists], ["node", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # a null id stands for itself here
    texts, members = (t.withColumn("doc_id", F.struct("doc_id")) for t in (texts, members))
    texts = beside(texts, members, "doc_id", "inner", 32)
    return texts.select("text", "node").mapInArrow(tidied(run), "node long, items array<long>")


def sets_for(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """Sets of all nodes in the pairs (a, b)."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = cut(ends.join(nodes, "node").select(F.col("least").alias("doc_id"), "node"))
    found = cut(whole_sets(docs, wanted, size))
    return found if found.count() == wanted.count() else found.dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of nodes, those whose whole sets are similar enough."""
    shared = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
        .where(100 * shared >= percent * (F.size("x") + F.size("y") - shared))
        .select("a", "b").distinct()
    )


def _needed(n: str, m: str, percent: int):
    """How many prefix elements two sets of sizes n and m must share at least, if they are similar enough.

    Of the prefix that ends earlier in the global order, all elements that the other set holds lie in the other prefix
    too, and at most (size - overlap) elements are missing there.
    """
    overlap = F.ceil((F.col(n) + F.col(m)) * percent / (100 + percent) - 1e-9)
    spare = [overlap - F.ceil(F.col(c) * percent / 100 - 1e-9) + 1 for c in (n, m)]  # prefix length - (size - overlap)
    return F.greatest(F.lit(1), F.least(*spare))


def _fits(n: str, m: str, percent: int):
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, node, n, root, component_id) for every row of documents (doc_id, text); rows of one component have one root."""
    rows = cut(prefixes(docs, size, percent))
    filled = rows.where("n > 0")
    least = cut(filled.groupBy("node").agg(F.min("doc_id").alias("least")))
    first = beside(filled.select("doc_id", "node", "n", "prefix"), least, "node", "inner", 32).where(F.col("doc_id").eqNullSafe(F.col("least")))
    nodes = cut(first.select("node", "n", "least", F.xxhash64("n", "prefix").alias("grp")).distinct())
    heads = cut(nodes.groupBy("grp", "n").agg(F.min("node").alias("head")))
    chosen = beside(first.drop("n"), heads.select(F.col("head").alias("node"), "grp"), "node", "inner", 32)
    if first.count() > nodes.count():  # rows that repeat an id and a text
        chosen = chosen.dropDuplicates(["node"])
    entries = chosen.select("grp", F.posexplode("prefix").alias("place", "item"))
    shared = entries.groupBy("item").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1").select("item")
    entries = cut(entries.join(shared, "item"))  # an element of one group alone pairs nothing

    # one link per node: group members to their head, heads to the leader with which they share most elements
    inside = nodes.select("grp", "node").join(heads, "grp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    met = cut(entries.groupBy("grp").agg(F.count(F.lit(1)).alias("met")))  # elements that others hold too: most in the middle of a family
    leaders = entries.join(met, "grp").groupBy("item").agg(F.max_by("grp", F.struct("met", "grp")).alias("leader"))
    lead = (
        entries.join(leaders, "item").where("grp <> leader").groupBy("grp", "leader").agg(F.count(F.lit(1)).alias("c"))
        .join(heads.select("grp", "n", "head"), "grp")
        .join(heads.select(F.col("grp").alias("leader"), F.col("n").alias("m"), F.col("head").alias("a")), "leader")
        .where(_fits("n", "m", percent) & (F.col("c") >= _needed("n", "m", percent)))
        .groupBy("head").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", F.col("head").alias("b"))
    )
    stars = cut(inside.unionByName(lead))
    links = cut(verified(stars, sets_for(docs, stars, nodes, size), percent))
    state = cut(nodes.select("node", "n", "grp").join(components(links), "node", "left").select("node", "n", "grp", F.coalesce("root", "node").alias("root")))

    # pairs across components: groups whose nodes lie in several, and elements that several meet in
    spread = cut(state.groupBy("grp", "n").agg(F.min("root").alias("low"), F.max("root").alias("high")))
    held = entries.join(spread, "grp")
    mixed = held.groupBy("item").agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.mode("low").alias("main")).where("lo <> hi")
    # a group's elements are at most as many as a prefix has
    own = Window.partitionBy("grp")
    held = held.join(mixed.select("item", "main"), "item").select(
        "item", "grp", "n", "low", "high", (~((F.col("low") == F.col("main")) & (F.col("high") == F.col("main")))).alias("minor"),
        F.count(F.lit(1)).over(own).alias("met"), F.row_number().over(own.orderBy("place")).alias("rank"),
    )
    held = cut(held)
    x, y = (held.select("item", *[F.col(c).alias(f"{c}_{s}") for c in ("grp", "n", "met", "rank", "low", "high", "minor")]) for s in "xy")
    differ = ~((F.col("low_x") == F.col("high_x")) & (F.col("low_y") == F.col("high_y")) & (F.col("low_x") == F.col("low_y")))
    once = F.when(F.col("minor_y"), F.col("grp_x") < F.col("grp_y")).otherwise(F.col("grp_x") != F.col("grp_y"))
    # two groups that share so many elements meet already in an element that has the others behind it, in both
    needed = _needed("n_x", "n_y", percent)
    early = (F.col("rank_x") + needed <= F.col("met_x") + 1) & (F.col("rank_y") + needed <= F.col("met_y") + 1)
    met_pairs = (
        x.where("minor_x").join(y, "item").where(once & _fits("n_x", "n_y", percent) & differ & early)
        .select(F.least("grp_x", "grp_y").alias("g"), F.greatest("grp_x", "grp_y").alias("h")).distinct()
    )
    lists = cut(held.groupBy("grp", "n").agg(F.collect_list("item").alias("items")))
    group_pairs = (
        met_pairs.join(lists.select(F.col("grp").alias("g"), "n", "items"), "g")
        .join(lists.select(F.col("grp").alias("h"), F.col("n").alias("m"), F.col("items").alias("others")), "h")
        .where(F.size(F.array_intersect("items", "others")) >= _needed("n", "m", percent)).select("g", "h")
    )
    u, v = (state.select(F.col("grp").alias(g), F.col("node").alias(n), F.col("root").alias(r)) for g, n, r in (("g", "a", "ra"), ("h", "b", "rb")))
    across = group_pairs.join(u, "g").join(v, "h").where("ra <> rb").select("a", "b")
    torn = spread.where("low <> high").select(F.col("grp").alias("g"))
    within = torn.join(u, "g").join(v.withColumnRenamed("h", "g"), "g").where("a < b and ra <> rb").select("a", "b")
    more = cut(across.unionByName(within).distinct())
    if not more.isEmpty():
        links = links.unionByName(cut(verified(more, sets_for(docs, more, nodes, size), percent)))
        state = nodes.select("node").join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    state = cut(state.select("node", "root").join(nodes.select("node", "least"), "node"))
    named = state.join(state.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "root", "component_id")
    return (
        rows.select("doc_id", "node", "n").join(named, "node", "left")
        .select("doc_id", "node", "n", "root", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of documents (doc_id, text)."""
    return classes(docs, size, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def numbered(docs: DataFrame, size: int) -> DataFrame:
    """(row, text, node, n): the documents' own columns, and the number and size of their sets."""

    def run(batches):
        for b in batches:
            for part in slices(b, "text", FINE):
                sets = list(sets_of(part.column(1), size))
                node, n = pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, node, n], ["row", "text", "node", "n"])

    rows = docs.select(F.struct("*").alias("row"), "text")
    return rows.mapInArrow(tidied(run), StructType(list(rows.schema.fields)).add("node", LongType()).add("n", LongType()))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; documents without words all stay.

    Where several rows have an id, their sets decide which of them is the one that stays; of rows equal in both, one stays.
    """
    found = cut(classes(docs, size, percent))
    key = "__id"
    while key in docs.columns:
        key += "_"
    # an id of one row is its document; rows of other ids are told apart by their sets
    copy = (F.col("n") > 0) & ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = found.groupBy(F.col("doc_id").alias(key)).agg((F.count(F.lit(1)) > 1).alias("several"), F.max(copy).alias("copy"))
    ids = cut(ids.withColumn("several", F.col("several") | F.col(key).isNull()).where("several or copy").select(key, "several"))
    same_id = F.col("doc_id").cast("long").eqNullSafe(F.col(key))
    kept = beside(docs, ids.select(key), same_id, "left_anti", 16)
    several = ids.where("several").select(key)
    if several.isEmpty():
        return kept
    rows = cut(numbered(beside(docs, several, same_id, "left_semi", 16), size).withColumn(key, F.col("row.doc_id").cast("long")))
    order = F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "node")
    first = found.where("n > 0").groupBy("root").agg(F.min(order).alias("first")).select("first.doc_id", F.col("first.node").alias("at"))
    first = cut(beside(first, several, same_id, "left_semi", 16).withColumnRenamed("doc_id", "of"))
    chosen = beside(rows.where("n > 0"), first, F.col(key).eqNullSafe(F.col("of")) & (F.col("node") == F.col("at")), "left_semi", 32)
    chosen = chosen.groupBy(key, "node").agg(F.min_by("row", F.xxhash64("text")).alias("row"))
    return kept.unionByName(chosen.select("row.*")).unionByName(rows.where("n = 0").select("row.*"))
