"""What the operators share: reading tables, small-side joins, components, workers' row batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut

#: A side is broadcast only when its counted rows times their width stay below this.
SMALL_SIDE = 32 << 20


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Rows go to Python workers in batches of bounded size: whole texts are long, and a worker keeps the memory of its largest batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def tidy() -> None:
    """Give back what a reused Python worker has freed: Arrow's pool, and the C library's where it can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run: Callable) -> Callable:
    """A function over batches that starts and ends with a tidy worker."""

    def tidy_run(batches):
        tidy()
        yield from run(batches)
        tidy()

    return tidy_run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beside(df: DataFrame, facts: DataFrame, on, how: str, row_bytes: int = 64) -> DataFrame:
    """Join large rows with facts that were cut: broadcast when counted as small, else an ordinary join."""
    small = facts.count() * row_bytes < SMALL_SIDE
    return df.join(F.broadcast(facts) if small else facts, on, how)


def per_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """``mapInArrow`` of a function from one batch to one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield f(b)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component of the undirected edges (a, b).

    Every round takes the smallest root among a node's neighbours, lets the old root follow, and then jumps one
    pointer; it ends when nothing moves.  Only nodes and edges are shuffled, and a chain shortens by half a round.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    state = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"))
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = state.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("mid"))
        moved = hooked.groupBy(F.col("was").alias("node")).agg(F.min("mid").alias("to"))
        hooked = cut(hooked.join(moved, "node", "left").select("node", "was", F.least("mid", F.coalesce("to", "mid")).alias("mid")))
        up = hooked.select(F.col("node").alias("mid"), F.col("mid").alias("up"))
        step = cut(hooked.join(up, "mid", "left").select("node", "was", F.least("mid", F.coalesce("up", "mid")).alias("root")))
        state = step.drop("was")
        if step.where("root <> was").isEmpty():
            return state
