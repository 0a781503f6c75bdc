"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

# Adaptive execution re-plans joins from measured sizes (nothing is broadcast on a
# guess) and splits skewed join partitions even when that costs one more shuffle.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows of the image plane carry a whole tile, so few rows make a batch
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.python.filterPushdown.enabled": "true",
    # call sites of every column expression are only needed while debugging
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# Inputs stored in less than this are handled by one built-in operator; larger ones go
# through the spread forms, which give the same answer.
SMALL_BYTES = 64 << 20


def is_small(df: DataFrame, limit: int = SMALL_BYTES) -> bool:
    """Whether everything ``df`` is computed from is stored in less than ``limit`` bytes.

    Only the sizes the planner knows for the leaves of the plan are added up; no job is
    run.  Operators here add at most a constant number of rows per input row.
    """
    # the planner's product of guesses can be a number too long to read: then it is not small
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    try:
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    except ValueError:
        return False
    return sum(sizes) < limit


def deal(df: DataFrame) -> DataFrame:
    """Deal a small input out over all cores.

    A small file is often a single row group, which one task would read and process alone.
    Large inputs have splits enough and are left as they are.
    """
    if not is_small(df):
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def bounded_batches(spark: SparkSession) -> None:
    """Batches of tiles as in ``DEFAULTS``, also in a session with other defaults: a Python worker holds a batch or two."""
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.set(key, DEFAULTS[key])


def build_session(app: str = "tessera", master: str | None = None, **conf) -> SparkSession:
    """A session with the defaults above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    Only a local session without one gets a scratch folder; on a cluster a missing
    setting is an error, because a machine-local folder would not survive an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not (sc.master == "local" or sc.master.startswith("local[")):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        wanted = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    sc.setCheckpointDir(wanted)
    return wanted


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared checkpoint folder and forget its lineage.

    A lost executor costs nothing that was cut, and unlike a checkpointed RDD the table has
    known sizes, so later joins and ``is_small`` are decided from facts.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A side of a join is broadcast when its rows, as counted and measured, take no more than this.
BROADCAST_BYTES = 32 << 20


def side(values: DataFrame) -> DataFrame:
    """Facts for a join with large rows: written first, then measured, and marked for broadcast when they are small.

    The size is the number of rows times their width, with texts and binaries as long as they are, so neither a guess of the
    planner nor compression decides.  A larger table takes part in the join as any other.
    """
    facts = cut(values)
    flat = [f.name for f in facts.schema if f.dataType.typeName() in ("string", "binary")]
    nested = [f.name for f in facts.schema if f.dataType.typeName() in ("struct", "array", "map")]
    lengths = [F.coalesce(F.octet_length(c), F.lit(0)) for c in flat] + [F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c in nested]
    width = 16 + 16 * len(facts.columns)
    size = facts.agg((F.count(F.lit(1)) * width + F.coalesce(F.sum(sum(lengths, F.lit(0))), F.lit(0))).alias("bytes")).first().bytes
    return broadcast(facts) if size <= BROADCAST_BYTES else facts


def look_up(df: DataFrame, values: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a table of large rows with facts per key, which stay where they are if the facts are small."""
    return df.join(side(values), keys, how)
