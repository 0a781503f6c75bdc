"""Results that keep arriving: the upsert of the batch run as a Structured Streaming sink.

A re-measured scene replaces its old rows, as when a run is repeated.  Each micro-batch
rewrites only the dataset partitions it touches, so a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.operators.tables import nan_to_null, union_tables
from tessera.plans.pipeline import KEYS, Store


def arriving_tables(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """Measurement tables (parquet) as they appear below ``folder``."""
    return (
        spark.readStream.schema(schema).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def keep_current(stream: DataFrame, store: Store, name: str, checkpoint: str, once: bool = True,
                 keys: Sequence[str] = tuple(KEYS)) -> StreamingQuery:
    """Fold every micro-batch into table ``name``: its scenes replace their old rows."""

    def fold(batch: DataFrame, _: int) -> None:
        new = nan_to_null(batch)
        have = store.read(name)
        if have is not None:
            new = union_tables([new, have.limit(0)])
        store.upsert(name, new, new.select(*keys).distinct())

    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
