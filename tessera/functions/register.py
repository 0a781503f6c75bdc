"""The library's functions for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.functions.probability import rank_sum_p, welch_p


def register_functions(spark: SparkSession) -> None:
    """``mannwhitney_p(u, n1, n2, tie_term)`` and ``welch_p(t, df)`` as SQL functions."""
    spark.udf.register("mannwhitney_p", rank_sum_p)
    spark.udf.register("welch_p", welch_p)
