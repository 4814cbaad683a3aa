"""Reproducible random points: the same for any partitioning, seed for seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecloop.functions.uniform import prefix, uniform, uniforms

# A double in [0, 1) as text, with the space after it.
VALUE_BYTES = 20


def ids(spark: SparkSession, records: int, width: int = 10, task_bytes: int = 128 << 20) -> DataFrame:
    """``records`` ids for vectors of ``width``: a partition on every slot, more if one's text would pass ``task_bytes``."""
    partitions = -(-records * (width + 1) * VALUE_BYTES // task_bytes)
    return spark.range(0, records, 1, max(spark.sparkContext.defaultParallelism, partitions))


def labeled_points(ids: DataFrame, width: int = 10, seed: int = 42) -> DataFrame:
    """``(id, y, x)`` per id: a fair label of 1 or -1 and ``width`` uniforms in [0, 1)."""
    coin = uniform("concat(pre, '0')")
    y = f"CASE WHEN {coin} < 0.5D THEN -1D ELSE 1D END AS y"
    return _keyed(ids, seed).selectExpr("id", y, f"{uniforms('pre', 1, width)} AS x")


def vectors(ids: DataFrame, width: int = 10, seed: int = 42) -> DataFrame:
    """``(id, x)`` per id: ``width`` uniforms in [0, 1)."""
    return _keyed(ids, seed).selectExpr("id", f"{uniforms('pre', 0, width)} AS x")


def _keyed(ids: DataFrame, seed: int) -> DataFrame:
    return ids.selectExpr("id", f"{prefix(seed, 'id')} AS pre")
