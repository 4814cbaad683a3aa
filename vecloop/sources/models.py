"""The model after every iteration, as a parquet table partitioned by ``iter``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

# Column types are fixed, so a partitioned table is read back with the types it was written with.
WEIGHTS = "w array<double>, iter int"
CENTERS = "cid int, c array<double>, iter int"


def weights_frame(spark: SparkSession, iteration: int, weights: Sequence[float]) -> DataFrame:
    return spark.createDataFrame([(list(weights), iteration)], WEIGHTS)


def centers_frame(spark: SparkSession, iteration: int, centers: Sequence[Sequence[float]]) -> DataFrame:
    return spark.createDataFrame([(cid, list(c), iteration) for cid, c in enumerate(centers)], CENTERS)


def save_history(history: DataFrame, path: str) -> None:
    """Save ``(iter, ...)`` rows; each iteration is a folder of its own, and saving it again replaces it."""
    rows = history.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    rows.partitionBy("iter").parquet(path)


def weights_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WEIGHTS).parquet(path).select("iter", "w")


def centers_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CENTERS).parquet(path).select("iter", "cid", "c")


def load_weights(spark: SparkSession, path: str, iteration: int) -> list[float]:
    """Weights after ``iteration``, to start from; reads that iteration's folder only."""
    rows = weights_history(spark, path).where(F.col("iter") == iteration).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} models saved for iteration {iteration}")
    return list(rows[0]["w"])


def load_centers(spark: SparkSession, path: str, iteration: int) -> list[list[float]]:
    rows = centers_history(spark, path).where(F.col("iter") == iteration).collect()
    if not rows:
        raise ValueError(f"no model saved for iteration {iteration}")
    rows = sorted(rows, key=lambda r: r["cid"])
    if [r["cid"] for r in rows] != list(range(len(rows))):
        raise ValueError(f"the centres of iteration {iteration} are not numbered from 0, each once")
    return [list(r["c"]) for r in rows]


def commit(spark: SparkSession, path: str, iteration: int) -> None:
    """Mark an iteration as complete. To be called last, when its model, and whatever else belongs to it, is written."""
    rows = _rows_of(spark, path, iteration)
    mark = spark.createDataFrame([(rows, iteration)], "rows bigint, iter int").coalesce(1)
    mark.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("iter").parquet(f"{path}/_complete")


def latest_iteration(spark: SparkSession, path: str) -> int | None:
    """The last complete iteration; None if there is none. One without a mark, or with other rows than it was marked with, is passed over."""
    try:
        marks = spark.read.schema("rows bigint, iter int").parquet(f"{path}/_complete").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    for mark in sorted(marks, key=lambda m: -m["iter"]):
        if _rows_of(spark, path, mark["iter"]) == mark["rows"]:
            return mark["iter"]
    return None


def _rows_of(spark: SparkSession, path: str, iteration: int) -> int:
    try:
        return spark.read.schema("iter int").parquet(path).where(F.col("iter") == iteration).count()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
