"""What the trainers share: a small model visible to every row, and where the points lie."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

from vecloop.session import fresh_path, remove

# Up to this many numbers the model is written into the query as text.
MAX_TEXT_NUMBERS = 10_000

# The default for the size of a model, which goes to every task: 64 MB of doubles.
MAX_MODEL_NUMBERS = 8_000_000


def check_size(numbers: int, limit: int = MAX_MODEL_NUMBERS) -> None:
    """An error if a model holds more than ``limit`` numbers; callers pass on their ``max_model_numbers``."""
    if numbers > limit:
        raise ValueError(f"a model of {numbers} numbers goes to every task; allow it with max_model_numbers")


def laid_out(points: DataFrame, partitions: int | None) -> DataFrame:
    """The points in ``partitions`` even partitions, or as they are read.

    For inputs that few tasks can read, as one large row group or a file that can't be split.
    """
    return points if partitions is None else points.repartition(partitions)


@contextmanager
def merging_in(spark: SparkSession, groups: int) -> Iterator[None]:
    """For jobs that merge in groups: groups are small, and adaptive execution would put them all into one task, which then
    fetches from every partition."""
    if not groups:
        yield
        return
    coalescing = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalescing)
    spark.conf.set(coalescing, "false")
    try:
        yield
    finally:
        spark.conf.set(coalescing, before)


def kept(points: DataFrame, cache: bool | str) -> tuple[DataFrame, Callable[[], None]]:
    """The points that iterations read, and what to call after the last one.

    ``cache``: True keeps them in the executors' memory, False reads the input again in every iteration, and ``"table"`` writes
    them once to the shared folder, as columns, to be read again in every iteration. The table needs no memory and no second parse, and
    outlives executors; it is deleted at the end.
    """
    if cache == "table":
        path = fresh_path(points.sparkSession, "points")
        points.write.parquet(path)
        return points.sparkSession.read.schema(points.schema).parquet(path), lambda: remove(points.sparkSession, path)
    if cache not in (True, False):
        raise ValueError(f"unknown way to keep points: {cache}")
    if not cache:
        return points, lambda: None
    points = points.persist()
    return points, points.unpersist


def _literal(value) -> str:
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(_literal(v) for v in value)})"
    return f"double('{value!r}')"


def model_value(spark: SparkSession, value: Sequence, max_model_numbers: int = MAX_MODEL_NUMBERS) -> Column:
    """A vector, or a list of vectors, as a one-row scalar subquery.

    Every row sees it without a join, and, unlike literals in the expression, it keeps the generated
    code the same from one iteration to the next, so it is compiled once.
    """
    nested = bool(value) and isinstance(value[0], (list, tuple))
    numbers = sum(len(v) for v in value) if nested else len(value)
    check_size(numbers, max_model_numbers)
    if numbers <= MAX_TEXT_NUMBERS:
        model = spark.range(0, 1, 1, 1).selectExpr(f"{_literal(list(value))} AS model")
    else:
        kind = "array<array<double>>" if nested else "array<double>"
        model = spark.createDataFrame([(value,)], f"model {kind}")
    return model.scalar()
