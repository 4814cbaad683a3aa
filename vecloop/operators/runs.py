"""Rows numbered in order within their run, and durations from a chain of end times."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from vecloop.session import write_and_reread


def number_in_order(
    df: DataFrame, run: Sequence[str], order: Sequence[str], carry: str, chunks: int | None = None
) -> DataFrame:
    """Adds ``iter``, 1 for the first row of its run, and ``previous``, the last row's ``carry``.

    ``order`` must be unique within a run. The rows are range-partitioned by (run, order) into ``chunks``
    (default: the session's shuffle partitions), so that a long run covers many of them, and written out,
    since a row's chunk must be the same in both uses. Rows are numbered within their chunk; what a
    chunk needs from earlier ones, a row count and one value, comes from a table of one row per run and
    chunk. ``df`` is read once; the write is a job that runs when this is called.
    """
    count = [] if chunks is None else [chunks]
    spread = df.repartitionByRange(*count, *run, *order).withColumn("chunk", F.spark_partition_id())
    spread = write_and_reread(spread, "runs")

    in_chunk = Window.partitionBy("chunk", *run).orderBy(*order)
    numbered = spread.withColumns({"rank": F.row_number().over(in_chunk), "before": F.lag(carry).over(in_chunk)})

    tails = spread.groupBy("chunk", *run).agg(
        F.count(F.lit(1)).alias("n"), F.max_by(F.col(carry), F.struct(*order)).alias("last")
    )
    over_chunks = Window.partitionBy(*run).orderBy("chunk")
    earlier = over_chunks.rowsBetween(Window.unboundedPreceding, -1)
    offsets = tails.select(
        *[F.col(c).alias(f"offset_{c}") for c in ("chunk", *run)],
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
        F.lag("last").over(over_chunks).alias("last_before"),
    )
    same: Column = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"offset_{c}")) for c in ("chunk", *run)]
    )
    return numbered.join(offsets, same).select(
        *df.columns,
        (F.col("rank") + F.col("rows_before")).alias("iter"),
        F.when(F.col("rank") == 1, F.col("last_before")).otherwise(F.col("before")).alias("previous"),
    )


def iteration_durations(
    ends: DataFrame,
    run: Sequence[str],
    order: Sequence[str],
    end_ns: str,
    start_ns: str,
    chunks: int | None = None,
) -> DataFrame:
    """Adds ``iter`` and ``duration_ns``, the time since the previous end, or since the start for the first."""
    numbered = number_in_order(ends, run, order, end_ns, chunks)
    began = F.when(F.col("iter") == 1, F.col(start_ns)).otherwise(F.col("previous"))
    return numbered.withColumn("duration_ns", F.col(end_ns) - began).drop("previous")
