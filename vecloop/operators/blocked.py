"""K-means with centres that no single process holds: a table in the shared folder, read by the tasks in blocks.

The trainer in ``kmeans`` sends its centres to every task and is the right one while they fit. Here a task holds some of its points, streams
the blocks of the table past them, and keeps each point's least (distance, centre). Points are not shuffled; sums, means, upsert and
shift are tables keyed by centre. What reaches the driver is the shift and the cost of an iteration.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from vecloop.operators.centers import center_shift, join_centers, upsert_centers
from vecloop.operators.kmeans import nearest_in_block, prepare_vectors
from vecloop.operators.logistic import merge_partials, wide_fan_in
from vecloop.operators.model import kept, laid_out, merging_in
from vecloop.operators.runs import number_in_order
from vecloop.session import fresh_path, open_folder, remove, shared_uri

#: Numbers of a block of centres, and of the points that a task holds while the blocks pass.
BLOCK_NUMBERS = 1_000_000
HELD_NUMBERS = 4_000_000

TABLE = "cid int, c array<double>, iter int"


@dataclass
class BlockedModel:
    """Centres after every iteration, in folders below ``path``; shift, cost and duration per iteration."""

    spark: SparkSession
    path: str
    first_iter: int = 0
    shifts: list[float | None] = field(default_factory=list)
    costs: list[float] = field(default_factory=list)
    durations_ns: list[int] = field(default_factory=list)

    def history(self) -> DataFrame:
        """``(iter, cid, c)``."""
        return self.spark.read.schema(TABLE).parquet(self.path).select("iter", "cid", "c")

    def centers(self, iteration: int) -> DataFrame:
        return self.history().where(F.col("iter") == iteration).select("cid", "c")

    @property
    def final(self) -> DataFrame:
        return self.centers(self.first_iter + len(self.shifts))


def sums_by_table(points: DataFrame, uri: str, width: int, block_numbers: int = BLOCK_NUMBERS, held_numbers: int = HELD_NUMBERS, fan_in: int = 0) -> DataFrame:
    """Per non-empty cluster ``cid, n, cost, g, pid``, as ``kmeans.cluster_sums``, with the centres ``(cid, c)`` in the folder ``uri``."""
    nearest = nearest_in_block()
    block_rows, held_rows = max(1, block_numbers // width), max(1, held_numbers // width)

    def blocks():
        import pyarrow.dataset

        files, folder = open_folder(uri)
        table = pyarrow.dataset.dataset(folder, filesystem=files, format="parquet")
        for batch in table.to_batches(columns=["cid", "c"], batch_size=block_rows, batch_readahead=1, fragment_readahead=1, use_threads=False):
            if batch.num_rows:
                ids = batch.column("cid").to_numpy(zero_copy_only=False)
                order = np.argsort(ids)
                yield ids[order], batch.column("c").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)[order]

    def sums(x):
        best, cid = np.full(len(x), np.inf), np.full(len(x), np.iinfo(np.int32).max, dtype=np.int32)
        least = None
        for ids, some in blocks():
            nearest(x, some, ids, best, cid)
            least = ids[0] if least is None else min(least, ids[0])
        # A point at no finite distance from any centre belongs to the first, as in the plain trainer.
        cid[best == np.inf] = least
        order = np.argsort(cid, kind="stable")
        present, first = np.unique(cid[order], return_index=True)
        total = np.add.reduceat(x[order], first, axis=0)
        n = np.diff(np.append(first, len(x)))
        edges = pa.array(np.arange(len(present) + 1, dtype=np.int32) * width)
        g = pa.ListArray.from_arrays(edges, pa.array(total.ravel()))
        columns = [pa.array(present), pa.array(n), pa.array(np.add.reduceat(best[order], first)), g]
        return pa.RecordBatch.from_arrays(columns, names=["cid", "n", "cost", "g"])

    def partial_sums(batches):
        held, n = [], 0
        for batch in batches:
            rows = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for begin in range(0, len(rows), held_rows):
                some = rows[begin : begin + held_rows]
                if n and n + len(some) > held_rows:
                    yield sums(np.concatenate(held))
                    held, n = [], 0
                held.append(some)
                n += len(some)
        if n:
            yield sums(np.concatenate(held))

    schema = "cid int, n bigint, cost double, g array<double>"
    partials = points.select("x").mapInArrow(partial_sums, schema).withColumn("pid", F.spark_partition_id())
    return merge_partials(partials, width, fan_in, "cid")


def train_kmeans_blocked(
    points: DataFrame,
    centers: DataFrame,
    iterations: int = 10,
    *,
    path: str | None = None,
    empty: str = "keep",
    cache: bool | str = True,
    first_iter: int = 0,
    partitions: int | None = None,
    block_numbers: int = BLOCK_NUMBERS,
    held_numbers: int = HELD_NUMBERS,
    on_start: Callable[[DataFrame], None] | None = None,
    on_iteration: Callable[[int, DataFrame, float | None, int], None] | None = None,
) -> BlockedModel:
    """Train on ``points(x)`` from ``centers (cid, c)``, any number of them; results are those of ``train_kmeans``.

    ``path`` is where the centres of all iterations go (default: a new place in the shared folder); it must be in a store that pyarrow can
    open, since tasks read it. ``empty``, ``cache``, ``first_iter`` and ``partitions`` are as in ``train_kmeans``;
    ``on_start(centers)`` and ``on_iteration(iter, centers, shift, duration_ns)`` get the centres as a table.
    """
    if empty not in ("keep", "error", "drop"):
        raise ValueError(f"unknown rule for empty clusters: {empty}")
    start = time.perf_counter_ns()
    spark = points.sparkSession
    model = BlockedModel(spark, path or fresh_path(spark, "centers"), first_iter)
    folder = lambda i: f"{model.path}/iter={i}"

    def save(table: DataFrame, i: int) -> DataFrame:
        table.select(F.col("cid").cast("int"), "c").write.mode("overwrite").parquet(folder(i))
        return spark.read.schema("cid int, c array<double>").parquet(folder(i))

    old = save(centers, first_iter)
    head = old.select(F.size("c").alias("width")).first()
    if head is None:
        raise ValueError("no centres to start from")
    width = head["width"]
    if old.where((F.size("c") != width) | F.col("cid").isNull()).head():
        raise ValueError("centres of unequal width, or without an id")
    if on_start:
        on_start(old)
    data, release = kept(laid_out(prepare_vectors(points, width), partitions), cache)
    try:
        groups = wide_fan_in(data)
        for i in range(first_iter + 1, first_iter + iterations + 1):
            found = sums_by_table(data, shared_uri(spark, folder(i - 1)), width, block_numbers, held_numbers, groups)
            # Sums are used twice, for the centres and for their cost, and computed once.
            sums_path = fresh_path(spark, "sums")
            with merging_in(spark, groups):
                found.select("cid", "n", "cost", F.transform("g", lambda v: v / F.col("n")).alias("c")).write.parquet(sums_path)
            means = spark.read.schema("cid int, n bigint, cost double, c array<double>").parquet(sums_path)
            total = means.agg(F.sum("n").alias("n"), F.sum("cost").alias("cost")).head()
            if not total["n"]:
                raise ValueError("no points to train on")
            if empty == "error":
                means = join_centers(old, means, empty).select("cid", F.col("new_c").alias("c"))
            if empty == "drop":
                numbered = number_in_order(means.select("cid", "c"), [], ["cid"], "cid")
                new, shift = save(numbered.select((F.col("iter") - 1).alias("cid"), "c"), i), None
            else:
                new = save(upsert_centers(old, means), i)
                shift = center_shift(old, new).head()["shift"]
            remove(spark, sums_path)
            old = new
            model.shifts.append(shift)
            model.costs.append(total["cost"])
            end = time.perf_counter_ns()
            model.durations_ns.append(end - start)
            start = end
            if on_iteration:
                on_iteration(i, new, shift, model.durations_ns[-1])
    finally:
        release()
    return model
