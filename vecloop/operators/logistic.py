"""Logistic regression by full-batch gradient descent.

Each iteration is one pass over the cached points that brings D sums to the driver. Sum (not
mean) of the gradient terms, no intercept, no regularisation, a fixed number of iterations.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from vecloop.functions.gradient import FACTORS
from vecloop.functions.uniform import uniform
from vecloop.functions.vectors import UNROLL_WIDTH, array_of_sums, checked, dot, scale, unrolled_dot
from vecloop.operators.model import MAX_MODEL_NUMBERS, check_size, kept, laid_out, merging_in, model_value

# From this many partitions on, partial sums are merged in two steps instead of by one task.
WIDE_FAN_IN = 2048

# Beyond this width, vectors are summed as one row per position instead of one column.
SUMS_WIDTH = 128


@dataclass
class LogisticModel:
    """Weights after every iteration (the first entry is the start) and nanoseconds per iteration."""

    spark: SparkSession
    first_iter: int
    weights: list[list[float]]
    durations_ns: list[int] = field(default_factory=list)

    @property
    def final(self) -> list[float]:
        return self.weights[-1]

    def history(self) -> DataFrame:
        """``(iter, w)``: iterations x D numbers, so it is built on the driver."""
        rows = [(self.first_iter + i, w) for i, w in enumerate(self.weights)]
        return self.spark.createDataFrame(rows, "iter int, w array<double>")


def initial_weights(spark: SparkSession, width: int, kind: str = "uniform", seed: int = 42) -> list[float]:
    """``uniform``: in [-1, 1). ``int``: whole numbers 0 to 99."""
    u = uniform(f"concat('{seed}:', id)")
    value = {"uniform": f"2D * {u} - 1D", "int": f"CAST(floor(100D * {u}) AS DOUBLE)"}[kind]
    rows = spark.range(0, width, 1, 1).selectExpr("id", f"{value} AS w").collect()
    return [r["w"] for r in sorted(rows)]


def prepared(column: str, width: int = 0):
    """The column, or an error: ``x`` of another width than ``width``, or no label ``y``."""
    if column == "x":
        return checked(F.col("x"), width)
    missing = F.raise_error(F.lit("point without a label")).cast("double")
    return F.coalesce(F.col("y").cast("double"), missing)


def prepare_points(points: DataFrame, width: int) -> DataFrame:
    """Columns ``y, x`` only; a row of another width or without a label ends the job with an error."""
    return points.select(prepared("y").alias("y"), prepared("x", width).alias("x"))


def gradient_terms(points: DataFrame, weights: Sequence[float], rule: str = "logistic") -> DataFrame:
    """Adds ``factor`` and ``term = factor * x`` to each point."""
    width = len(weights)
    y, x = prepared("y"), prepared("x", width)
    with_model = points.withColumns({"y": y, "x": x, "w": model_value(points.sparkSession, weights)})
    if width <= UNROLL_WIDTH:
        factor = F.expr(FACTORS[rule]("y", unrolled_dot("x", "w", width)))
        term = F.expr(f"array({', '.join(f'factor * get(x, {i})' for i in range(width))})")
    else:
        with_model = with_model.withColumn("d", dot(F.col("x"), F.col("w")))
        factor, term = F.expr(FACTORS[rule]("y", "d")), scale(F.col("x"), F.col("factor"))
    return with_model.withColumn("factor", factor).withColumn("term", term).drop("w", "d")


def gradient_sum(points: DataFrame, weights: Sequence[float], rule: str = "logistic", fan_in: int = 0) -> DataFrame:
    """One row: ``n`` points, highest partition id ``pid``, and the summed terms as the array ``g``.

    ``fan_in`` > 0 merges the partial sums of that many groups of partitions first.
    """
    return _sum_prepared(prepare_points(points, len(weights)), weights, rule, fan_in)


def _sum_prepared(points: DataFrame, weights: Sequence[float], rule: str, fan_in: int) -> DataFrame:
    width = len(weights)
    if width > UNROLL_WIDTH:
        partials = _arrow_partials(points, weights, rule).withColumn("pid", F.spark_partition_id())
        return merge_partials(partials, width, fan_in)
    factor = FACTORS[rule]("y", unrolled_dot("x", "w", width))
    with_model = points.select("y", "x", model_value(points.sparkSession, weights).alias("w"))
    terms = with_model.selectExpr("x", f"{factor} AS c", "spark_partition_id() AS pid")
    sums = array_of_sums([f"c * get(x, {i})" for i in range(width)])
    outputs = [F.expr(e) for e in ("count(1) AS n", "max(pid) AS pid", f"{sums} AS g")]
    if fan_in:
        return merge_partials(terms.groupBy(F.expr(f"pid % {fan_in}")).agg(*outputs), width, 0)
    return terms.agg(*outputs)


def wide_fan_in(points: DataFrame) -> int:
    """Groups to merge the partial sums of the points' partitions in; 0 to merge them at once.

    The number of partitions is known before the first job, so that job already merges in groups.
    """
    partitions = points.rdd.getNumPartitions()
    return math.isqrt(partitions) if partitions >= WIDE_FAN_IN else 0


def merge_partials(partials: DataFrame, width: int, fan_in: int = 0, key: str | None = None) -> DataFrame:
    """Add up rows ``(n, pid, g)`` of counts and vector sums, overall or per ``key``.

    ``fan_in`` > 0 does it in two steps, so that no single task has to fetch from every partition.
    """
    if width > SUMS_WIDTH:
        return _merge_by_position(partials, fan_in, key)
    keys = [key] if key else []
    sums = array_of_sums([f"get(g, {i})" for i in range(width)])
    extra = [f"sum({c}) AS {c}" for c in ("cost", "skipped") if c in partials.columns]
    outputs = [F.expr(e) for e in ("sum(n) AS n", "max(pid) AS pid", f"{sums} AS g", *extra)]
    if fan_in:
        partials = partials.groupBy(*keys, F.expr(f"pid % {fan_in} AS fan")).agg(*outputs)
    return partials.groupBy(*keys).agg(*outputs)


def _merge_by_position(partials: DataFrame, fan_in: int, key: str | None) -> DataFrame:
    """``merge_partials`` for very wide vectors: one row per position, so the query stays short."""
    keys = [key] if key else []
    added = ["n", *[c for c in ("cost", "skipped") if c in partials.columns]]
    sums = [F.max("pid").alias("pid"), *[F.sum(c).alias(c) for c in (*added, "v")]]
    rows = partials.select(*keys, *added, "pid", F.posexplode("g").alias("pos", "v"))
    if fan_in:
        rows = rows.groupBy(*keys, "pos", F.expr(f"pid % {fan_in} AS fan")).agg(*sums)
    # Every position carries the same count, so any of them will do.
    vector = "transform(array_sort(collect_list(struct(pos, v))), place -> place.v) AS g"
    whole = [F.expr(vector), *[F.max(c).alias(c) for c in ("pid", *added)]]
    return rows.groupBy(*keys, "pos").agg(*sums).groupBy(*keys).agg(*whole)


def _arrow_partials(points: DataFrame, weights: Sequence[float], rule: str) -> DataFrame:
    """Wide vectors: one row of sums per partition, computed on Arrow batches with numpy."""
    width = len(weights)

    def partial_sums(batches):
        import numpy as np
        import pyarrow as pa

        w = np.asarray(weights, dtype=np.float64)
        total, n = np.zeros(width), 0
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                y = batch.column("y").to_numpy(zero_copy_only=False)
                d = x @ w
                if rule == "alt":
                    factor = (1 - 1 / (1 - y * np.exp(d))) * -y
                else:
                    factor = (1 / (1 + np.exp(-y * d)) - 1) * y
                total += factor @ x
                n += len(y)
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "g": pa.array([total.tolist()])})

    return points.select("y", "x").mapInArrow(partial_sums, "n bigint, g array<double>")


def train_logistic(
    points: DataFrame,
    iterations: int = 10,
    weights: Sequence[float] | None = None,
    *,
    init: str = "uniform",
    width: int | None = None,
    step: float = 1.0,
    rule: str = "logistic",
    cache: bool | str = True,
    first_iter: int = 0,
    seed: int = 42,
    partitions: int | None = None,
    fan_in: int | None = None,
    max_model_numbers: int = MAX_MODEL_NUMBERS,
    on_iteration: Callable[[int, list[float], int], None] | None = None,
) -> LogisticModel:
    """Train on ``points(y, x)``.

    ``rule="logistic"`` subtracts the summed terms, ``rule="alt"`` adds them. ``cache=False`` reads
    the input again in every iteration, ``cache="table"`` what was written once (``model.kept``). ``on_iteration(iter, weights, duration_ns)`` is called after
    each one; iteration 1 includes the load, since caching is lazy. ``partitions`` lays the points out
    anew as they are loaded, and not later. ``fan_in`` is the number of groups in which partial sums are
    merged first, 0 for one step; if it is not given, it is 0 below ``WIDE_FAN_IN`` partitions. It can change the last digits, as any other order of addition.
    """
    spark = points.sparkSession
    if weights is None:
        if width is None:
            head = points.select(F.size("x").alias("width")).first()
            if head is None:
                raise ValueError("no points to train on")
            width = head["width"]
        weights = initial_weights(spark, width, init, seed)
    weights = [float(v) for v in weights]
    width = len(weights)
    check_size(width, max_model_numbers)
    sign = {"logistic": -1.0, "alt": 1.0}[rule]

    model = LogisticModel(spark, first_iter, [weights])
    start = time.perf_counter_ns()
    data, release = kept(laid_out(prepare_points(points, width), partitions), cache)
    try:
        groups = wide_fan_in(data) if fan_in is None else fan_in
        for i in range(first_iter + 1, first_iter + iterations + 1):
            with merging_in(spark, groups):
                row = _sum_prepared(data, weights, rule, groups).collect()[0]
            if not row["n"]:
                raise ValueError("no points to train on")
            weights = [w + sign * step * g for w, g in zip(weights, row["g"])]
            model.weights.append(weights)
            end = time.perf_counter_ns()
            model.durations_ns.append(end - start)
            start = end
            if on_iteration:
                on_iteration(i, weights, model.durations_ns[-1])
    finally:
        release()
    return model
