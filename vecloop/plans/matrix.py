"""The experiment matrix: both trainers, by how the input is kept between iterations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from vecloop.operators.kmeans import train_kmeans
from vecloop.operators.logistic import train_logistic
from vecloop.operators.timings import union_runs
from vecloop.sources.metrics import metrics_frame

#: Names of the ways to keep the input, and the trainers' argument.
KEPT = {"uncached": False, "cached": True}
KEPT_ALSO = {"table": "table"}


def run_matrix(
    labeled: DataFrame,
    vectors: DataFrame,
    weights: Sequence[float],
    centers: Sequence[Sequence[float]],
    iterations: int = 10,
    engines: Mapping[str, bool | str] = KEPT,
) -> tuple[DataFrame, DataFrame]:
    """``(engine, algo, iter, cid, c)``, the models of a run of each trainer and engine, and their metrics rows.

    Points may be read from text: then ``uncached`` parses it in every iteration, and ``cached`` and ``table`` once. Weights are the one centre 0; ``nodes`` is the number of task slots.
    """
    spark = labeled.sparkSession
    nodes = spark.sparkContext.defaultParallelism
    models, times = [], []
    for engine, cache in engines.items():
        regression = train_logistic(labeled, iterations, weights, cache=cache)
        clusters = train_kmeans(vectors, len(centers), iterations, centers, cache=cache)
        for algo, run in (("lr", regression), ("kmeans", clusters)):
            history = run.history()
            if algo == "lr":
                history = history.select("iter", F.lit(0).alias("cid"), F.col("w").alias("c"))
            models.append(history.select(F.lit(engine).alias("engine"), F.lit(algo).alias("algo"), "iter", "cid", "c"))
            times.append(metrics_frame(spark, engine, algo, nodes, run.durations_ns))
    return union_runs(models), union_runs(times)
