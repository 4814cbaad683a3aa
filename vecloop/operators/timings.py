"""Summaries of the metrics table ``(engine, algo, nodes, iter, duration_ns)``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

RUN = ("engine", "algo", "nodes")


def first_vs_rest(metrics: DataFrame) -> DataFrame:
    """Per run, in seconds: the first iteration and the mean of the others (NULL if there are none)."""
    seconds = F.col("duration_ns") / F.lit(1e9)
    return metrics.groupBy(*RUN).agg(
        F.max(F.when(F.col("iter") == 1, seconds)).alias("first_s"),
        F.avg(F.when(F.col("iter") > 1, seconds)).alias("later_s"),
    )


def later_by_engine(metrics: DataFrame, engines: Sequence[str]) -> DataFrame:
    """One row per cluster size, one column per engine: the mean later iteration.

    A run of an engine that is not listed ends the job; ``engines_of`` lists them all.
    """
    message = F.concat(F.lit("engine without a column: "), F.coalesce("engine", F.lit("NULL")))
    known = F.when(F.col("engine").isin(list(engines)), F.col("engine")).otherwise(F.raise_error(message))
    runs = first_vs_rest(metrics).withColumn("engine", known)
    return runs.groupBy("algo", "nodes").pivot("engine", list(engines)).agg(F.max("later_s"))


def engines_of(metrics: DataFrame, most: int = 1000) -> list[str]:
    """The names in the metrics; more than ``most`` of them are an error, as they are to be columns."""
    names = [r["engine"] for r in metrics.select("engine").distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} engines")
    return sorted(names)


def one_engine(metrics: DataFrame, engine: str) -> DataFrame:
    """Mean later iteration by cluster size, for one engine."""
    return first_vs_rest(metrics.where(F.col("engine") == engine)).select("algo", "nodes", "later_s")


def largest_cluster(metrics: DataFrame) -> DataFrame:
    """Both figures of every run at the largest cluster size."""
    largest = metrics.agg(F.max("nodes")).scalar()
    return first_vs_rest(metrics.where(F.col("nodes") == largest))


def first_later_long(metrics: DataFrame) -> DataFrame:
    """The largest cluster's figures as rows: run, ``series`` (first or later), ``seconds``."""
    wide = largest_cluster(metrics).withColumnsRenamed({"first_s": "first", "later_s": "later"})
    return wide.unpivot(list(RUN), ["first", "later"], "series", "seconds")


def union_runs(runs: Sequence[DataFrame]) -> DataFrame:
    """Several runs' metrics as one table."""
    return reduce(lambda a, b: a.unionByName(b), runs)
