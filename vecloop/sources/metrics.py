"""Iteration durations: rows ``(engine, algo, nodes, iter, duration_ns)``, as a table or as text."""

from __future__ import annotations

import re
import time
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vecloop.operators.runs import number_in_order

METRICS = "engine string, algo string, nodes int, iter bigint, duration_ns bigint"
COLUMNS = ("engine", "algo", "nodes", "iter", "duration_ns")

#: Which run a file, or a folder of part files, below a root of metrics files holds.
RUNS = "folder string, engine string, algo string, nodes int"

# The layout <nodes>/<engine><algo>.txt, with the algorithm names that end a run's name.
ALGORITHMS = ("lr", "kmeans")
RUN_FOLDER = r"^(?:.*/)?(?:nodes=)?(\d+)/(?:run=)?([^/]*?)(" + "|".join(ALGORITHMS) + r")\.txt$"


def metrics_frame(
    spark: SparkSession, engine: str, algo: str, nodes: int, durations_ns: Sequence[int], first_iter: int = 1
) -> DataFrame:
    """One trainer run, or a part of it, which the driver timed, as metrics rows."""
    rows = [(engine, algo, nodes, first_iter + i, d) for i, d in enumerate(durations_ns)]
    return spark.createDataFrame(rows, METRICS)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append to the metrics table. An iteration that is appended again, as after a restart, replaces what was there."""
    rows = metrics.select(*COLUMNS, F.lit(time.time_ns()).alias("attempt"))
    rows.write.mode("append").partitionBy("engine", "algo").parquet(path)


def read_metrics_table(spark: SparkSession, path: str) -> DataFrame:
    """One row an iteration: the last one appended; of several in one append, the longest."""
    rows = spark.read.schema(METRICS + ", attempt bigint").parquet(path)
    last = F.max_by("duration_ns", F.struct("attempt", "duration_ns")).alias("duration_ns")
    return rows.groupBy("engine", "algo", "nodes", "iter").agg(last).select(*COLUMNS)


def runs_frame(spark: SparkSession, runs: Iterable[tuple[str, str, str, int]]) -> DataFrame:
    """``(folder, engine, algo, nodes)`` for files that something else wrote; folders are relative to their root."""
    return spark.createDataFrame(list(runs), RUNS)


def _run_name() -> Column:
    """The name of a run's folder, in the fixed layout where that can be told apart, else ending in a digest."""
    plain = F.col("engine").rlike("^[A-Za-z0-9._-]*$") & F.col("algo").isin(*ALGORITHMS)
    other = F.concat(
        F.regexp_replace(F.concat_ws("-", "engine", "algo"), "[^A-Za-z0-9._-]", "_"),
        F.lit("-"),
        F.substring(F.sha2(F.to_json(F.struct("engine", "algo")), 256), 1, 16),
    )
    return F.concat(F.when(plain, F.concat("engine", "algo")).otherwise(other), F.lit(".txt"))


def write_metrics_text(metrics: DataFrame, root: str) -> None:
    """One number per line, line order = iteration, under ``nodes=<n>/run=<engine><algo>.txt``, and a table of the runs.

    Range-partitioned by (run, iteration), so a run of any length is a row of part files in order. The table, in ``_runs``,
    says which folder holds which run, so that any engine and algorithm is read back. A run without a name or size is an error.
    """
    named = F.col("engine").isNotNull() & F.col("algo").isNotNull() & F.col("nodes").isNotNull()
    run = F.when(named, _run_name()).otherwise(F.raise_error(F.lit("a run without engine, algo or nodes")))
    rows = metrics.select("nodes", run.alias("run"), "iter", F.col("duration_ns").cast("string").alias("value"))
    in_order = rows.repartitionByRange("nodes", "run", "iter").sortWithinPartitions("nodes", "run", "iter")
    in_order.drop("iter").write.mode("overwrite").partitionBy("nodes", "run").text(root)
    folder = F.concat(F.lit("nodes="), F.col("nodes").cast("string"), F.lit("/run="), _run_name())
    runs = metrics.select("engine", "algo", "nodes").distinct().select(folder.alias("folder"), "engine", "algo", "nodes")
    runs.write.mode("overwrite").parquet(f"{root}/_runs")


def _written_runs(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(RUNS).parquet(f"{root}/_runs")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_metrics_text(spark: SparkSession, root: str, chunks: int | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Every run below ``root`` in one read, in line order; a run is a file or a folder of part files, ordered by their numbers.

    Which run it is comes from ``runs (folder, engine, algo, nodes)``, or the table that ``write_metrics_text`` left
    there, or, without either, from names in the fixed layout. A file that belongs to no run ends the job. A line's place in its run is (part
    number, split, place within the split), all of which are known where the line is read, so long files are read by many
    tasks.
    """
    # Paths come with URL escapes, in which a plus sign is itself.
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    below = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    start = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?" + ("" if below.startswith("/") else ".*/")
    lines = spark.read.option("recursiveFileLookup", "true").text(root).select(
        F.regexp_replace(path, start + re.sub(r"([^A-Za-z0-9_/])", r"\\\1", below), "").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
        F.col("value").cast("bigint").alias("duration_ns"),
    )

    def number(pattern: str):
        return F.coalesce(F.regexp_extract("name", pattern, 1).try_cast("bigint"), F.lit(0))

    lines = lines.select(
        F.regexp_replace("path", "(^|/)part-[^/]*$", "").alias("folder"),
        F.substring_index("path", "/", -1).alias("name"),
        "split",
        "line",
        "duration_ns",
    ).select(
        "folder",
        number(r"^part-(?:[a-z]-)?(\d+)").alias("part"),
        number(r"^part-.*[-.]c(\d+)(?:\.[^/]*)?$").alias("piece"),
        "split",
        "line",
        "duration_ns",
    )
    numbered = number_in_order(lines, ["folder"], ["part", "piece", "split", "line"], "duration_ns", chunks)
    unknown = F.raise_error(F.concat(F.lit("not a file of metrics: "), F.col("folder")))
    runs = _written_runs(spark, root) if runs is None else runs
    if runs is not None:
        known = numbered.join(runs.select("folder", "engine", "algo", "nodes"), "folder", "left")
        return known.withColumn("engine", F.coalesce("engine", unknown.cast("string"))).select(*COLUMNS)
    part = lambda i: F.regexp_extract("folder", RUN_FOLDER, i)
    nodes = F.when(F.col("folder").rlike(RUN_FOLDER), part(1).cast("int")).otherwise(unknown.cast("int"))
    return numbered.select(part(2).alias("engine"), part(3).alias("algo"), nodes.alias("nodes"), "iter", "duration_ns")
