"""The engine's inputs, derived from the test tables. Every view covers its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vecloop.operators.runs import iteration_durations

LR_START = [0.25, -0.5, 0.75, 0.1]
K = 10
ITERATIONS = 10
LINE_WIDTH = 3
ENGINES = ["click", "error", "purchase", "signup", "view"]

# Lines as a text file may hold them: clean, or with one of the usual faults, by line number and flag.
MESSY_LINE = """
CASE l_linenumber
  WHEN 1 THEN concat(y, ' ', n, ' ', q, ' ', s)
  WHEN 2 THEN concat(y, '  ', n, ' ', q, ' ', s)
  WHEN 3 THEN concat('  ', y, ' ', n, ' ', q, ' ', s, '  ')
  WHEN 4 THEN concat(y, ' ', n, ' ', q)
  WHEN 5 THEN concat(y, ' ', n, ' ', q, ' ', s, ' 7')
  WHEN 6 THEN concat(y, ' ', n, ' x ', s)
  ELSE CASE l_returnflag
    WHEN 'R' THEN concat(y, ' NaN ', q, ' ', s)
    WHEN 'A' THEN concat(y, ' ', n, ' Infinity ', s, '   ')
    ELSE '' END
END
"""
CLEAN_LINE = "concat(y, ' ', n, ' ', q, ' ', s)"
VECTOR_LINE = "concat(n, ' ', q, ' ', s)"
# The label is last and has a fraction, which is cut off.
LABEL_LAST_LINE = "concat(n, ' ', q, ' ', s, ' ', y, '.', n)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Line items' coordinates times this are whole numbers.
WHOLE = 10_000_000.0


def points_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(y, x)``: four features of every line item; the label is whether it was returned."""
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0).alias("y"),
        F.array(
            F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000, F.col("l_discount") * 10, F.col("l_tax") * 10
        ).alias("x"),
    )


def points_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, label, y, x)``: every embedding; the label of its point is its label's parity."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("double").alias("label"),
        F.when(F.col("label") % 2 == 0, 1.0).otherwise(-1.0).alias("y"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


def first_centers(spark: SparkSession, sf_dir: str) -> list[list[float]]:
    """The starting centres: the K embeddings with the lowest id."""
    return [list(r["x"]) for r in points_emb(spark, sf_dir).orderBy("id").limit(K).collect()]


def spread_centers(width: int = 4) -> list[list[float]]:
    """K fixed starting centres for the line items' points, spread over the unit cube by a rule."""
    return [[((i + 1) * 0.618034 + (j + 1) * 0.414214 * (i + 1)) % 1.0 for j in range(width)] for i in range(K)]


def lines(spark: SparkSession, sf_dir: str, line: str) -> DataFrame:
    """``(value)``: every line item as one line of text."""
    words = table(spark, sf_dir, "lineitem").selectExpr(
        "l_linenumber",
        "l_returnflag",
        "CASE WHEN l_returnflag = 'R' THEN '1' ELSE '-1' END AS y",
        "CAST(l_linenumber AS STRING) AS n",
        "CAST(CAST(l_quantity AS INT) AS STRING) AS q",
        "CAST(l_suppkey AS STRING) AS s",
    )
    return words.selectExpr(f"{line} AS value")


def _nanoseconds(ts: str) -> Column:
    """Nanoseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    since = f"(CAST({ts} AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ '1970-01-01 00:00:00')"
    seconds = " + ".join(
        f"extract({unit} FROM {since}) * {size}L" for unit, size in (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60))
    )
    micros = f"CAST(extract(SECOND FROM {since}) * 1000000 AS BIGINT)"
    return F.expr(f"(({seconds}) * 1000000 + {micros}) * 1000")


def _midnight(ts: str) -> str:
    return f"CAST({ts} AS DATE)"


def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics rows from the events: per type and day one run, whose clock starts at midnight."""
    ends = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("engine"),
        F.lit("lr").alias("algo"),
        F.dayofmonth("ts").alias("nodes"),
        "event_id",
        _nanoseconds("ts").alias("end_ns"),
        _nanoseconds(_midnight("ts")).alias("start_ns"),
    )
    durations = iteration_durations(ends, ["engine", "algo", "nodes"], ["end_ns", "event_id"], "end_ns", "start_ns")
    return durations.select("engine", "algo", "nodes", "iter", "duration_ns")


def order_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics rows from the orders: per status and month one run of order dates."""
    ends = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("engine"),
        F.lit("kmeans").alias("algo"),
        F.month("o_orderdate").alias("nodes"),
        "o_orderkey",
        _nanoseconds("o_orderdate").alias("end_ns"),
        _nanoseconds("DATE '1990-01-01'").alias("start_ns"),
    )
    durations = iteration_durations(ends, ["engine", "algo", "nodes"], ["end_ns", "o_orderkey"], "end_ns", "start_ns")
    return durations.select("engine", "algo", "nodes", "iter", "duration_ns")


def user_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End times per user; a user's clock starts at midnight of the day of the first event."""
    return table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        _nanoseconds("ts").alias("end_ns"),
        _nanoseconds(_midnight("ts")).alias("start_ns"),
    )
