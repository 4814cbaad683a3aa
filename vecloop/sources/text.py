"""Points as text: one per line, values separated by spaces.

Every parser returns its lines with ``reason`` (NULL for a good line) beside the parsed columns;
``points`` and ``rejects`` split them. Values that are not finite numbers are rejected too.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from vecloop.functions.vectors import UNROLL_WIDTH, as_text


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(value)`` per line of every file under ``path``."""
    return spark.read.text(path)


def first_width(spark: SparkSession, path: str) -> int | None:
    """How many numbers the first record under ``path`` holds, whatever the splits; None if there is no record.

    The first record is the first line, by file name and then by place, whose words between single spaces are all finite
    numbers. Files are listed by a job that reads none of them, and read in order until one has a record: one at first, then more at
    once. Of a file's lines only those of its first block are read, unless that holds no record.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", F.col("_metadata.file_path").alias("file"))
    seen, count = "", 1
    while names := listed.where(F.col("file") > seen).orderBy("file").limit(count).collect():
        paths = [re.sub(r"([\\\[\]{}*?,])", r"\\\1", r["path"]) for r in names]  # as they are, not as patterns
        place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
        lines = spark.read.text(paths).select("value", place.alias("place"))
        records = _parse(lines, _tokens_on_single(), None, None).where("reason IS NULL").select(F.size("numbers").alias("width"), "place")
        if count == 1 and (found := records.where("place.file_block_start = 0").head()):
            return found["width"]
        width = records.agg(F.min_by("width", "place")).head()[0]
        if width is not None:
            return width
        seen, count = names[-1]["file"], min(count * 16, 4096)
    return None


def _tokens_on_runs() -> Column:
    """Words between runs of spaces; leading and trailing spaces do not count."""
    return F.array_remove(F.split(F.col("value"), " "), "")


def _tokens_on_single() -> Column:
    """Words between single spaces: two spaces in a row give an empty word, trailing ones nothing."""
    return F.split(F.rtrim("value"), " ")


def _once(df: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns, computed once per row: filters and later columns read them and can't repeat the work.

    Catalyst moves nothing through the one-element array.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


def _numbers(count: int | None) -> str:
    """SQL text: the first ``count`` words (or all) as doubles, NULL where a word is no number.

    A small known count is written out, which compiles into plain code; a higher-order function does not.
    """
    if count is not None and count <= UNROLL_WIDTH:
        return f"array({', '.join(f'try_cast(get(tokens, {i}) AS DOUBLE)' for i in range(count))})"
    words = "tokens" if count is None else f"slice(tokens, 1, {count})"
    return f"transform({words}, t -> try_cast(t AS DOUBLE))"


def _check(count: int | None) -> str:
    """SQL text: NULL if a number is missing, 0 if all are finite, NaN otherwise."""
    if count is not None and count <= UNROLL_WIDTH:
        return " + ".join(f"get(numbers, {i}) * 0D" for i in range(count))
    return "aggregate(numbers, 0D, (total, v) -> total + v * 0D)"


def _parse(lines: DataFrame, tokens: Column, shape_reason: Column | None, count: int | None) -> DataFrame:
    """The first ``count`` words, or all, become ``numbers``. Further columns of ``lines`` pass through."""
    no_reason = F.lit(None).cast("string")
    split = lines.withColumn("tokens", tokens)
    split = split.withColumns(
        {"shape": no_reason if shape_reason is None else shape_reason, "numbers": F.expr(_numbers(count))}
    )
    checked = split.withColumn("check", F.expr(_check(count)))
    value_reason = F.when(F.col("check").isNull(), "not a number").when(F.col("check") != 0, "not finite")
    return _once(checked, *lines.columns, F.coalesce("shape", value_reason).alias("reason"), "numbers")


def _label_first(parsed: DataFrame) -> DataFrame:
    numbers = F.col("numbers")
    features = F.slice(numbers, 2, F.greatest(F.size(numbers) - 1, F.lit(0)))
    return parsed.withColumns({"y": F.get(numbers, F.lit(0)), "x": features}).drop("numbers")


def parse_labeled(lines: DataFrame, width: int) -> DataFrame:
    """Label first, then ``width`` values, between runs of spaces; further words are ignored."""
    shape = F.when(F.size("tokens") < width + 1, "too few values")
    return _label_first(_parse(lines, _tokens_on_runs(), shape, width + 1))


def parse_labeled_strict(lines: DataFrame, width: int) -> DataFrame:
    """Label first, then exactly ``width`` values, separated by single spaces."""
    return _label_first(_parse(lines, _tokens_on_single(), _wrong_width(width + 1), width + 1))


def parse_label_last(lines: DataFrame, width: int | None = None) -> DataFrame:
    """All values but the last, then the label, cut to a whole number, separated by single spaces."""
    shape = None if width is None else _wrong_width(width + 1)
    parsed = _parse(lines, _tokens_on_single(), shape, None if width is None else width + 1)
    numbers = F.col("numbers")
    parsed = parsed.withColumns(
        {"y": F.element_at(numbers, -1).try_cast("int"), "x": F.slice(numbers, 1, F.size(numbers) - 1)}
    ).drop("numbers")
    return parsed.withColumn("reason", F.coalesce("reason", F.when(F.col("y").isNull(), "label out of range")))


def parse_vectors(lines: DataFrame, width: int | None = None) -> DataFrame:
    """Every word between single spaces is a value; ``width`` rejects vectors of another width."""
    shape = None if width is None else _wrong_width(width)
    return _parse(lines, _tokens_on_single(), shape, width).withColumnRenamed("numbers", "x")


def load_vectors(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """``parse_vectors`` of every line under ``path``; without ``width``, the first record's is the one all must have."""
    return parse_vectors(scan_lines(spark, path), width or first_width(spark, path))


def load_label_last(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """``parse_label_last`` of every line under ``path``; without ``width``, all must be as wide as the first record."""
    if width is None and (values := first_width(spark, path)):
        width = values - 1
    return parse_label_last(scan_lines(spark, path), width)


def parse_vectors_fixed(lines: DataFrame, width: int) -> DataFrame:
    """The first ``width`` words between runs of spaces; further words are ignored."""
    shape = F.when(F.size("tokens") < width, "too few values")
    return _parse(lines, _tokens_on_runs(), shape, width).withColumnRenamed("numbers", "x")


def _wrong_width(width: int) -> Column:
    return F.when(F.size("tokens") != width, "wrong number of dimensions")


def reject_counts(lines: DataFrame, parsers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``(loader, reason, lines)``: how many lines each parser rejects and why, in one pass."""
    df = lines.select("value")
    for name, parse in parsers.items():
        df = parse(df).withColumnRenamed("reason", name).drop("x", "y")
    reasons = df.unpivot([], list(parsers), "loader", "reason").where(F.col("reason").isNotNull())
    return reasons.groupBy("loader", "reason").agg(F.count(F.lit(1)).alias("lines"))


#: Why a parser rejects a line.
REASONS = ("too few values", "wrong number of dimensions", "not a number", "not finite", "label out of range")


def counted(parsed: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows, and rejected lines by reason, counted as the first job passes over them. That job must read all of them.

    ``Observation.get`` waits for it: ``{reason: lines}``.
    """
    seen = Observation()
    counts = [F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in REASONS]
    return parsed.observe(seen, *counts), seen


def store(parsed: DataFrame, path: str) -> tuple[DataFrame, dict[str, int]]:
    """Parse every line once: good points and bad lines go to one table, in a folder for each reason, and are counted on the way.

    Returns the table to go on with, of the same columns; ``points`` and ``rejects`` read their own folders only. The texts of
    good lines are left out. Counts: ``{reason: lines}``, none that are 0.
    """
    spark = parsed.sparkSession
    rows, seen = counted(parsed.withColumn("value", F.when(F.col("reason").isNotNull(), F.col("value"))))
    # A few files are open at a time in a task, or its rows would be sorted by reason.
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, str(len(REASONS) + 1))
    try:
        rows.write.mode("overwrite").partitionBy("reason").parquet(path)
    finally:
        spark.conf.set(writers, before)
    return spark.read.schema(parsed.schema).parquet(path).select(*parsed.columns), {r: n for r, n in seen.get.items() if n}


def points(parsed: DataFrame, mode: str = "reject") -> DataFrame:
    """The good rows. ``mode="fail"`` ends the job at a bad line instead of leaving it out."""
    values = [c for c in parsed.columns if c not in ("value", "reason")]
    if mode == "reject":
        return parsed.where(F.col("reason").isNull()).select(*values)
    if mode != "fail":
        raise ValueError(f"unknown mode: {mode}")
    message = F.concat(F.col("reason"), F.lit(": "), F.col("value"))
    return parsed.select(
        *[F.when(F.col("reason").isNull(), F.col(c)).otherwise(F.raise_error(message)).alias(c) for c in values]
    )


def rejects(parsed: DataFrame) -> DataFrame:
    """The bad lines with their reason."""
    return parsed.where(F.col("reason").isNotNull()).select("value", "reason")


def write_lines(lines: DataFrame, path: str) -> None:
    """Write the one column of ``lines``, replacing what was there."""
    lines.write.mode("overwrite").text(path)


def write_points(df: DataFrame, path: str) -> None:
    """Values separated by a space; the label ``y`` comes first if there is one."""
    x = as_text(F.col("x"))
    value = F.concat_ws(" ", F.col("y").cast("string"), x) if "y" in df.columns else x
    write_lines(df.select(value.alias("value")), path)


def write_result(df: DataFrame, path: str) -> None:
    """Result vectors ``x``: every value is followed by a space, so the line ends with one."""
    write_lines(df.select(F.concat(as_text(F.col("x")), F.lit(" ")).alias("value")), path)
