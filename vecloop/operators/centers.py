"""Old and new centres of a model, matched by id. Both sides are K-row tables ``(cid, c)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vecloop.functions.vectors import squared_distance


def join_centers(old: DataFrame, new: DataFrame, empty: str = "keep") -> DataFrame:
    """``(cid, old_c, new_c)`` for every old centre.

    A centre that is missing in ``new`` has a NULL ``new_c``, or is an error with ``empty="error"``.
    """
    joined = old.select("cid", F.col("c").alias("old_c")).join(
        new.select("cid", F.col("c").alias("new_c")), "cid", "left"
    )
    if empty == "error":
        message = F.concat(F.lit("no new centre for cluster "), F.col("cid").cast("string"))
        found = F.when(F.col("new_c").isNotNull(), F.col("new_c")).otherwise(F.raise_error(message))
        joined = joined.withColumn("new_c", found)
    return joined


def moved_centers(old: DataFrame, new: DataFrame, empty: str = "keep") -> DataFrame:
    """``(cid, c, moved)``: old centres, replaced where a new one exists, and the squared distance each has moved."""
    c = F.coalesce("new_c", "old_c")
    moved = squared_distance(F.col("old_c"), c)
    return join_centers(old, new, empty).select("cid", c.alias("c"), moved.alias("moved"))


def upsert_centers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old centres, replaced where a new one exists."""
    return moved_centers(old, new).select("cid", "c")


def center_shift(old: DataFrame, new: DataFrame, empty: str = "keep") -> DataFrame:
    """One row: the summed squared distance from old to new; a missing centre does not move."""
    return moved_centers(old, new, empty).agg(F.sum("moved").alias("shift"))
