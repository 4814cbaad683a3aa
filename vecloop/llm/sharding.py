"""Stable shards by jump consistent hashing, and gapless places within each shard.

Only DataFrame functions: no Python runs on the rows. The text itself is never shuffled.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from vecloop.llm.common import pick
from vecloop.session import write_and_reread

# Fixed values of jump consistent hashing: the generator's multiplier, and the word it works in.
MULTIPLIER = Decimal(2862933555777941757)
WORD = Decimal(2**64)


def jump_shard(key: Column, shards: int) -> Column:
    """Jump consistent hash of a long key, as published (Lamping and Veach, 2014).

    Each step draws the shard count at which the key moves next; the last one below ``shards`` is
    its shard. So the count only ever cuts the same chain of jumps, and one more shard takes keys
    only into itself. A null key counts as 0.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    as_signed = lambda d: F.when(d >= Decimal(2**63), d - WORD).otherwise(d).cast("long")
    unsigned = lambda k: F.when(k < 0, k.cast("decimal(20,0)") + WORD).otherwise(k).cast("decimal(20,0)")

    def step(state: Column, _: Column) -> Column:
        drawn = as_signed((unsigned(state["key"]) * F.lit(MULTIPLIER) + F.lit(Decimal(1))) % F.lit(WORD))
        high = F.shiftrightunsigned(drawn, 33) + F.lit(1)
        jump = F.floor((state["next"] + 1) * (F.lit(float(1 << 31)) / high.cast("double"))).cast("long")
        moved = F.struct(drawn.alias("key"), state["next"].alias("shard"), jump.alias("next"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    start = F.struct(
        F.coalesce(key.cast("long"), F.lit(0).cast("long")).alias("key"),
        F.lit(-1).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("next"),
    )
    # A chain below `shards` has at most that many jumps, since each goes up.
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)["shard"].cast("int")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard that its id and the number of shards decide.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. ``size`` is the UTF-8 length
    plus 1, a null text counts as empty, a null id as key 0. ``slot`` numbers each shard from 0 by
    (id, size, checksum); rows equal in all three are interchangeable, so ties have one result. Rows
    repeated any number of times all get places. An empty table gives no rows.

    Places are numbered in parallel: rows are range-partitioned (rows that tie are spread at random),
    written, numbered within (shard, partition), and moved by the count of the partitions before.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    body = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    rows = rows.select(
        "doc_id",
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        jump_shard(F.col("doc_id"), shards).alias("shard"),
        jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    order = ["doc_id", "size", "text_crc32"]
    ranged = rows.repartitionByRange(*order, F.rand(42)).withColumn("part", F.spark_partition_id())
    placed = write_and_reread(ranged, "shards")

    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order))
    return placed.join(offsets, ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("offset") + within - 1).alias("slot"),
        "grown_shard",
    )
