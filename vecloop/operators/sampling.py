"""Sampling of exactly K rows, or of K different vectors."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vecloop.functions.vectors import as_text


def sample_k(df: DataFrame, k: int, id_col: str, seed: int = 42) -> DataFrame:
    """Exactly K rows without replacement (all rows if there are fewer), in drawing order.

    Ordered by a digest of (seed, id): the draw does not depend on the partitioning, and Spark keeps
    only K rows per partition before merging them.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return df.orderBy(digest, F.col(id_col)).limit(k)


def sample_vectors(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``(digest, x)``: K different vectors (all if there are fewer), in drawing order.

    Ordered by a digest of (seed, the vector's own text), so the draw depends neither on ids nor on how
    files are split, and copies count once. Each task hands on its K lowest only.
    """
    kind = points.schema["x"].dataType

    def lowest(batches):
        held: dict[str, list] = {}
        for batch in batches:
            digests = batch.column("digest").to_pylist()
            limit = max(held) if len(held) >= k else None
            for i, digest in enumerate(digests):
                if (limit is None or digest < limit) and digest not in held:
                    held[digest] = batch.column("x")[i].as_py()
                    if len(held) > k:
                        del held[max(held)]
                        limit = max(held)
        if held:
            yield pa.RecordBatch.from_pydict(
                {"digest": pa.array(list(held)), "x": pa.array(list(held.values()), pa.list_(pa.float64()))}
            )

    digest = F.md5(F.concat(F.lit(f"{seed}:"), as_text(F.col("x"))))
    rows = points.select(digest.alias("digest"), F.col("x").cast("array<double>"))
    found = rows.mapInArrow(lowest, "digest string, x array<double>").dropDuplicates(["digest"])
    return found.orderBy("digest").limit(k).withColumn("x", F.col("x").cast(kind))
