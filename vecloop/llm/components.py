"""Connected components of a table of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vecloop.session import write_and_reread


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``, root being the least node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each hangs neighbours on the least
    node seen, so a hub's links shrink to one a node. Every round is written to the shared folder, which
    cuts the lineage; it ends when a round leaves the links as they were. Loops and repeated links do no harm.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    links = write_and_reread(links, "links")
    before = None
    while True:
        state = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == before:
            break
        before = state
        links = write_and_reread(_small_star(_large_star(links)), "links")
    roots = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(links.select("a", "a")).groupBy("node").agg(F.min("root").alias("root"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are hung on the least of the node and its neighbours."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.where("v > u").join(least, "u")
    return hung.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are hung on the least of them."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    hung = links.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("v"))
    own = least.select(F.col("m").alias("a"), F.col("b").alias("v"))
    return hung.union(own).where("a <> v").select("a", F.col("v").alias("b")).distinct()
