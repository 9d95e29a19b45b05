"""Connected components of a graph given as a table of links.

Alternating large-star and small-star steps turn every component into a star
around its smallest node. A step is two aggregations by node that combine
before they shuffle and two joins that Spark can split where a node has many
neighbours; each result is written to the shared folder, which cuts lineage, and
the one before it is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimhound.llm.staging import new_path, staged, written
from claimhound.sources.shared import remove_folder


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest one (or itself)."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    larger = both.where("b > a").join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of ``links`` (a, b) reaches.

    Nodes are longs; links of a node with itself and null links are left out.
    """
    spark = links.sparkSession
    links = links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    path = new_path(spark, "links")
    now = written(links.distinct(), path)
    before = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.max("b")).first()
        if state == before:
            break
        before, last, path = state, path, new_path(spark, "links")
        now = written(_small_star(_large_star(now)), path)
        remove_folder(spark, last)
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = staged(leaves.unionByName(centres), "components")
    remove_folder(spark, path)
    return found
