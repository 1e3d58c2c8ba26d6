"""Connected components of an edge table, by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import settle


def components(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node, root): the smallest node that can be reached, for every node of an edge.

    Alternates the two star steps: every node hands the smallest neighbour it
    knows first to its larger neighbours, then to its smaller ones, until no
    edge changes. Each round works on distinct edges (a chain shrinks to about
    half), is written to the shared folder, and leaves one edge per node at
    the end. Nodes may be of any ordered type; edges with a null end and
    loops are dropped. No edges give no rows.
    """
    links = settle(
        edges.select(F.col(source).alias("u"), F.col(target).alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "v > u")
        small = _star(large, "v < u", down=True)
        links = settle(small)
        mark = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if mark == seen:
            heads = links.select(F.col("v").alias("node")).distinct()
            stars = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return stars.unionByName(heads.withColumn("root", F.col("node")))
        seen = mark


def _star(edges: DataFrame, kept: str, down: bool = False) -> DataFrame:
    """Link the kept neighbours of every node to the smallest node it knows."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = edges.filter(kept).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if down:  # the node itself moves under the smallest one too
        linked = linked.unionByName(least.select("u", F.col("m").alias("v")))
    return linked.filter("u <> v").distinct()
