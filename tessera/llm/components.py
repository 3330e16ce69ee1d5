"""Connected components of a table of links, without gathering links anywhere: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import materialise


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``links`` (u, v: long).

    A large star connects every node's larger neighbours with its smallest one, a small star the smaller ones; after a
    logarithmic number of rounds every component is a star around its smallest node. Every round is written to the
    shared folder. Null ends and loops are ignored; repeated links count once; no links give no rows.
    """
    edges = links.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    edges = materialise(edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct(), label)
    before = None
    # Each side of a join is read from files of its own: a node with very many neighbours then makes a large partition that
    # Spark can split, which it can't where the smallest neighbour is found in the same stage.
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), label)
        large = materialise(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), label)
        # the large star's links point from larger to smaller nodes
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), label)
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        edges = materialise(small, label)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
