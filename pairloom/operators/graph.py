"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), with built-in functions.

A step is a grouped minimum and an equi-join; both bear nodes with very many links. Lineage is cut by
reliable checkpoints after every step.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the folder that spark.checkpoint.dir names. Where it is unset, on one machine a folder of our own; a cluster shares none, so there it must be set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pairloom-"))
    return df.checkpoint(eager=True)


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, component): the smallest node reachable, for all nodes that have a link to another."""
    edges, seen = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        before, seen = seen, edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if seen == before or not seen[0]:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
