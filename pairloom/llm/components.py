"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a grouped minimum (combined before the shuffle) and an equi-join that adaptive execution
may split, so a node with very many neighbours never gathers in one task. Before the first step every
task replaces its links, block by block, by a spanning forest of stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut

BLOCK = 200_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable by the links)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size = [], 0

    def out():
        links = pd.concat(held)
        nodes, root = forest(links["a"].to_numpy(), links["b"].to_numpy())
        keep = nodes != root
        return pd.DataFrame({"a": nodes[keep], "b": root[keep]})

    for batch in batches:
        if len(batch):
            held.append(batch)
            size += len(batch)
        if size >= BLOCK:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long), any order, repeats allowed -> (node, component): the smallest node reachable.

    Only nodes that have a link to another node appear. Links with a null end are ignored; an empty
    table gives an empty table.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    edges, seen = cut(links.mapInPandas(_stars, "a long, b long").distinct()), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        new = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = cut(new.where("a <> b").distinct())
        edges, before, seen = new, seen, new.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(b as decimal(38)))")).first()
        if seen == before or not seen[0]:
            break
    return new.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
