"""Exact embedding near-dedup by blocked matrix products.

Equal vectors of a label become one node with a count. The nodes of a label are ordered by 64 one-bit random hashes (signs of projections), so that like
vectors stand together, and cut into blocks of at most ``block`` nodes, each with its centre and the largest angle to it. Every block meets itself and, of
its label, every other block that can hold a vector near enough: when the angle between two centres exceeds both radii and the threshold's angle together,
no pair of theirs reaches the threshold, by the triangle inequality. The blocks that meet are multiplied as matrices, in double precision; links
are counted, and a spanning forest of each product goes on to the components. So no pair with cosine >= ``threshold`` is missed, whatever the order. Where vectors of a
label lie in groups the work is about that of the groups; where they don't, it grows with the square of the label, spread over all tasks.

Defined cases: vectors that are null, zero, of another length than 1 or more, or hold null or non-finite components, and vectors with a null
label, link with nothing; vectors of different lengths never link; rows that repeat an id count as vectors of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .store import cut, light_batches

#: nodes a block, rows of a product at a time, tasks that list the meetings of a label
BLOCK, STRIP, SPREAD = 1024, 512, 16


def _unit(v) -> np.ndarray | None:
    if v is None or not len(v):
        return None
    try:
        a = np.asarray(v, np.float64)
    except (TypeError, ValueError):
        return None
    if not np.isfinite(a).all():
        return None
    top = np.abs(a).max()
    if top == 0:
        return None
    a = a / top
    return a / np.sqrt(a @ a)


def _classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Class number and unit vector; both null for vectors that link with nothing."""
    for batch in batches:
        number, unit = [], []
        for v, label in zip(batch["embedding"], batch["label"], strict=True):
            u = None if pd.isna(label) else _unit(v)
            if u is None:
                number.append(None)
                unit.append(None)
            else:
                raw = u.tobytes()
                number.append(int.from_bytes(hashlib.blake2b(raw + str(label).encode(), digest_size=8).digest(), "big", signed=True))
                unit.append(raw)
        yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "node": pd.array(number, "Int64"), "unit": unit})


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng((dim, 0)).standard_normal((dim, 64))


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    planes: dict[int, np.ndarray] = {}
    weight = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    for batch in batches:
        length = batch["unit"].str.len().to_numpy()
        for n in np.unique(length):
            part = batch[length == n]
            m = np.frombuffer(b"".join(part["unit"]), np.float64).reshape(len(part), -1)
            bits = (m @ planes.setdefault(m.shape[1], _planes(m.shape[1])) > 0).astype(np.uint64)
            # ordered as unsigned numbers, so that the first hash decides first
            key = ((bits * weight).sum(1) ^ np.uint64(1 << 63)).view(np.int64)
            yield pd.DataFrame({"dim": m.shape[1], "label": part["label"], "key": key, "node": part["node"], "copies": part["copies"], "unit": part["unit"]})


def _blocks(block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held = TaskContext.get().partitionId() << 32, None

        def told(rows: pd.DataFrame) -> dict:
            m = np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(len(rows), -1)
            centre = _unit(m.mean(0))
            centre = m[0] if centre is None else centre
            return {"block": number, "dim": m.shape[1], "label": rows["label"].iloc[0], "centre": centre.tobytes(), "radius": _angle(float((m @ centre).min())), "nodes": rows["node"].to_numpy(np.int64).tobytes(), "copies": rows["copies"].to_numpy(np.int64).tobytes(), "units": m.tobytes()}

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            held = None
            group = rows[["dim", "label"]].astype("int64").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1, [len(rows)]))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                for at in range(lo, hi, block):
                    part = rows.iloc[at : min(at + block, hi)]
                    if at + len(part) == len(rows) and len(part) < block:
                        held = part
                    else:
                        yield pd.DataFrame([told(part)])
                        number += 1
        if held is not None and len(held):
            yield pd.DataFrame([told(held)])

    return run


def _angle(cosine: float) -> float:
    return float(np.arccos(np.clip(cosine, -1.0, 1.0)))


def _meet(threshold: float):
    """Of pairs of blocks those that can hold a link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = _angle(threshold) + 1e-6
        for batch in batches:
            apart = [_angle(float(np.frombuffer(a) @ np.frombuffer(b))) for a, b in zip(batch["centre"], batch["other"], strict=True)]
            yield batch.loc[(batch["i"] == batch["j"]) | (np.array(apart) <= batch["radius"] + batch["reach"] + most), ["i", "j"]]

    return run


def _linked(threshold: float):
    """Products of blocks to (node, links) and, with a null count, to links of a spanning forest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                x, y = np.frombuffer(r.nodes, np.int64), np.frombuffer(r.nodes2, np.int64)
                cx, cy = np.frombuffer(r.copies, np.int64), np.frombuffer(r.copies2, np.int64)
                m, other = np.frombuffer(r.units).reshape(len(x), -1), np.frombuffer(r.units2).reshape(len(y), -1)
                left, right, a, b = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                for lo in range(0, len(x), STRIP):
                    near = m[lo : lo + STRIP] @ other.T >= threshold
                    if r.i == r.j:
                        near[np.arange(len(near)), lo + np.arange(len(near))] = False
                    if not near.any():
                        continue
                    left[lo : lo + STRIP] = near @ cy
                    right += cx[lo : lo + STRIP] @ near
                    p, q = np.nonzero(near)
                    node, root = forest(np.concatenate([a, x[lo + p]]), np.concatenate([b, y[q]]))
                    a, b = node[node != root], root[node != root]
                counted = [(x, left)] if r.i == r.j else [(x, left), (y, right)]
                node, links = (np.concatenate(c) for c in zip(*counted, strict=True))
                some = links > 0
                yield pd.DataFrame({"a": np.concatenate([node[some], a]), "b": pd.array([*[None] * int(some.sum()), *b], "Int64"), "links": pd.array([*links[some], *[None] * len(a)], "Int64")})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """vectors(vec_id, embedding, label) -> (vec_id, n_links, component_id, kept)."""
    light_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    rows = cut(rows.mapInPandas(_classes, "vec_id long, label long, node long, unit binary"))
    nodes = cut(rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.min("label").alias("label"), F.min("unit").alias("unit")))
    keyed = nodes.select("node", "label", "copies", "unit").mapInPandas(_keys, "dim int, label long, key long, node long, copies long, unit binary")
    order = ["dim", "label", "key", "node"]
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = cut(keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(_blocks(block), "block long, dim int, label long, centre binary, radius double, nodes binary, copies binary, units binary"))
    one = blocks.select(F.col("block").alias("i"), "dim", "label", "centre", "radius", F.pmod(F.xxhash64("block"), F.lit(SPREAD)).alias("salt"))
    two = blocks.select(F.col("block").alias("j"), "dim", "label", F.col("centre").alias("other"), F.col("radius").alias("reach"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("salt"))
    meet = one.join(two, ["dim", "label", "salt"]).where("i <= j").select("i", "j", "centre", "other", "radius", "reach").mapInPandas(_meet(threshold), "i long, j long")
    body = ("nodes", "copies", "units")
    pairs = meet.join(blocks.select(F.col("block").alias("i"), *body), "i").join(blocks.select(F.col("block").alias("j"), *[F.col(c).alias(f"{c}2") for c in body]), "j")
    found = cut(pairs.mapInPandas(_linked(threshold), "a long, b long, links long"))
    component = components(found.where("b is not null").select("a", "b"))
    counts = found.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))

    low = component.join(nodes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("component_id"))
    linked = component.join(low, "component").join(counts, "node", "left").select("node", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    told = cut(nodes.select("node", "first", "copies").join(linked, "node", "left").select("node", F.coalesce("component_id", "first").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("l")))
    out = rows.select("vec_id", "node").join(told, "node", "left")
    out = out.select("vec_id", F.coalesce("l", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3(spark, sf_dir: str) -> DataFrame:
    from .store import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: the same in DuckDB, by all pairs of a label
ORACLE = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding) AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
low AS (SELECT x, min(y) AS m FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
o AS (SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(low.m, e.vec_id)) AS component_id FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN low ON low.x = e.vec_id)
SELECT *, vec_id = component_id AS kept FROM o"""
