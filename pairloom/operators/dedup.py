"""Duplicate removal.

Two mapped pairs match when chromosomes, strands and extra columns are equal and their positions differ by at
most ``max_mismatch``, by the larger of both differences (``max``) or their sum (``sum``).

Rows are first counted by coarse cells (combined before the shuffle, numbers only). Rows alone in theirs, most of most libraries, have neither copy nor match: they stay where they are and are never
shuffled whole. Which cells hold more goes to all tasks as a table of bits of bounded size; a wrong bit lets a row take the long way, to the same result.

Places of the other rows are counted (combined before the shuffle, so any number of exact copies is one row per task), dealt out by tiles, and those without another close by are
let go: in one sorted pass per half step a place looks at its nearest by pos1 in strips. What is left are nodes. Matches between nodes come from an equi-join on
grid cells with sides of max_mismatch + 1: a cell holds (max_mismatch + 1)**2 nodes at most, and each node meets its own and four neighbouring cells, so the join's
output is bounded by the number of nodes, however deep the sequencing. The other rows are shuffled whole once, by place, to find each place's first; those of places
with more than HOT copies are not. Two rules decide what goes:

* ``transitive``: components of the match graph; the first row of each stays.
* ``greedy``: rows in order; a row that stays removes all later rows that match it, a removed row
  removes none. Rows of different components never meet, so the order is followed inside each component alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import UNMAPPED_CHROM
from .graph import components, cut
from .rows import mark_duplicates

ORDER = ("chrom1", "chrom2", "pos1", "pos2", "pair_type", "readID")
#: copies of one place beyond which its rows are not gathered
HOT = 1_000_000
#: places that match another, up to which they are sent to all tasks (some 100 MB)
BROADCAST = 500_000
#: bits, at most, of the table of cells that hold several rows, 64 to a row (some 60 MB)
BITS = 1 << 26


def match_keys(extra: Sequence[str | tuple[str, str]] = ()) -> list[str]:
    """Grouping columns. An extra pair names the same column twice; comparing two different columns is not supported."""
    keys = ["chrom1", "chrom2", "strand1", "strand2"]
    for e in extra:
        a, b = (e, e) if isinstance(e, str) else e
        if a != b:
            raise ValueError(f"extra columns must have equal names: {a}, {b}")
        keys.append(a)
    return keys


def mapped(df: DataFrame, marker: str = UNMAPPED_CHROM) -> DataFrame:
    return df.where((F.col("chrom1") != marker) & (F.col("chrom2") != marker))


def _distance(method: str) -> Column:
    a, b = F.abs(F.col("l.pos1") - F.col("r.pos1")), F.abs(F.col("l.pos2") - F.col("r.pos2"))
    if method == "max":
        return F.greatest(a, b)
    if method == "sum":
        return a + b
    raise ValueError("method must be max or sum")


def candidate_edges(nodes: DataFrame, keys: Sequence[str], max_mismatch: int = 3, method: str = "max", node: str = "node") -> DataFrame:
    """(a, b): matching pairs of nodes(node, keys, pos1, pos2), each once, a before b by cell."""
    side = max_mismatch + 1
    cell = nodes.withColumns({"x": F.floor(F.col("pos1") / side), "y": F.floor(F.col("pos2") / side)})
    # its own cell and those above and right, below right, ...: each unordered pair of cells once
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    left = cell.withColumn("s", F.explode(steps)).withColumns({"cx": F.col("x") + F.col("s.i"), "cy": F.col("y") + F.col("s.j"), "own": (F.col("s.i") == 0) & (F.col("s.j") == 0)})
    l, r = left.alias("l"), cell.alias("r")
    on = (F.col("l.cx") == F.col("r.x")) & (F.col("l.cy") == F.col("r.y"))
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    on = on & (~F.col("l.own") | (F.col(f"l.{node}") < F.col(f"r.{node}"))) & (_distance(method) <= max_mismatch)
    return l.join(r, on).select(F.col(f"l.{node}").alias("a"), F.col(f"r.{node}").alias("b"))


def with_crowded(df: DataFrame, placed: Column, keys: Sequence[str], max_mismatch: int) -> DataFrame:
    """df + crowded_, which holds for every placed row that has a copy or another within max_mismatch, and for few others.

    Rows are counted by cells; one at a cell's upper rims is told to the next cells too, so rows that match share one. A cell with several tells the cells they came from.
    """
    side = 4 * (max_mismatch + 1) if max_mismatch else 1
    x, y = F.floor(F.col("pos1") / side), F.floor(F.col("pos2") / side)
    right, above = F.col("pos1") - x * side >= side - max_mismatch, F.col("pos2") - y * side >= side - max_mismatch
    group = F.hash(*keys)  # keys with one hash are taken for one here
    at = lambda i, j: F.struct((x + i).alias("x"), (y + j).alias("y"), F.lit(1 << i + 2 * j).alias("origin"))
    told = F.when(right | above, F.array(at(0, 0), F.when(right, at(1, 0)), F.when(above, at(0, 1)), F.when(right & above, at(1, 1)))).otherwise(F.array(at(0, 0)))
    cells = df.where(placed).select(group.alias("g"), F.explode(told).alias("t")).where("t is not null").groupBy("g", "t.x", "t.y").agg(F.count("*").alias("n"), F.bit_or("t.origin").alias("origins")).where("n > 1")
    home = lambda i, j: F.when(F.col("origins").bitwiseAND(F.lit(1 << i + 2 * j)) != 0, F.xxhash64("g", F.col("x") - i, F.col("y") - j))
    cells = cut(cells.select(F.explode(F.array(*[home(i, j) for i in (0, 1) for j in (0, 1)])).alias("h")).where("h is not null"))
    bits = min(max(1 << (16 * cells.count()).bit_length(), 1 << 10), BITS)
    words = cells.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("b")).groupBy(F.expr("shiftright(b, 6)").alias("word_")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("bits_"))
    asked = df.withColumn("b_", F.when(placed, F.xxhash64(group, x, y).bitwiseAND(F.lit(bits - 1)))).withColumn("word_", F.expr("shiftright(b_, 6)"))
    found = asked.join(F.broadcast(cut(words)), "word_", "left").withColumn("crowded_", F.expr("coalesce(shiftright(bits_, cast(b_ & 63 as int)) & 1 = 1, false)"))
    return found.drop("b_", "word_", "bits_")


def neighbours(spots: DataFrame, keys: Sequence[str], max_mismatch: int) -> DataFrame:
    """spots(keys, pos1, pos2, copies) + near, which holds for every spot that another lies close to, and for few others. Spots at the rim of a tile come several times.

    Two spots that match share a strip of pos2, 2 * (max_mismatch + 1) high, of this or the next lower half step; there a spot's nearest by pos1 is as near as any. One shuffle, by tiles:
    spots at a tile's upper rims are told to the next tiles too.
    """
    half = max_mismatch + 1
    tile = 128 * half
    x, y = F.floor(F.col("pos1") / tile), F.floor(F.col("pos2") / tile)
    right, above = F.col("pos1") - x * tile >= tile - half, F.col("pos2") - y * tile >= tile - half
    at = lambda i, j: F.struct((x + i).alias("x"), (y + j).alias("y"))
    tiles = F.when(right | above, F.array(at(0, 0), F.when(right, at(1, 0)), F.when(above, at(0, 1)), F.when(right & above, at(1, 1)))).otherwise(F.array(at(0, 0)))
    out = spots.withColumn("t", F.explode(tiles)).where("t is not null").withColumns({"tx": F.col("t.x"), "ty": F.col("t.y")}).drop("t").repartition(*keys, "tx", "ty")
    near = F.lit(False)
    for step in (0, half):
        w = Window.partitionBy(*keys, "tx", "ty", F.floor((F.col("pos2") + step) / (2 * half))).orderBy("pos1")
        near = near | F.coalesce(F.col("pos1") - F.lag("pos1").over(w) <= max_mismatch, F.lit(False)) | F.coalesce(F.lead("pos1").over(w) - F.col("pos1") <= max_mismatch, F.lit(False))
    return out.withColumn("near", near).drop("tx", "ty")


def _at(rows: DataFrame, table: DataFrame, spot: Sequence[str], how: str, columns: Sequence[str]) -> DataFrame:
    """rows joined with a table by place; nulls in grouping columns are equal."""
    condition = reduce(Column.__and__, [F.col(f"d.{c}").eqNullSafe(F.col(f"n.{c}")) if c not in ("chrom1", "chrom2", "pos1", "pos2") else F.col(f"d.{c}") == F.col(f"n.{c}") for c in spot])
    return rows.alias("d").join(table.alias("n"), condition, how).select("d.*", *[F.col(f"n.{c}") for c in columns])


def _roles(rows: DataFrame, nodes: DataFrame, spot: Sequence[str], keys: Sequence[str], max_mismatch: int, method: str, rule: str, order: Sequence[str], key: str) -> DataFrame:
    """(spot, is_head_, parent_) of the places that match another: whether one of its rows stays, and the key of the row that its others go by."""
    links = components(candidate_edges(nodes, keys, max_mismatch, method))
    linked = cut(nodes.select(*spot, "node").join(links, "node"))
    small = F.broadcast if linked.count() <= BROADCAST else lambda d: d
    low = F.min(F.struct(F.struct(*order).alias("place"), F.col(key).alias("first"))).alias("low")
    lows = _at(rows, small(linked), spot, "inner", ["node", "component"]).groupBy(*spot, "node", "component").agg(low)
    lows = cut(lows.select(*spot, "node", "component", "low.place", "low.first"))
    if rule == "greedy":
        ordered = lows.select("node", "component", "pos1", "pos2", "place").repartition("component").sortWithinPartitions("component", "place")
        heads = ordered.select("component", "node", "pos1", "pos2").mapInPandas(_greedy(max_mismatch, method), "node long, head long")
        heads = lows.join(heads, "node").select(*spot, "node", "head")
    else:
        heads = lows.groupBy("component").agg(F.min(F.struct("place", "node")).alias("low")).select("component", F.col("low.node").alias("head"))
        heads = lows.join(heads, "component").select(*spot, "node", "head")
    names = lows.select(F.col("node").alias("head"), F.col("first").alias("parent_"))
    return small(cut(heads.join(names, "head").select(*spot, (F.col("head") == F.col("node")).alias("is_head_"), "parent_")))


def _greedy(max_mismatch: int, method: str):
    """Rows sorted by component and order to (node, head): the first kept row that matches, or the node itself.

    Kept rows are listed by grid cells of side max_mismatch + 1, of which one holds few, as they don't match one another: a row looks at nine cells.
    """
    side = max_mismatch + 1
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]

    def near(p: int, q: int) -> bool:
        return (max(p, q) if method == "max" else p + q) <= max_mismatch

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept, count = None, {}, 0
        for batch in batches:
            heads = []
            for component, node, p, q in zip(*(batch[c].tolist() for c in ("component", "node", "pos1", "pos2")), strict=True):
                if component != current:
                    current, kept, count = component, {}, 0
                x, y = p // side, q // side
                found = [(n, k) for i, j in around for n, k, a, b in kept.get((x + i, y + j), ()) if near(abs(a - p), abs(b - q))]
                heads.append(min(found)[1] if found else node)
                if not found:
                    kept.setdefault((x, y), []).append((count, node, p, q))
                    count += 1
            yield pd.DataFrame({"node": batch["node"], "head": heads})

    return run


def deduplicate(
    df: DataFrame,
    max_mismatch: int = 3,
    method: str = "max",
    rule: str = "transitive",
    extra: Sequence[str | tuple[str, str]] = (),
    order: Sequence[str] = ORDER,
    marker: str = UNMAPPED_CHROM,
    key: str = "readID",
) -> DataFrame:
    """df + parent_readID + route: ``nodups``, ``dups`` or ``unmapped``.

    parent_readID is the row that a duplicate is one of, null for other rows. ``order`` gives the order
    that decides which row is first; of rows that it doesn't tell apart one stays, whatever their keys.
    """
    if max_mismatch < 0:
        raise ValueError("max_mismatch must not be negative")
    if rule not in ("transitive", "greedy"):
        raise ValueError("rule must be transitive or greedy")
    keys = match_keys(extra)
    spot = [*keys, "pos1", "pos2"]
    placed = F.coalesce((F.col("chrom1") != marker) & (F.col("chrom2") != marker) & F.col("pos1").isNotNull() & F.col("pos2").isNotNull(), F.lit(False))
    table = with_crowded(df, placed, keys, max_mismatch)
    rows = table.where("crowded_").drop("crowded_")
    spots = rows.groupBy(*spot).agg(F.count("*").alias("copies"))
    near = neighbours(spots, keys, max_mismatch) if max_mismatch else spots.withColumn("near", F.lit(False))
    marked_ = near.where(F.col("near") | (F.col("copies") > HOT)).groupBy(*spot).agg(F.max("copies").alias("copies"), F.max("near").alias("near"))
    nodes = cut(marked_.withColumn("node", F.monotonically_increasing_id()))
    roles = _roles(rows, nodes.where("near"), spot, keys, max_mismatch, method, rule, order, key) if max_mismatch else None
    content = F.xxhash64(*[F.col(f"`{f.name}`").cast("string") for f in df.schema.fields])
    numbered = rows.withColumn("content_", content)
    if roles is None:
        numbered = numbered.withColumns({"is_head_": F.lit(None).cast("boolean"), "parent_": F.lit(None).cast(df.schema[key].dataType)})
    else:
        numbered = _at(numbered, roles, spot, "left", ["is_head_", "parent_"])
    hot = nodes.where(F.col("copies") > HOT)
    some = hot.limit(1).count() > 0
    rest = _at(numbered, F.broadcast(hot), spot, "left_anti", []) if some else numbered
    by = [*dict.fromkeys([c for c in (*order, key) if c not in spot]), "content_"]
    w = Window.partitionBy(*spot).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = [rest.withColumns({"number_": F.row_number().over(w), "first_": F.first(key).over(w)})]
    if some:
        # rows of a place with very many copies stay where they are; only those equal to its first are numbered
        low = F.struct(*by)
        lows = _at(numbered, F.broadcast(hot), spot, "left_semi", []).groupBy(*spot).agg(F.min(low).alias("low_"))
        there = _at(numbered, F.broadcast(lows), spot, "inner", ["low_"]).withColumn("first_", F.col(f"low_.{key}") if key in by else F.col(key))
        tied = low.eqNullSafe(F.col("low_"))
        first.append(there.where(~tied).withColumn("number_", F.lit(2)).drop("low_"))
        first.append(there.where(tied).withColumn("number_", F.row_number().over(Window.partitionBy(*spot).orderBy("content_"))).drop("low_"))
    out = reduce(DataFrame.unionByName, first)
    dup = ~(F.coalesce("is_head_", F.lit(True)) & (F.col("number_") == 1))
    out = out.select(*[F.col(f"`{c}`") for c in df.columns], F.when(dup, "dups").otherwise("nodups").alias("route"), F.when(dup, F.coalesce("parent_", "first_")).alias("parent_readID"))
    others = table.where("not crowded_").withColumn("route", F.when(placed, "nodups").otherwise("unmapped"))
    return out.unionByName(others.drop("crowded_").withColumn("parent_readID", F.lit(None).cast(df.schema[key].dataType)))


def marked(df: DataFrame, sam: bool = False) -> DataFrame:
    """The routed table with duplicates marked: pair_type DD, with ``sam`` their SAM records too."""
    dup = F.col("route") == "dups"
    return mark_duplicates(df, dup) if sam else df.withColumn("pair_type", F.when(dup, "DD").otherwise(F.col("pair_type")))
