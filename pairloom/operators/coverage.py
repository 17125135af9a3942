"""Local coverage: how many other ends lie within a distance of a pair's ends.

How many ends there are around a place depends on the place alone, so the ends of all mapped pairs are first counted by
place (combined before the shuffle: a place with a billion ends is a row per task), summed over a range window, and joined back to
each pair's two places. Rows are never told apart by name: the pairs of one molecule may share theirs.

A range window per chromosome would sort a chromosome's places in one task. Chromosomes are therefore cut into blocks of
``block`` bases: a place is summed in its own block, where all places within the distance are present, as those near an edge are
listed in the neighbouring block too. A block holds at most ``block`` places and those around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import UNMAPPED_CHROM
from .rows import mark_duplicates

#: groups that unmapped rows are dealt into, as they match no place
SPREAD = 1 << 20


def _mapped(marker: str) -> Column:
    return F.coalesce((F.col("chrom1") != marker) & (F.col("chrom2") != marker), F.lit(False))


def ends_around(df: DataFrame, max_dist: int = 500, marker: str = UNMAPPED_CHROM, block: int | None = None) -> DataFrame:
    """(chrom, pos, n): places of ends of pairs mapped on both sides, and the ends within max_dist of them, less one."""
    block = block or max(1 << 20, 4 * (max_dist + 1))
    both = F.array(*[F.struct(F.col(f"chrom{i}").alias("chrom"), F.col(f"pos{i}").alias("pos")) for i in (1, 2)])
    places = df.where(_mapped(marker)).select(F.explode(both).alias("e")).groupBy("e.chrom", "e.pos").agg(F.count("*").alias("ends"))
    around = F.sequence(F.floor((F.col("pos") - max_dist) / block), F.floor((F.col("pos") + max_dist) / block))
    listed = places.withColumns({"home": F.floor(F.col("pos") / block), "block": F.explode(around)})
    window = Window.partitionBy("chrom", "block").orderBy("pos").rangeBetween(-max_dist, max_dist)
    return listed.withColumn("n", F.sum("ends").over(window) - 1).where("block = home").select("chrom", "pos", "n")


def with_coverage(df: DataFrame, max_dist: int = 500, method: str = "max", marker: str = UNMAPPED_CHROM, block: int | None = None) -> DataFrame:
    """df + cov1, cov2 (other ends on the chromosome within max_dist) and coverage: the larger one + 1, or their sum + 1; nulls unless both sides are mapped."""
    if method not in ("max", "sum"):
        raise ValueError("method must be max or sum")
    counts, out = ends_around(df, max_dist, marker, block), df
    nowhere = -1 - F.pmod(F.xxhash64("chrom1", "pos1", "chrom2", "pos2"), F.lit(SPREAD))
    for i in (1, 2):
        side = counts.select(F.col("chrom").alias("c_"), F.col("pos").alias("p_"), F.col("n").alias(f"cov{i}"))
        place = F.when(_mapped(marker), F.col(f"pos{i}")).otherwise(nowhere)
        out = out.join(side, (F.col(f"chrom{i}") == F.col("c_")) & (place == F.col("p_")), "left").drop("c_", "p_")
    return out.withColumn("coverage", (F.greatest("cov1", "cov2") if method == "max" else F.col("cov1") + F.col("cov2")) + 1)


def coverage(df: DataFrame, max_dist: int = 500, key: str = "readID", method: str = "max", marker: str = UNMAPPED_CHROM, block: int | None = None) -> DataFrame:
    """(key, cov1, cov2, coverage), a row for each pair mapped on both sides, whatever their keys."""
    return with_coverage(df.where(_mapped(marker)), max_dist, method, marker, block).select(key, "cov1", "cov2", "coverage")


def filter_by_coverage(df: DataFrame, max_cov: int = 8, max_dist: int = 500, method: str = "max", marker: str = UNMAPPED_CHROM, mark_multi: bool = False) -> DataFrame:
    """df + route: ``low`` (kept), ``high`` (more than max_cov), ``unmapped``; high ones marked as duplicates on request."""
    out = with_coverage(df, max_dist, method, marker)
    out = out.withColumn("route", F.when(F.col("coverage").isNull(), "unmapped").when(F.col("coverage") > max_cov, "high").otherwise("low")).drop("cov1", "cov2", "coverage")
    return mark_duplicates(out, F.col("route") == "high") if mark_multi else out
