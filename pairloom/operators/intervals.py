"""Positions looked up in restriction fragments and regions.

Both are intervals that don't overlap. Each is listed in every bin of a power of two that it reaches, and a position meets the
intervals of its own bin in an equi-join. Bins are about as wide as the mean interval, so the list is about twice as long as the table, and a
bin holds a few intervals, ``2**bits`` at most. A list of up to ``BROADCAST`` rows is broadcast; a longer one is shuffled, as Spark decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import UNANNOTATED_FRAGMENT, UNMAPPED_CHROM

#: rows of a broadcast list, some 60 bytes each
BROADCAST = 500_000


def _listed(table: DataFrame) -> tuple[DataFrame, int]:
    """table(chrom, lo, hi, ...) -> the same by bin, and the bins' bits; small enough lists are marked for broadcast."""
    n, length = table.agg(F.count("*"), F.sum(F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))).first()
    bits = max(0, math.ceil(math.log2(length / n))) if n else 0
    out = table.where("hi > lo").withColumn("bin", F.explode(F.sequence(F.shiftright("lo", bits), F.shiftright(F.col("hi") - 1, bits))))
    return (F.broadcast(out) if 3 * n <= BROADCAST else out), bits


def _found(df: DataFrame, side: int, listed: DataFrame, bits: int) -> DataFrame:
    """df + the columns of the interval that holds the side's position, under names with x_ before them; nulls if none does."""
    t = listed.select(*[F.col(c).alias(f"x_{c}") for c in listed.columns])
    pos = F.col(f"pos{side}").cast("long")
    on = (F.col(f"chrom{side}") == F.col("x_chrom")) & (F.shiftright(pos, bits) == F.col("x_bin")) & (pos >= F.col("x_lo")) & (pos < F.col("x_hi"))
    return df.join(t, on, "left")


def annotate_fragments(df: DataFrame, fragments: DataFrame) -> DataFrame:
    """rfrag1, rfrag_start1, rfrag_end1 and the same for side 2; -1, 0, 0 for unmapped sides and unknown chromosomes.

    fragments(chrom, start, end): only ends count, as fragments tile a chromosome; a fragment's bounds are the end before it + 1 (0 for the
    first) and its own end + 1. A position beyond the last fragment belongs to the last one.
    """
    by_chrom = Window.partitionBy("chrom").orderBy("end")
    f = fragments.select("chrom", F.col("end").cast("long").alias("end"))
    f = f.select("chrom", (F.row_number().over(by_chrom) - 1).alias("i"), F.coalesce(F.lag("end").over(by_chrom) + 1, F.lit(0)).alias("lo"), (F.col("end") + 1).alias("hi"), F.lead("end").over(by_chrom).isNull().alias("last"))
    listed, bits = _listed(f)
    ends = F.broadcast(f.where("last").select(F.col("chrom").alias("y_chrom"), F.col("i").alias("y_i"), F.col("lo").alias("y_lo"), F.col("hi").alias("y_hi")))  # one row per chromosome
    for side in (1, 2):
        df = _found(df, side, listed, bits).join(ends, F.col(f"chrom{side}") == F.col("y_chrom"), "left")
        known = F.col(f"chrom{side}") != UNMAPPED_CHROM
        # before the first fragment none matches; only positions at or beyond the last one's end belong to it
        beyond = F.col(f"pos{side}") >= F.col("y_hi")
        pick = lambda c, none: F.coalesce(F.when(known, F.coalesce(f"x_{c}", F.when(beyond, F.col(f"y_{c}")))), F.lit(none)).cast("long")  # noqa: E731, B023
        added = {f"rfrag{side}": pick("i", UNANNOTATED_FRAGMENT), f"rfrag_start{side}": pick("lo", 0), f"rfrag_end{side}": pick("hi", 0)}
        df = df.withColumns(added).drop("x_chrom", "x_i", "x_lo", "x_hi", "x_last", "x_bin", "y_chrom", "y_i", "y_lo", "y_hi")
    return df


def assign_regions(df: DataFrame, regions: DataFrame, sides: tuple[int, ...] = (1, 2)) -> DataFrame:
    """region{i}, region_start{i}, region_end{i}: the half-open region [start, end) that holds the position; -1 and nulls if none.

    regions(chrom, start, end) must not overlap. They are numbered in the order of chrom and start, which one task can do: a view holds
    chromosome arms, not fragments.
    """
    number: Column = F.row_number().over(Window.orderBy("chrom", "start")) - 1
    listed, bits = _listed(regions.select("chrom", F.col("start").cast("long").alias("lo"), F.col("end").cast("long").alias("hi"), number.alias("i")))
    for side in sides:
        df = _found(df, side, listed, bits)
        added = {f"region{side}": F.coalesce("x_i", F.lit(-1)).cast("long"), f"region_start{side}": F.col("x_lo"), f"region_end{side}": F.col("x_hi")}
        df = df.withColumns(added).drop("x_chrom", "x_lo", "x_hi", "x_i", "x_bin")
    return df
