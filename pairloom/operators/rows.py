"""Operators that look at one row at a time: no shuffle, all inside code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RECORD_SEP, SAM_SEP, UNMAPPED_CHROM, sides


def remove_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drops the named columns; names that the table lacks are ignored."""
    return df.drop(*columns)


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    missing = [c for c in types if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def is_mapped(side: int, marker: str = UNMAPPED_CHROM) -> Column:
    return F.col(f"chrom{side}") != marker


def filter_mapped(df: DataFrame, kind: str = "both", marker: str = UNMAPPED_CHROM) -> DataFrame:
    """kind: both, one, none or not_both sides mapped."""
    a, b = is_mapped(1, marker), is_mapped(2, marker)
    tests = {"both": a & b, "one": a != b, "none": ~a & ~b, "not_both": ~(a & b)}
    return df.where(tests[kind])


def chrom_subset(df: DataFrame, chroms: Sequence[str]) -> DataFrame:
    return df.where(F.col("chrom1").isin(list(chroms)) & F.col("chrom2").isin(list(chroms)))


def with_ranks(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df + rank1_, rank2_: the places of both chromosomes in the order, null for those that it lacks. The names are broadcast, a row each."""
    table = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(dict.fromkeys(order))], "c_ string, r_ int")
    for side in (1, 2):
        named = F.broadcast(table.select(F.col("c_").alias(f"c{side}_"), F.col("r_").alias(f"rank{side}_")))
        df = df.join(named, F.col(f"chrom{side}") == F.col(f"c{side}_"), "left").drop(f"c{side}_")
    return df


def swapped(df: DataFrame, wrong: Column) -> DataFrame:
    """All X1, X2 columns, and the letters of pair_type, exchanged where ``wrong`` holds."""
    changes = {}
    for a, b in sides(df.columns):
        changes[a] = F.when(wrong, F.col(b)).otherwise(F.col(a))
        changes[b] = F.when(wrong, F.col(a)).otherwise(F.col(b))
    if "pair_type" in df.columns:
        turned = F.concat(F.substring("pair_type", 2, 1), F.substring("pair_type", 1, 1))
        changes["pair_type"] = F.when(wrong & (F.length("pair_type") == 2), turned).otherwise(F.col("pair_type"))
    return df.withColumns(changes)


def flip(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Upper triangle: sides in the order of chromosomes, then positions.

    With both chromosomes in the order, (rank, pos) of side 1 must not exceed side 2; with one, it comes first; with
    none, side 1 must have the smaller name, so equal unknown names are exchanged too. The unmapped marker ranks below all.
    """
    order = [UNMAPPED_CHROM, *[c for c in order if c != UNMAPPED_CHROM]]
    df = with_ranks(df, order)
    r1, r2 = F.col("rank1_"), F.col("rank2_")
    right = (
        F.when(r1.isNotNull() & r2.isNotNull(), (r1 < r2) | ((r1 == r2) & (F.col("pos1") <= F.col("pos2"))))
        .when(r1.isNull() & r2.isNull(), F.col("chrom1") < F.col("chrom2"))
        .otherwise(r1.isNotNull())
    )
    return swapped(df, ~right).drop("rank1_", "rank2_")


def _mark_sam(sam: Column) -> Column:
    """Every record of a SAM column: flag 1024 set, Yt:Z: tags turned to Yt:Z:DD; one-field values stay."""

    def mark(record: Column) -> Column:
        fields = F.split(record, SAM_SEP, -1)
        marked = F.transform(
            fields,
            lambda f, i: F.when(i == 1, f.cast("int").bitwiseOR(F.lit(1024)).cast("string")).when((i >= 11) & f.startswith("Yt:Z:"), F.lit("Yt:Z:DD")).otherwise(f),
        )
        return F.when(F.size(fields) > 1, F.array_join(marked, SAM_SEP)).otherwise(record)

    return F.array_join(F.transform(F.split(sam, RECORD_SEP, -1), mark), RECORD_SEP)


def mark_duplicates(df: DataFrame, where: Column | None = None) -> DataFrame:
    """pair_type DD, and the SAM records, where there are any, flagged as duplicates; only of the rows where ``where`` holds."""
    changes = {"pair_type": F.lit("DD")} | {c: _mark_sam(F.col(c)) for c in ("sam1", "sam2") if c in df.columns}
    return df.withColumns(changes if where is None else {c: F.when(where, new).otherwise(F.col(c)) for c, new in changes.items()})


def split_pairs(df: DataFrame) -> DataFrame:
    """The pairs without their SAM columns; a table with only one of them is an error."""
    has = [c in df.columns for c in ("sam1", "sam2")]
    if any(has) and not all(has):
        raise ValueError("sam1 and sam2 must come together")
    return df.drop("sam1", "sam2")


def split_sam(df: DataFrame) -> DataFrame:
    """(readID, side, record, line): the SAM lines of both sides, tab-separated."""
    both = F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"sam{i}").alias("sam")) for i in (1, 2)])
    each = df.select("readID", F.explode(both).alias("s")).where("s.sam <> '.'")
    each = each.select("readID", "s.side", F.posexplode(F.split("s.sam", RECORD_SEP, -1)).alias("record", "text"))
    return each.select("readID", "side", "record", F.array_join(F.split("text", SAM_SEP, -1), "\t").alias("line"))


def tile(read_id: Column, pattern: str | None = None) -> Column:
    """Fields 3 to 5 of a colon-separated read name, or the whole match of a regular expression."""
    if pattern is not None:
        return F.regexp_extract(read_id, pattern, 0)
    return F.array_join(F.slice(F.split(read_id, ":"), 3, 3), ":")


def sample(df: DataFrame, fraction: float, seed: int = 0, keys: Sequence[str] = ("readID",)) -> DataFrame:
    """Rows whose hash of keys and seed falls below the fraction: the same rows however the table is laid out.

    The hash is the first 32 bits of an MD5 sum, which other engines have as well.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie between 0 and 1")
    head = F.conv(F.substring(F.md5(F.concat_ws("\t", *keys, F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return df.where(head < int(round(fraction * 2**32)))
