"""Sorting, merging and concatenating pair tables.

Sorting is a range-partitioned global sort: it spills, and no task sees a whole chromosome. Text sorts by
code point, which for the sentinel ``!`` means first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import column_type

KEYS = ("chrom1", "chrom2", "pos1", "pos2", "pair_type")


def _resolve(df: DataFrame, name: str | int) -> str:
    """A column by name or by its number, counted from 1."""
    if isinstance(name, int) or name not in df.columns and str(name).isdigit():
        i = int(name)
        if not 1 <= i <= len(df.columns):
            raise ValueError(f"no column {name}")
        return df.columns[i - 1]
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    return name


def _extra(df: DataFrame, name: str | int) -> Column:
    """Extra keys are numeric only if their name is that of a position; others, mapq1 among them, sort as text."""
    c = _resolve(df, name)
    return F.col(c) if column_type(c).simpleString() == "bigint" else F.col(c).cast("string")


def sort_pairs(
    df: DataFrame,
    c1: str | int = "chrom1",
    c2: str | int = "chrom2",
    p1: str | int = "pos1",
    p2: str | int = "pos2",
    pt: str | int = "pair_type",
    extra: Sequence[str | int] = (),
    ordinal: str | None = None,
) -> DataFrame:
    """By chromosomes, positions, pair type, extra columns; ``ordinal`` names a column with the input order, for a stable sort."""
    keys = [F.col(_resolve(df, c)) for c in (c1, c2)] + [F.col(_resolve(df, c)).cast("long") for c in (p1, p2)] + [F.col(_resolve(df, pt))]
    keys += [_extra(df, c) for c in extra]
    return df.orderBy(*keys, *([ordinal] if ordinal else []))


def _same_columns(tables: Sequence[DataFrame]) -> None:
    if any(t.columns != tables[0].columns for t in tables):
        raise ValueError("the tables cannot contain different columns")


def concatenate(tables: Sequence[DataFrame]) -> DataFrame:
    _same_columns(tables)
    return reduce(DataFrame.unionByName, tables)


def merge(tables: Sequence[DataFrame]) -> DataFrame:
    """One sorted table of several; ties are in the order of the whole line. A single table passes unchanged."""
    if len(tables) == 1:
        return tables[0]
    both = concatenate(tables)
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in both.columns])
    return both.orderBy(*KEYS, line)
