"""Reading and writing pair files, and the small tables that go with them.

Files are read by Spark, so any path that Spark can open will do; .gz is decompressed by extension (one task a file, dealt out
afterwards), .bgz likewise. The header is the run of # lines that a file begins with, of which no more than the first split is read; a # line further down is a
record like any other, unless it equals a header line. The body is split on tabs, keeping empty fields at the end; rows with fewer fields than columns are filled with nulls. Shell commands as (de)compressors and LZ4 frames are not supported and raise.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PAIRS, column_type
from .header import Header

UNSUPPORTED = (".lz4", ".bam", ".cram")


@dataclass(frozen=True)
class PairsTable:
    """A lazy table and its header."""

    df: DataFrame
    header: Header

    def apply(self, operator, *args, program: str | None = None, **options) -> PairsTable:
        """The table after an operator DataFrame -> DataFrame; the column line follows, and a program record is added."""
        df = operator(self.df, *args, **options)
        header = self.header.with_columns(df.columns)
        if program and not header.is_empty:
            header = header.add_program(program)
        return PairsTable(df, header)

    def with_header(self, header: Header) -> PairsTable:
        return replace(self, header=header)


def _check(paths: Sequence[str]) -> None:
    for p in paths:
        if p.endswith(UNSUPPORTED):
            raise ValueError(f"not supported as text: {p}")


def lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(value, file, start, place): text lines with what orders them inside a file."""
    paths = [path] if isinstance(path, str) else list(path)
    _check(paths)
    out = spark.read.text(paths, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    if any(p.endswith((".gz", ".bgz")) for p in paths):
        out = out.repartition(spark.sparkContext.defaultParallelism)
    return out


def leading(spark: SparkSession, file: str, belongs: Callable[[str], bool], most: int = 1_000_000) -> list[str]:
    """The first lines of one file up to the first that doesn't belong; more than ``most`` raise. Reads from the file's start, a few lines more than there are."""
    n = 256
    while True:
        rows = [r["value"] for r in spark.read.text(file, lineSep="\n").limit(n).collect()]
        found = list(itertools.takewhile(belongs, rows))
        if len(found) > most:
            raise ValueError(f"more than {most} header lines: {file}")
        if len(found) < n:
            return found
        n = min(8 * n, most + 1)


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files of a path, by name."""
    return sorted(unquote(f) for f in spark.read.text(path).inputFiles())


def _is_header(line: str) -> bool:
    return line.startswith("#")


def read_header(spark: SparkSession, path: str, most: int = 1_000_000) -> Header:
    """The leading # lines of a file, or of a folder's first file that has any; more than ``most`` of them raise."""
    for file in _files(spark, path):
        if found := leading(spark, file, _is_header, most):
            return Header.parse(found)
    return Header(())


def without_headers(text: DataFrame, paths: Sequence[str], value: str = "value") -> DataFrame:
    """The lines of the files but for their header lines."""
    spark = text.sparkSession
    heads = sorted({line for p in paths for f in _files(spark, p) for line in leading(spark, f, _is_header)})
    if len(heads) <= 1000:
        return text.where(~(F.col(value).startswith("#") & F.col(value).isin(heads))) if heads else text
    table = F.broadcast(spark.createDataFrame([(h,) for h in heads], "h_ string"))  # as many as ``leading`` lets through
    return text.join(table, F.col(value) == F.col("h_"), "left_anti")


def body(text: DataFrame, columns: Sequence[str], types: Mapping[str, str] | None = None, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Typed columns of tab-separated lines."""
    parts = F.split(F.col(value), "\t", -1)
    cols = []
    for i, c in enumerate(columns):
        kind = (types or {}).get(c) or column_type(c).simpleString()
        cols.append(F.get(parts, F.lit(i)).try_cast(kind).alias(c))
    return text.where(F.col(value) != "").select(*cols, *keep)


def read_pairs(spark: SparkSession, path: str, columns: Sequence[str] | None = None, types: Mapping[str, str] | None = None, ordinal: str | None = None, cmd_in: str | None = None) -> PairsTable:
    """A pairs or pairsam file. Without a column line the standard columns are taken; ``ordinal`` adds a column that follows the file's order."""
    if cmd_in is not None:
        raise ValueError("shell commands are not supported; use a codec that Spark reads")
    header = read_header(spark, path)
    names = list(columns or header.columns or PAIRS)
    text = without_headers(lines(spark, path), [path])
    keep = []
    if ordinal:
        keep = [F.struct("file", "start", "place").alias(ordinal)]
    return PairsTable(body(text, names, types, keep=keep), header)


def line_of(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A row as a tab-separated line; nulls as empty fields."""
    return F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns or df.columns])


def write_pairs(table: PairsTable, path: str, compression: str | None = None, single: bool = False) -> None:
    """Part files in the table's order and, beside them, a file ``_header``; ``single`` makes one file with the header inside.

    A single file is written by one task, as its format demands; part files are written by all.
    """
    spark = table.df.sparkSession
    options = {"compression": compression} if compression else {}
    out = table.df.select(line_of(table.df).alias("value"))
    head = spark.createDataFrame([(line,) for line in table.header.lines], "value string")
    if single:
        marked = head.select(F.lit(0).alias("k"), F.monotonically_increasing_id().alias("i"), "value").unionByName(out.select(F.lit(1).alias("k"), F.monotonically_increasing_id().alias("i"), "value"))
        marked.repartition(1).sortWithinPartitions("k", "i").select("value").write.mode("error").text(path, **options)
        return
    out.write.mode("error").text(path, **options)
    head.coalesce(1).write.mode("error").text(f"{path}/_header")


def read_parts(spark: SparkSession, path: str, types: Mapping[str, str] | None = None) -> PairsTable:
    """What write_pairs wrote as part files."""
    header = Header.parse(r["value"] for r in spark.read.text(f"{path}/_header").collect())
    return PairsTable(body(lines(spark, path), header.columns or PAIRS, types), header)


def write_routes(routed: DataFrame, header: Header, paths: Mapping[str, str]) -> None:
    """Each route to its path; routes with one path go there together, routes without one are dropped."""
    by_path: dict[str, list[str]] = {}
    for route, path in paths.items():
        by_path.setdefault(path, []).append(route)
    for path, routes in by_path.items():
        part = routed.where(F.col("route").isin(routes)).drop("route")
        write_pairs(PairsTable(part, header.with_columns(part.columns)), path)


# -- small tables


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end) of a tab-separated file without header; # lines are comments."""
    return spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start long, `end` long")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end) of a tab-separated file with a header line."""
    return spark.read.csv(path, sep="\t", header=True).select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def read_chromsizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Name -> size in the file's order. One row per chromosome; the file is read whole on the driver."""
    rows = spark.read.text(path).collect()
    out = {}
    for r in rows:
        fields = r["value"].split()
        if len(fields) >= 2:
            out[fields[0]] = int(fields[1])
    return out


def chrom_order(sizes: Iterable[str], others: Iterable[str] = ()) -> dict[str, int]:
    """Rank of each name: listed ones first, in their order, then the others by name; the unmapped marker ranks 0."""
    listed = [c for c in sizes if c != "!"]
    return {c: i for i, c in enumerate(["!", *listed, *sorted(set(others) - set(listed) - {"!"})])}


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a statistics file."""
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
    return spark.read.csv(path, sep="\t", schema=schema)


def render_stats(tree: Mapping) -> str:
    """Nested statistics as lines of key and value."""
    from ..operators.stats import flatten

    return "".join(f"{k}\t{v}\n" for k, v in flatten(tree))


def render_yaml(tree: Mapping, depth: int = 0) -> str:
    """Nested statistics as YAML."""
    out = []
    for k, v in tree.items():
        key = f"'{k}'" if not str(k).replace("_", "").isalnum() or str(k)[0].isdigit() else str(k)
        if isinstance(v, Mapping):
            out.append("  " * depth + f"{key}:" + (" {}\n" if not v else "\n" + render_yaml(v, depth + 1)))
        else:
            out.append("  " * depth + f"{key}: {'null' if v is None else v}\n")
    return "".join(out)


def parse_yaml(text: str) -> dict:
    """What render_yaml writes."""
    root: dict = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        if not line.strip():
            continue
        depth = (len(line) - len(line.lstrip())) // 2
        key, _, value = line.strip().partition(": ") if ": " in line else (line.strip().rstrip(":"), "", "")
        key = key.strip("'")
        while stack[-1][0] >= depth:
            stack.pop()
        if value in ("", "{}"):
            child: dict = {}
            stack[-1][1][key] = child
            stack.append((depth, child))
        else:
            stack[-1][1][key] = _scalar(value)
    return root


def _scalar(text: str):
    if text == "null":
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text
