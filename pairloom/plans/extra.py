"""Queries on alignments, files and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, molecules, order, walks
from ..sources import text as files
from ..sources.header import Header
from ..streaming import pairs as streams
from . import walk_sql
from .catalog import MAPPED, PAIRS_SQL, P, pairs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CHROMS = [f"chr{i}" for i in range(1, 6)]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# -- alignments

#: two records per order: 50 bases, the first ten clipped on one side at times, unmapped and weak ones among them
RECORDS_SQL = """SELECT o_orderkey AS k, CAST(s AS INTEGER) AS side, CASE WHEN s = 1 THEN 64 ELSE 128 END + CASE WHEN (o_orderkey + s) % 3 = 0 THEN 16 ELSE 0 END + CASE WHEN (o_custkey + s) % 11 = 0 THEN 4 ELSE 0 END AS flag,
  concat('chr', CAST((o_custkey * s + o_orderkey) % 5 + 1 AS VARCHAR(20))) AS rname, (o_custkey * 7 + o_orderkey * s) % 5000 + 1 AS pos, (o_orderkey + o_custkey * s) % 61 AS mapq,
  CASE WHEN (o_custkey + s) % 11 = 0 THEN '*' WHEN o_custkey % 4 = 0 THEN '10S40M' WHEN o_custkey % 4 = 1 THEN '20M2D10M3I17M' ELSE '50M' END AS cigar
FROM orders, (SELECT 1 AS s UNION ALL SELECT 2 AS s) t"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    r = spark.sql(RECORDS_SQL.replace("FROM orders,", "FROM {orders} o,"), orders=orders)
    return _as_records(r.withColumn("n", F.col("k") * 2 + F.col("side")))


def _as_records(r: DataFrame) -> DataFrame:
    name = F.concat(F.lit("r"), F.col("k").cast("string"))
    r = r.select(name.alias("qname"), F.col("flag").cast("int").alias("flag"), "rname", F.col("pos").cast("long").alias("pos"), F.col("mapq").cast("int").alias("mapq"), "cigar", F.lit("*").alias("seq"), F.lit("*").alias("qual"), F.array().cast("array<string>").alias("tags"), F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("n")).alias("place"))
    return r.withColumn("record", F.concat_ws("\t", "qname", F.col("flag").cast("string"), "rname", F.col("pos").cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*\t0\t0\t*\t*")))


def _walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One molecule per order: its lines are alignments, one to four a side."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    part = F.floor((F.col("l_linenumber") - 1) / 2).cast("int") * 20
    mapped = F.col("l_linenumber") * 7 % 13 != F.col("l_partkey") % 13
    r = li.select(
        F.col("l_orderkey").alias("k"),
        (F.when(F.col("l_linenumber") % 2 == 1, 64).otherwise(128) + F.when(F.col("l_returnflag") == "R", 16).otherwise(0) + F.when(mapped, 0).otherwise(4)).alias("flag"),
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 2 + 1).cast("string")).alias("rname"),
        (F.col("l_partkey") % 400 + 1).alias("pos"),
        F.floor("l_quantity").alias("mapq"),
        F.when(mapped, F.concat(part.cast("string"), F.lit("S20M"), (60 - part).cast("string"), F.lit("S"))).otherwise("*").alias("cigar"),
        (F.col("l_linenumber") * 10_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("n"),
    )
    return _as_records(r.withColumn("cigar", F.regexp_replace("cigar", "^0S|(?<=M)0S$", "")))


_bases = lambda ops: f"CAST(coalesce(list_sum([CAST(regexp_extract(x, '[0-9]+') AS BIGINT) FOR x IN regexp_extract_all(cigar, '[0-9]+[{ops}]')]), 0) AS BIGINT)"
_clip5 = "coalesce(TRY_CAST(regexp_extract(cigar, '^([0-9]+)[SH]', 1) AS BIGINT), 0)"
CIGAR_SQL = f"SELECT concat('r', CAST(k AS VARCHAR)) AS readID, side, {_bases('M')} AS matched_bp, {_bases('MD')} AS algn_ref_span, {_bases('MI')} AS algn_read_span, {_bases('MISH')} AS read_len, {_clip5} AS clip5_ref FROM ({RECORDS_SQL}) r"


@query("cigar_metrics", CIGAR_SQL)
def _cigar(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _records(spark, sf_dir).withColumn("m", molecules.cigar_metrics(F.col("cigar")))
    return m.select(F.col("qname").alias("readID"), F.when(F.col("flag").bitwiseAND(F.lit(64)) != 0, 1).otherwise(2).alias("side"), *[F.col(f"m.{c}").cast("long").alias(c) for c in ("matched_bp", "algn_ref_span", "algn_read_span", "read_len", "clip5_ref")])


_A = f"""a AS (SELECT concat('r', CAST(k AS VARCHAR)) AS readID, side, (flag & 4) = 0 AS mapped, (flag & 4) = 0 AND mapq >= 1 AS uniq, (flag & 16) <> 0 AS minus, rname, pos, {_bases('MD')} AS span FROM ({RECORDS_SQL}) r),
e AS (SELECT readID, side, mapped, uniq, CASE WHEN uniq THEN rname ELSE '!' END AS chrom, CASE WHEN NOT uniq THEN 0 WHEN minus THEN pos + span - 1 ELSE pos END AS p, CASE WHEN NOT uniq OR minus THEN '-' ELSE '+' END AS strand,
  CASE WHEN NOT mapped THEN 'N' WHEN NOT uniq THEN 'M' ELSE 'U' END AS t, CASE WHEN uniq THEN CAST(right(rname, 1) AS INTEGER) ELSE 0 END AS rank FROM a),
j AS (SELECT x.*, y.chrom AS chrom_b, y.p AS p_b, y.strand AS strand_b, y.t AS t_b,
  CASE WHEN x.uniq AND y.uniq THEN (x.rank, x.p) > (y.rank, y.p) ELSE (CAST(x.mapped AS INTEGER), CAST(x.uniq AS INTEGER)) > (CAST(y.mapped AS INTEGER), CAST(y.uniq AS INTEGER)) END AS w FROM e x JOIN e y ON x.readID = y.readID AND x.side = 1 AND y.side = 2)"""
query("parse_pairs", f"""WITH {_A} SELECT readID, CASE WHEN w THEN chrom_b ELSE chrom END AS chrom1, CASE WHEN w THEN p_b ELSE p END AS pos1, CASE WHEN w THEN chrom ELSE chrom_b END AS chrom2, CASE WHEN w THEN p ELSE p_b END AS pos2,
CASE WHEN w THEN strand_b ELSE strand END AS strand1, CASE WHEN w THEN strand ELSE strand_b END AS strand2, CASE WHEN w THEN t_b || t ELSE t || t_b END AS pair_type FROM j""")(lambda spark, d: molecules.parse(_records(spark, d), CHROMS, drop_sam=True))
for policy in walks.POLICIES:
    query(f"walk_policy_{policy}", walk_sql.policy(policy))(lambda spark, d, policy=policy: molecules.parse(_walks(spark, d), CHROMS, walks_policy=policy, min_mapq=10, drop_sam=True, add_pair_index=True))
query("walk_rescue", f"SELECT * FROM ({walk_sql.policy('mask')}) WHERE contains(pair_type, 'R')")(lambda spark, d: molecules.parse(_walks(spark, d), CHROMS, walks_policy="mask", min_mapq=10, drop_sam=True, add_pair_index=True).where("pair_type like '%R%'"))
query("walk_expand", walk_sql.every(walk_sql.OUTER, walk_sql.OUTER, 2))(lambda spark, d: molecules.parse(_walks(spark, d), CHROMS, mode="parse2", flip=False, min_mapq=10, drop_sam=True, add_pair_index=True, expanded=True, depth=2))
query("walk_junction", walk_sql.every(walk_sql.JUNCTION, walk_sql.JUNCTION))(lambda spark, d: molecules.parse(_walks(spark, d), CHROMS, mode="parse2", flip=False, min_mapq=10, drop_sam=True, add_pair_index=True, position="junction", orientation="junction"))
query("parse_gaps", walk_sql.GAPS)(lambda spark, d: molecules.parse(_walks(spark, d), CHROMS, walks_policy="5any", min_mapq=10, drop_sam=True, add_columns=["algn_idx", "same_side_algn_count", "dist_to_5"]))
query("parsed_alignments", walk_sql.LINES)(lambda spark, d: molecules.parsed_alignments(_walks(spark, d)))


# -- files


def _folder(spark: SparkSession) -> str:
    graph.cut(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


@query("scan_pairs", f"{P} SELECT * FROM pairs")
def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pairs(spark, sf_dir)
    path = _folder(spark)
    files.write_pairs(files.PairsTable(df, Header.standard(columns=df.columns)), path)
    return files.read_parts(spark, path, {"mapq1": "bigint", "mapq2": "bigint"}).df


@query("scan_routes", f"{P} SELECT *, CASE WHEN {MAPPED} THEN 'main' ELSE 'unmapped' END AS route FROM pairs")
def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both routes, each written to a path of its own and read from there."""
    df = pairs(spark, sf_dir)
    paths = {"main": _folder(spark), "unmapped": _folder(spark)}
    routed = df.withColumn("route", F.when((F.col("chrom1") == "!") | (F.col("chrom2") == "!"), "unmapped").otherwise("main"))
    files.write_routes(routed, Header.standard(columns=df.columns), paths)
    one, two = (files.read_parts(spark, path, {"mapq1": "bigint", "mapq2": "bigint"}).df.withColumn("route", F.lit(route)) for route, path in paths.items())
    return one.unionByName(two)


def _sorted_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs, sorted, through gzip files, one for each range of the order: a task writes and reads a range alone. One after another they are one sorted gzip file."""
    df = order.sort_pairs(pairs(spark, sf_dir), ordinal="readID")
    path = _folder(spark)
    files.write_pairs(files.PairsTable(df, Header.standard(columns=df.columns).mark_sorted()), path, compression="gzip")
    return files.read_parts(spark, path, {"mapq1": "bigint", "mapq2": "bigint"}).df


query("sort_gzip", f"{P} SELECT * FROM pairs")(_sorted_gzip)


# -- streams


def _pair_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = streams.read_stream(spark, f"{sf_dir}/lineitem.parquet")
    return spark.sql(PAIRS_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lineitem)


query("stream_select", f"{P} SELECT * FROM pairs WHERE pair_type = 'UU' AND chrom1 = chrom2")(lambda spark, d: streams.run(_pair_stream(spark, d).where("pair_type = 'UU' and chrom1 = chrom2")))
query("stream_dedup", f"{P} SELECT DISTINCT chrom1, chrom2, pos1, pos2, strand1, strand2 FROM pairs WHERE {MAPPED}")(lambda spark, d: streams.run(streams.drop_duplicates(_pair_stream(spark, d)).select(*streams.EXACT)))
query("stream_totals", f"{P} SELECT count(*) AS total, count(*) FILTER ({MAPPED}) AS total_mapped FROM pairs")(lambda spark, d: streams.run(streams.running_totals(_pair_stream(spark, d)), "complete").select("total", "total_mapped"))
query("stream_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")(
    lambda spark, d: streams.run(streams.windowed_counts(streams.read_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"], "365 days"), "complete").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
)
