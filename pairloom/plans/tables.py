"""Queries on the small files beside pair tables, on sinks, and on columns of parsed pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, molecules, rows, scaling, stats
from ..sources import sam
from ..sources import text as files
from ..sources.header import Header
from . import extra, walk_sql
from .catalog import FRAGMENTS_SQL, LONG_SQL, PS, REGIONS, REGIONS_SQL, SCALE_SQL, SIZES, P, _dedup_sql, _fragments, pairs, pairsam

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


# -- small files


@query("scan_bed", f"SELECT chrom, CAST(0 AS BIGINT) AS start, CAST(\"end\" AS BIGINT) AS \"end\" FROM ({FRAGMENTS_SQL})")
def _bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = extra._folder(spark)
    _fragments(spark, sf_dir).select("chrom", "start", "end").write.csv(path, sep="\t")
    return files.read_bed(spark, path)


@query("scan_regions", f"SELECT chrom, s AS start, e AS \"end\" FROM ({REGIONS_SQL})")
def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = extra._folder(spark)
    spark.createDataFrame(REGIONS, "chrom string, start long, end long").coalesce(1).write.csv(path, sep="\t", header=True)
    return files.read_regions(spark, path)


@query("scan_chromsizes", "SELECT concat('chr', p) AS chrom, CAST(max(p_partkey) AS BIGINT) AS size, CAST(row_number() OVER (ORDER BY p DESC) AS INTEGER) AS place FROM (SELECT p_partkey % 5 + 1 AS p, p_partkey FROM part) GROUP BY p")
def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and lengths in the file's order, here from the last name to the first, and that order as ranks."""
    path = extra._folder(spark)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy((F.col("p_partkey") % 5 + 1).alias("p")).agg(F.max("p_partkey").alias("n"))
    part.orderBy(F.desc("p")).coalesce(1).select(F.concat(F.lit("chr"), F.col("p").cast("string"), F.lit("\t"), F.col("n").cast("string")).alias("value")).write.text(path)
    sizes = files.read_chromsizes(spark, path)
    rank = files.chrom_order(sizes, ["chr1", "chr2"])
    return spark.createDataFrame([(c, n, rank[c]) for c, n in sizes.items()], "chrom string, size long, place int")


def _flat(spark: SparkSession, lines: str) -> DataFrame:
    path = extra._folder(spark)
    spark.createDataFrame([(line,) for line in lines.splitlines()], "value string").coalesce(1).write.text(path)
    return files.read_stats(spark, path)


TEXT_SQL = f"SELECT key, CAST(value AS VARCHAR) AS value FROM ({LONG_SQL})"


@query("stats_file", TEXT_SQL)
def _stats_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters written as a statistics file and read again."""
    tree = stats.nested(stats.long_table(pairs(spark, sf_dir)))
    return _flat(spark, files.render_stats(tree)).where("key not like 'summary/%'")


@query("stats_yaml", TEXT_SQL)
def _stats_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by way of YAML."""
    tree = files.parse_yaml(files.render_yaml(stats.nested(stats.long_table(pairs(spark, sf_dir)))))
    return stats.as_table(spark, tree).where("key not like 'summary/%'")


@query("stats_lookup", f"SELECT key, value FROM ({LONG_SQL}) WHERE key IN ('total', 'pair_types/UU', 'chrom_freq/chr1/chr2')")
def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = stats.nested(stats.long_table(pairs(spark, sf_dir)))
    return spark.createDataFrame([(k, stats.lookup(tree, k)) for k in ("total", "pair_types/UU", "chrom_freq/chr1/chr2")], "key string, value long")


# -- sinks


@query("sam_sink", f"""{PS}, s AS (SELECT sam1 AS sam FROM pairsam UNION ALL SELECT sam2 FROM pairsam), r AS (SELECT unnest(string_split(sam, concat(chr(25), 'NEXT_SAM', chr(25)))) AS x FROM s WHERE sam <> '.')
SELECT split_part(x, chr(25), 1) AS qname, CAST(split_part(x, chr(25), 2) AS INTEGER) AS flag, split_part(x, chr(25), 3) AS rname, CAST(split_part(x, chr(25), 4) AS BIGINT) AS pos, CAST(split_part(x, chr(25), 5) AS INTEGER) AS mapq, split_part(x, chr(25), 6) AS cigar,
array_to_string(string_split(x, chr(25))[12:], ' ') AS tags FROM r""")
def _sam_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAM columns split off, written as SAM text and scanned again."""
    path = extra._folder(spark)
    sam.write_sam(rows.split_sam(pairsam(spark, sf_dir)), path)
    return sam.read_sam(spark, path).select("qname", "flag", "rname", "pos", "mapq", "cigar", F.array_join("tags", " ").alias("tags"))


@query("parsed_alignments_sink", f"SELECT line FROM ({walk_sql.LINES})")
def _alignments_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = extra._folder(spark)
    molecules.parsed_alignments(extra._walks(spark, sf_dir)).select("line").write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("scaling_sink", f"{SCALE_SQL} SELECT * FROM sc")
def _scaling_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = extra._folder(spark)
    scaling.cis_scaling(pairs(spark, sf_dir), chromsizes=SIZES).write.csv(path, sep="\t", header=True)
    kinds = "chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long, strand1 string, strand2 string, min_dist long, max_dist long, n_pairs long, n_bp2 double"
    return spark.read.csv(path, sep="\t", header=True, schema=kinds)


_TILES = _dedup_sql("max").split("SELECT p.readID, CASE")[0] + """, t AS (SELECT least(a, b) AS tile, greatest(a, b) AS parent_tile, count(*) AS n FROM (
  SELECT array_to_string(string_split(p.readID, ':')[3:5], ':') AS a, array_to_string(string_split(f.readID, ':')[3:5], ':') AS b FROM pairs p JOIN head h USING (readID) JOIN m f ON f.o = h.h WHERE h.o <> h.h) GROUP BY ALL)"""


@query("bytile_sink", f"{_TILES} SELECT tile, parent_tile, n AS dup_count FROM t")
def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = extra._folder(spark)
    stats.bytile_duplicates(dedup.deduplicate(pairs(spark, sf_dir)).where("route = 'dups'")).write.csv(path, sep="\t", header=True)
    return spark.read.csv(path, sep="\t", header=True, schema="tile string, parent_tile string, dup_count long")


query("bytile_optical", f"{_TILES} SELECT count(*) AS n_tile_pairs, CAST(round(median(n) * count(*)) AS BIGINT) AS dups_by_tile_median FROM t")(
    lambda spark, d: stats.optical_from_tiles(stats.bytile_duplicates(dedup.deduplicate(pairs(spark, d)).where("route = 'dups'")))
)

# counters of a table whose duplicates have just been marked
_MARKED = _dedup_sql("max").split("SELECT p.readID, CASE")[0] + ", r AS (SELECT p.*, h.o IS NOT NULL AS mapped, h.o <> h.h AS dup FROM pairs p LEFT JOIN head h USING (readID))"
query("dedup_stats", f"""{_MARKED} SELECT count(*) AS total, count(*) FILTER (mapped) AS total_mapped, count(*) FILTER (mapped AND (dup OR pair_type = 'DD')) AS total_dups, count(*) FILTER (mapped AND NOT dup AND pair_type <> 'DD') AS total_nodups,
count(*) FILTER (mapped AND NOT dup AND pair_type <> 'DD' AND chrom1 = chrom2) AS cis FROM r""")(lambda spark, d: stats.totals(dedup.marked(dedup.deduplicate(pairs(spark, d)))).select("total", "total_mapped", "total_dups", "total_nodups", "cis"))


# -- headers and columns


@query("set_columns", f"{P} SELECT readID AS name, chrom1 AS c1, pos1 AS p1, chrom2, pos2, strand1, strand2, pair_type, mapq1, mapq2, CAST(mapq1 + mapq2 AS BIGINT) AS both FROM pairs")
def _set_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns renamed and one appended in the header; the file is read by the names that it gives."""
    df = pairs(spark, sf_dir)
    head = Header.standard(columns=df.columns).with_columns(["name", "c1", "p1", *df.columns[3:]]).append_columns(["both"])
    path = extra._folder(spark)
    files.write_pairs(files.PairsTable(df.withColumn("both", F.col("mapq1") + F.col("mapq2")).toDF(*head.columns), head), path)
    return files.read_parts(spark, path, {c: "bigint" for c in ("p1", "mapq1", "mapq2", "both")}).df


_PARSED = ("mapq", "cigar", "read_len", "matched_bp", "algn_ref_span", "algn_read_span")
_side = lambda c, i: f"CASE WHEN w THEN {c}_{'b' if i == 1 else 'a'} ELSE {c}_{'a' if i == 1 else 'b'} END"


def _columns_sql() -> str:
    b = extra._bases
    values = {"mapq": "CAST(mapq AS BIGINT)", "cigar": "cigar", "read_len": b("MISH"), "matched_bp": b("M"), "algn_ref_span": b("MD"), "algn_read_span": b("MI")}
    own = ", ".join(f"{v} AS {c}" for c, v in values.items())
    both = ", ".join(f"x.{c} AS {c}_a, y.{c} AS {c}_b" for c in _PARSED)
    out = ", ".join(f"{_side(c, i)} AS {c}{i}" for c in _PARSED for i in (1, 2))
    return f"""WITH {extra._A}, v AS (SELECT concat('r', CAST(k AS VARCHAR)) AS readID, side, {own} FROM ({extra.RECORDS_SQL}) r), c AS (SELECT x.readID, {both} FROM v x JOIN v y ON x.readID = y.readID AND x.side = 1 AND y.side = 2)
SELECT '.' AS readID, CASE WHEN w THEN chrom_b ELSE chrom END AS chrom1, CASE WHEN w THEN p_b ELSE p END AS pos1, CAST(1 AS INTEGER) AS walk_pair_index, 'R1-2' AS walk_pair_type, {out} FROM j JOIN c USING (readID)"""


query("parse_columns", _columns_sql())(
    lambda spark, d: molecules.parse(extra._records(spark, d), extra.CHROMS, drop_sam=True, drop_readid=True, add_pair_index=True, add_columns=list(_PARSED)).drop("chrom2", "pos2", "strand1", "strand2", "pair_type")
)
#: SAM columns of parsed pairs without sequences, and their fields
query("parse_sam_columns", f"""WITH {extra._A}, s AS (SELECT concat('r', CAST(k AS VARCHAR)) AS readID, side, concat_ws(chr(25), concat('r', k), flag, rname, pos, mapq, cigar, '*', '0', '0', '*', '*') AS sam FROM ({extra.RECORDS_SQL}) r)
SELECT j.readID, concat(CASE WHEN w THEN b.sam ELSE a.sam END, chr(25), 'Yt:Z:', CASE WHEN w THEN t_b || t ELSE t || t_b END) AS sam1, concat(CASE WHEN w THEN a.sam ELSE b.sam END, chr(25), 'Yt:Z:', CASE WHEN w THEN t_b || t ELSE t || t_b END) AS sam2
FROM j JOIN s a ON a.readID = j.readID AND a.side = 1 JOIN s b ON b.readID = j.readID AND b.side = 2""")(lambda spark, d: molecules.parse(extra._records(spark, d), extra.CHROMS, drop_seq=True).select("readID", "sam1", "sam2"))


def _with_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of 50 bases with one that differs from the reference, as the MD tag tells."""
    r = extra._records(spark, sf_dir).where("cigar = '50M'")
    at = F.expr("cast(substring(qname, 2) as bigint) % 50").cast("int")
    return r.withColumns({"seq": F.repeat(F.lit("ACGCG"), 10), "qual": F.repeat(F.lit("I"), 50), "tags": F.array(F.concat(F.lit("MD:Z:"), at.cast("string"), F.lit("T"), (49 - at).cast("string")))})


query("alignment_mismatches", f"""SELECT concat('r', CAST(k AS VARCHAR)) AS readID, side, concat('T:', substr(repeat('ACGCG', 10), CAST(k % 50 AS INTEGER) + 1, 1), ':40:', pos - 1 + k % 50, ':', k % 50) AS mismatches
FROM ({extra.RECORDS_SQL}) r WHERE cigar = '50M' AND (flag & 4) = 0 AND mapq >= 1""")(
    lambda spark, d: molecules.alignments(_with_mismatch(spark, d), mismatches=True).where("algn.is_unique").select("readID", "side", "algn.mismatches")
)

# areas between any two regions of a chromosome at distances of 100 to 1000
_part = lambda a, b: f"((pow(greatest(greatest({b} - {a}, 0) - 100, 0)::DOUBLE, 2) - pow(greatest(greatest({b} - {a}, 0) - 1000, 0)::DOUBLE, 2)) / 2)"


@query("scaling_area_between", f"SELECT x.i AS one, y.i AS two, {_part('x.s', 'y.e')} - {_part('x.s', 'y.s')} - {_part('x.e', 'y.e')} + {_part('x.e', 'y.s')} AS area FROM ({REGIONS_SQL}) x JOIN ({REGIONS_SQL}) y ON x.chrom = y.chrom AND x.i < y.i")
def _between(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = spark.createDataFrame([(i, *r) for i, r in enumerate(REGIONS)], "i long, chrom string, s long, e long")
    both = view.alias("x").join(view.alias("y"), (F.col("x.chrom") == F.col("y.chrom")) & (F.col("x.i") < F.col("y.i")))
    return both.select(F.col("x.i").alias("one"), F.col("y.i").alias("two"), scaling.area_between(F.lit(100), F.lit(1000), F.col("x.s"), F.col("x.e"), F.col("y.s"), F.col("y.e")).alias("area"))
