"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conditions as C
from ..operators import coverage, dedup, intervals, order, phase, rows, scaling, stats
from .views import PAIRS_SQL, PAIRSAM_SQL, PHASED_SQL, pairs, pairsam, phased

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

P = f"WITH pairs AS ({PAIRS_SQL})"
PS = f"WITH pairsam AS ({PAIRSAM_SQL})"
PH = f"WITH phased AS ({PHASED_SQL})"
MAPPED = "chrom1 <> '!' AND chrom2 <> '!'"
CLOSE = '(pair_type == "UU") and (chrom1 == chrom2) and (abs(pos1 - pos2) >= 100)'


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def simple(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None, view: Callable = pairs) -> None:
    query(name, sql)(lambda spark, sf_dir: f(view(spark, sf_dir)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = C.select(pairs(spark, sf_dir), CLOSE)
    return stats.chrom_freq(picked).drop("filter")


query("flagship", f"{P} SELECT chrom1, chrom2, count(*) AS n FROM pairs WHERE {MAPPED} AND pair_type = 'UU' AND chrom1 = chrom2 AND abs(pos1 - pos2) >= 100 GROUP BY ALL")(flagship)

# projection
simple("project_remove_columns", lambda d: rows.remove_columns(d, ["mapq1", "mapq2", "nothing"]), f"{P} SELECT readID, chrom1, pos1, chrom2, pos2, strand1, strand2, pair_type FROM pairs")
simple("project_type_cast", lambda d: rows.cast_columns(d, {"mapq1": "int", "pos1": "string"}).select("readID", "mapq1", "pos1"), f"{P} SELECT readID, CAST(mapq1 AS INTEGER) AS mapq1, CAST(pos1 AS VARCHAR) AS pos1 FROM pairs")
simple("split_pairs", rows.split_pairs, f"{PS} SELECT * EXCLUDE (sam1, sam2) FROM pairsam", pairsam)

# filters
simple("filter_select_expr", lambda d: C.select(d, CLOSE), f"{P} SELECT * FROM pairs WHERE pair_type = 'UU' AND chrom1 = chrom2 AND abs(pos1 - pos2) >= 100")
simple("filter_output_rest", lambda d: C.split_by(d, CLOSE)[1], f"{P} SELECT * FROM pairs WHERE NOT (pair_type = 'UU' AND chrom1 = chrom2 AND abs(pos1 - pos2) >= 100)")
simple("filter_arithmetic", lambda d: C.select(d, "10 <= (pos1 + 2 * mapq1) % 100 < 50 and not (strand1 == strand2) or mapq1 in [3, 5] and 'U' in pair_type"), f"{P} SELECT * FROM pairs WHERE ((pos1 + 2 * mapq1) % 100 BETWEEN 10 AND 49 AND strand1 <> strand2) OR (mapq1 IN (3, 5) AND contains(pair_type, 'U'))")
simple("filter_cols_index", lambda d: C.select(d, "COLS[1] == COLS[3] and COLS[-1] == '3'"), f"{P} SELECT * FROM pairs WHERE chrom1 = chrom2 AND mapq2 = 3")
simple("filter_mapq", lambda d: C.select(d, "(mapq1 >= 30) and (mapq2 >= 3)"), f"{P} SELECT * FROM pairs WHERE mapq1 >= 30 AND mapq2 >= 3")
simple("pred_csv_match", lambda d: C.select(d, "csv_match(pair_type, 'RU,UR,DD')"), f"{P} SELECT * FROM pairs WHERE pair_type IN ('RU', 'UR', 'DD')")
simple("pred_wildcard", lambda d: C.select(d, "wildcard_match(readID, 'M:[01]:F?:2:*_7')"), f"{P} SELECT * FROM pairs WHERE readID GLOB 'M:[01]:F?:2:*_7'")
simple("pred_regex", lambda d: C.select(d, "regex_match(chrom1, 'chr[1-3]')"), f"{P} SELECT * FROM pairs WHERE regexp_full_match(chrom1, 'chr[1-3]')")
simple("pred_region", lambda d: C.select(d, "region_match(chrom1, pos1, 'chr2', 100, 900) and region_match(chrom2, pos2, 'chr3', 500)"), f"{P} SELECT * FROM pairs WHERE chrom1 = 'chr2' AND pos1 BETWEEN 100 AND 900 AND chrom2 = 'chr3' AND pos2 >= 500")
simple("filter_chrom_subset", lambda d: rows.chrom_subset(d, ["chr1", "chr4"]), f"{P} SELECT * FROM pairs WHERE chrom1 IN ('chr1', 'chr4') AND chrom2 IN ('chr1', 'chr4')")
for kind, test in (("both", MAPPED), ("one", "(chrom1 = '!') <> (chrom2 = '!')"), ("none", "chrom1 = '!' AND chrom2 = '!'")):
    simple("filter_mapped" if kind == "both" else f"filter_mapped_{kind}", lambda d, kind=kind: rows.filter_mapped(d, kind), f"{P} SELECT * FROM pairs WHERE {test}")

# row transforms
FLIP_ORDER = ["chr3", "chr1", "chr2"]
_wrong = """NOT CASE WHEN r1 IS NOT NULL AND r2 IS NOT NULL THEN r1 < r2 OR (r1 = r2 AND pos1 <= pos2) WHEN r1 IS NULL AND r2 IS NULL THEN chrom1 < chrom2 ELSE r1 IS NOT NULL END"""
_rank = lambda c: f"CASE {c} WHEN '!' THEN 0 WHEN 'chr3' THEN 1 WHEN 'chr1' THEN 2 WHEN 'chr2' THEN 3 END"
_swap = ", ".join(f"CASE WHEN w THEN {a} ELSE {b} END AS {b}" for n in ("chrom", "pos", "strand", "mapq") for a, b in ((f"{n}2", f"{n}1"), (f"{n}1", f"{n}2")))
simple("flip_triu", lambda d: rows.flip(d, FLIP_ORDER), f"""{P}, r AS (SELECT *, {_rank('chrom1')} AS r1, {_rank('chrom2')} AS r2 FROM pairs), t AS (SELECT *, {_wrong} AS w FROM r)
SELECT readID, {_swap}, CASE WHEN w THEN concat(pair_type[2], pair_type[1]) ELSE pair_type END AS pair_type FROM t""")
_mark = lambda c: f"""CASE WHEN {c} = '.' THEN '.' ELSE array_to_string(list_transform(string_split({c}, concat(chr(25), 'NEXT_SAM', chr(25))), lambda r: array_to_string(list_transform(string_split(r, chr(25)), lambda f, i: CASE WHEN i = 2 THEN CAST(CAST(f AS INTEGER) | 1024 AS VARCHAR) WHEN i >= 12 AND f LIKE 'Yt:Z:%' THEN 'Yt:Z:DD' ELSE f END), chr(25))), concat(chr(25), 'NEXT_SAM', chr(25))) END AS {c}"""
simple("markasdup", lambda d: rows.mark_duplicates(d).select("readID", "pair_type", "sam1", "sam2"), f"{PS} SELECT readID, 'DD' AS pair_type, {_mark('sam1')}, {_mark('sam2')} FROM pairsam", pairsam)
simple("split_sam", rows.split_sam, f"""{PS}, s AS (SELECT readID, 1 AS side, sam1 AS sam FROM pairsam UNION ALL SELECT readID, 2, sam2 FROM pairsam),
e AS (SELECT readID, side, string_split(sam, concat(chr(25), 'NEXT_SAM', chr(25))) AS x FROM s WHERE sam <> '.')
SELECT readID, side, CAST(i - 1 AS INTEGER) AS record, replace(x[i], chr(25), chr(9)) AS line FROM (SELECT readID, side, x, unnest(range(1, len(x) + 1)) AS i FROM e)""", pairsam)
simple("tile_extract", lambda d: d.select("readID", rows.tile(F.col("readID")).alias("tile")), f"{P} SELECT readID, array_to_string(string_split(readID, ':')[3:5], ':') AS tile FROM pairs")
simple("sample_hash", lambda d: rows.sample(d, 0.1, 7), f"{P} SELECT * FROM pairs WHERE CAST(concat('0x', substr(md5(concat(readID, chr(9), '7')), 1, 8)) AS UBIGINT) < {int(round(0.1 * 2**32))}")


def _phase_sql(mode: str) -> str:
    parts, outs = [], []
    for i in (1, 2):
        strip = lambda c: f"CASE WHEN suffix({c}, '_h1') OR suffix({c}, '_h2') THEN left({c}, length({c}) - 3) ELSE {c} END"
        ph = lambda c: f"CASE WHEN suffix({c}, '_h1') THEN '0' WHEN suffix({c}, '_h2') THEN '1' ELSE '!' END"
        hits = f"list_filter(string_split({mode}{i}, ';'), lambda h: h <> '')"
        alt = f"split_part({hits}[1], ',', 1)"
        a, x = f"CAST(AS{i} AS BIGINT)", f"CAST(XS{i} AS BIGINT)"
        if mode == "XB":
            own = f"CAST(split_part({hits}[2], ',', 5) AS BIGINT)"
            tie = f"len({hits}) >= 2 AND {own} = {x} AND {x} = {a}"
        else:
            own, first = f"CAST(split_part({hits}[2], ',', 4) AS BIGINT)", f"CAST(split_part({hits}[1], ',', 4) AS BIGINT)"
            tie = f"len({hits}) >= 2 AND {own} = {first} AND {first} = CAST(NM{i} AS BIGINT)"
        c = f"chrom{i}"
        homologue = f"({strip(c)}) = ({strip(alt)}) AND (({ph(c)}) || ({ph(alt)})) IN ('01', '10')"
        parts.append(f"""CASE WHEN {c} = '!' THEN '!' WHEN {a} > {x} THEN {ph(c)} WHEN len({hits}) = 0 THEN '!' WHEN {tie} THEN '!' WHEN {homologue} THEN '.' ELSE '!' END AS phase{i},
CASE WHEN {c} = '!' THEN '!' WHEN {a} > {x} THEN {strip(c)} WHEN len({hits}) = 0 THEN '!' WHEN {tie} THEN '!' WHEN {homologue} THEN {strip(c)} ELSE '!' END AS base{i}""")
        outs.append(f"base{i} AS chrom{i}, CASE WHEN base{i} = '!' THEN 0 ELSE pos{i} END AS pos{i}, CASE WHEN base{i} = '!' THEN '-' ELSE strand{i} END AS strand{i}")
    letters = "concat(" + ", ".join(f"CASE WHEN chrom{i} <> '!' AND base{i} = '!' THEN 'M' ELSE pair_type[{i}] END" for i in (1, 2)) + ") AS pair_type"
    return f"{PH}, t AS (SELECT *, {', '.join(parts)} FROM phased) SELECT readID, {', '.join(outs)}, {letters}, phase1, phase2 FROM t"


for mode in ("XB", "XA"):
    simple(f"phase_{mode.lower()}", lambda d, mode=mode: phase.phase(d, ("_h1", "_h2"), mode).select("readID", "chrom1", "pos1", "strand1", "chrom2", "pos2", "strand2", "pair_type", "phase1", "phase2"), _phase_sql(mode), phased)
simple("phase_clean_output", lambda d: phase.phase(d, ("_h1", "_h2"), "XB", clean=True), _phase_sql("XB"), phased)
simple("phase_scores", lambda d: phase.phase(d, ("_h1", "_h2"), "XA", report_scores=True, clean=True).select("readID", "M1_1", "M2_1", "M3_1"), f"""{PH}, t AS (SELECT *, list_filter(string_split(XA1, ';'), lambda h: h <> '') AS h FROM phased)
SELECT readID, CASE WHEN chrom1 = '!' THEN -1 ELSE CAST(NM1 AS BIGINT) END AS M1_1, CASE WHEN chrom1 = '!' OR len(h) = 0 THEN -1 ELSE CAST(split_part(h[1], ',', 4) AS BIGINT) END AS M2_1,
CASE WHEN chrom1 = '!' OR len(h) < 2 OR CAST(AS1 AS BIGINT) > CAST(XS1 AS BIGINT) THEN -1 ELSE CAST(split_part(h[2], ',', 4) AS BIGINT) END AS M3_1 FROM t""", phased)
simple("phase_suffix", lambda d: d.select("readID", *[c.alias(n) for c, n in zip(phase.chrom_phase(F.col("chrom1"), ("_h1", "_h2")), ("phase", "base"), strict=True)]), f"""{PH} SELECT readID, CASE WHEN suffix(chrom1, '_h1') THEN '0' WHEN suffix(chrom1, '_h2') THEN '1' ELSE '!' END AS phase,
CASE WHEN suffix(chrom1, '_h1') OR suffix(chrom1, '_h2') THEN left(chrom1, length(chrom1) - 3) ELSE chrom1 END AS base FROM phased""", phased)

# order
simple("sort_pairs", lambda d: order.sort_pairs(d, ordinal="readID"), f"{P} SELECT * FROM pairs")
simple("sort_custom_cols", lambda d: order.sort_pairs(d, c1="chrom2", c2=2, p1="pos2", p2=3, ordinal="readID"), f"{P} SELECT * FROM pairs")
simple("sort_extra_col", lambda d: order.sort_pairs(d, extra=["mapq1"], ordinal="readID"), f"{P} SELECT * FROM pairs")
simple("merge_sorted", lambda d: order.merge([d.where("mapq2 < 4"), d.where("mapq2 >= 4")]), f"{P} SELECT * FROM pairs")
simple("merge_concat", lambda d: order.concatenate([d.where("mapq2 < 4"), d.where("mapq2 >= 2")]), f"{P} SELECT * FROM pairs WHERE mapq2 < 4 UNION ALL SELECT * FROM pairs WHERE mapq2 >= 2")

# intervals
FRAGMENTS_SQL = "SELECT concat('chr', p_partkey % 4 + 1) AS chrom, p_partkey * 3 AS \"end\" FROM part"


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("chr"), (F.col("p_partkey") % 4 + 1).cast("string")).alias("chrom"), F.lit(0).alias("start"), (F.col("p_partkey") * 3).alias("end"))


def _restrict_sql() -> str:
    side = lambda i: f"""s{i} AS (SELECT p.readID, b.i, b.lo, b.hi FROM pairs p JOIN bounds b ON p.chrom{i} = b.chrom AND ((p.pos{i} >= b.lo AND p.pos{i} < b.hi) OR (b.last AND p.pos{i} >= b.hi)))"""
    return f"""{P}, f AS ({FRAGMENTS_SQL}), bounds AS (SELECT chrom, row_number() OVER w - 1 AS i, coalesce(lag("end") OVER w + 1, 0) AS lo, "end" + 1 AS hi, lead("end") OVER w IS NULL AS last FROM f WINDOW w AS (PARTITION BY chrom ORDER BY "end")),
{side(1)}, {side(2)}
SELECT p.readID, coalesce(s1.i, -1) AS rfrag1, coalesce(s1.lo, 0) AS rfrag_start1, coalesce(s1.hi, 0) AS rfrag_end1, coalesce(s2.i, -1) AS rfrag2, coalesce(s2.lo, 0) AS rfrag_start2, coalesce(s2.hi, 0) AS rfrag_end2
FROM pairs p LEFT JOIN s1 USING (readID) LEFT JOIN s2 USING (readID)"""


RFRAG = ["readID", "rfrag1", "rfrag_start1", "rfrag_end1", "rfrag2", "rfrag_start2", "rfrag_end2"]
query("restrict_annotate", _restrict_sql())(lambda spark, d: intervals.annotate_fragments(pairs(spark, d), _fragments(spark, d)).select(*RFRAG))
REGIONS = [("chr1", 0, 600), ("chr1", 600, 1500), ("chr2", 100, 1900), ("chr3", 0, 2500), ("chr5", 50, 60)]
REGIONS_SQL = "SELECT chrom, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, CAST(i AS BIGINT) AS i FROM (VALUES " + ", ".join(f"('{c}', {s}, {e}, {i})" for i, (c, s, e) in enumerate(REGIONS)) + ") v(chrom, s, e, i)"


def _region_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, "chrom string, start long, end long")


query("interval_join_regions", f"""{P}, v AS ({REGIONS_SQL}) SELECT p.readID, coalesce(a.i, -1) AS region1, a.s AS region_start1, a.e AS region_end1, coalesce(b.i, -1) AS region2, b.s AS region_start2, b.e AS region_end2
FROM pairs p LEFT JOIN v a ON p.chrom1 = a.chrom AND p.pos1 >= a.s AND p.pos1 < a.e LEFT JOIN v b ON p.chrom2 = b.chrom AND p.pos2 >= b.s AND p.pos2 < b.e""")(
    lambda spark, d: intervals.assign_regions(pairs(spark, d), _region_table(spark)).select("readID", "region1", "region_start1", "region_end1", "region2", "region_start2", "region_end2")
)

# coverage
# every pair by a number of its own, as names may repeat
_cov = lambda d: f"""WITH pairs AS (SELECT row_number() OVER () AS row, * FROM ({PAIRS_SQL})), e AS (SELECT row, 1 AS side, chrom1 AS c, pos1 AS p FROM pairs WHERE {MAPPED} UNION ALL SELECT row, 2, chrom2, pos2 FROM pairs WHERE {MAPPED}),
n AS (SELECT row, side, count(*) OVER (PARTITION BY c ORDER BY p RANGE BETWEEN {d} PRECEDING AND {d} FOLLOWING) - 1 AS n FROM e),
cov AS (SELECT row, max(n) FILTER (side = 1) AS cov1, max(n) FILTER (side = 2) AS cov2 FROM n GROUP BY row)"""  # noqa: E731
simple("filterbycov_counts", lambda d: coverage.coverage(d, 5), f"{_cov(5)} SELECT readID, cov1, cov2, greatest(cov1, cov2) + 1 AS coverage FROM cov JOIN pairs USING (row)")
simple("filterbycov_sum", lambda d: coverage.coverage(d, 2, method="sum"), f"{_cov(2)} SELECT readID, cov1, cov2, cov1 + cov2 + 1 AS coverage FROM cov JOIN pairs USING (row)")
simple("filterbycov_route", lambda d: coverage.filter_by_coverage(d, 90, 5).select("readID", "route"), f"{_cov(5)} SELECT p.readID, CASE WHEN cov1 IS NULL THEN 'unmapped' WHEN greatest(cov1, cov2) + 1 > 90 THEN 'high' ELSE 'low' END AS route FROM pairs p LEFT JOIN cov USING (row)")

# duplicates
_place = "row_number() OVER (ORDER BY chrom1, chrom2, pos1, pos2, pair_type, readID)"
_same = "a.chrom1 = b.chrom1 AND a.chrom2 = b.chrom2 AND a.strand1 = b.strand1 AND a.strand2 = b.strand2"
_near = {"max": "greatest(abs(a.pos1 - b.pos1), abs(a.pos2 - b.pos2)) <= 3", "sum": "abs(a.pos1 - b.pos1) + abs(a.pos2 - b.pos2) <= 3"}


def _dedup_sql(method: str, extra: str = "") -> str:
    return f"""WITH RECURSIVE pairs AS ({PAIRS_SQL}), m AS (SELECT *, {_place} AS o FROM pairs WHERE {MAPPED}),
e AS (SELECT a.o AS x, b.o AS y FROM m a JOIN m b ON {_same} {extra} AND {_near[method]} AND a.o <> b.o),
reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
low AS (SELECT x, min(y) AS h FROM reach GROUP BY x),
head AS (SELECT m.o, m.readID, least(m.o, coalesce(low.h, m.o)) AS h FROM m LEFT JOIN low ON low.x = m.o)
SELECT p.readID, CASE WHEN h.o <> h.h THEN f.readID END AS parent_readID, CASE WHEN h.o IS NULL THEN 'unmapped' WHEN h.o <> h.h THEN 'dups' ELSE 'nodups' END AS route
FROM pairs p LEFT JOIN head h USING (readID) LEFT JOIN m f ON f.o = h.h"""


ROUTED = ["readID", "parent_readID", "route"]
for method in ("max", "sum"):
    simple(f"dedup_transitive_{method}", lambda d, method=method: dedup.deduplicate(d, 3, method).select(*ROUTED), _dedup_sql(method))
simple("dedup_extra_cols", lambda d: dedup.deduplicate(d, 3, extra=["mapq2"]).select(*ROUTED), _dedup_sql("max", "AND a.mapq2 = b.mapq2"))
simple("dedup_exact", lambda d: dedup.deduplicate(d, 0).select(*ROUTED), f"""WITH pairs AS (SELECT row_number() OVER () AS row, * FROM ({PAIRS_SQL})),
m AS (SELECT row, first_value(row) OVER w AS f, first_value(readID) OVER w AS parent FROM pairs WHERE {MAPPED} WINDOW w AS (PARTITION BY chrom1, chrom2, strand1, strand2, pos1, pos2 ORDER BY pair_type, readID, row))
SELECT p.readID, CASE WHEN m.f <> p.row THEN m.parent END AS parent_readID, CASE WHEN m.f IS NULL THEN 'unmapped' WHEN m.f <> p.row THEN 'dups' ELSE 'nodups' END AS route FROM pairs p LEFT JOIN m USING (row)""")
simple("dedup_route", lambda d: dedup.marked(dedup.deduplicate(d)).groupBy("route", "pair_type").agg(F.count("*").alias("n")), _dedup_sql("max").replace("SELECT p.readID, CASE", "SELECT CASE WHEN h.o IS NULL THEN 'unmapped' WHEN h.o <> h.h THEN 'dups' ELSE 'nodups' END AS route, CASE WHEN h.o <> h.h THEN 'DD' ELSE p.pair_type END AS pair_type, count(*) AS n FROM pairs p LEFT JOIN head h USING (readID) GROUP BY ALL --").split(" --")[0])
ONLINE_SQL = f"""{_dedup_sql("max").split("SELECT p.readID, CASE")[0].rstrip()},
c AS (SELECT h, list({{o: o, p: pos1, q: pos2, id: m.readID}} ORDER BY o) AS x FROM head JOIN m USING (o) GROUP BY h),
g AS (SELECT h, x, 1 AS i, [x[1]] AS kept, [x[1]] AS parents FROM c UNION ALL
  SELECT h, x, i + 1, CASE WHEN len(f) = 0 THEN list_append(kept, x[i + 1]) ELSE kept END, list_append(parents, CASE WHEN len(f) = 0 THEN x[i + 1] ELSE f[1] END)
  FROM (SELECT *, list_filter(kept, lambda k: greatest(abs(k.p - x[i + 1].p), abs(k.q - x[i + 1].q)) <= 3) AS f FROM g WHERE i < len(x))),
w AS (SELECT unnest(x) AS y, unnest(parents) AS z FROM g WHERE i = len(x))
SELECT p.readID, CASE WHEN y.o <> z.o THEN z.id END AS parent_readID, CASE WHEN y IS NULL THEN 'unmapped' WHEN y.o <> z.o THEN 'dups' ELSE 'nodups' END AS route FROM pairs p LEFT JOIN w ON w.y.id = p.readID"""
simple("dedup_online", lambda d: dedup.deduplicate(d, 3, rule="greedy").select(*ROUTED), ONLINE_SQL)
simple("dedup_parent_id", lambda d: dedup.deduplicate(d).where("route = 'dups'").select("readID", "parent_readID"), _dedup_sql("max").replace("FROM pairs p LEFT JOIN head h USING (readID) LEFT JOIN m f ON f.o = h.h", "FROM pairs p JOIN head h USING (readID) JOIN m f ON f.o = h.h WHERE h.o <> h.h").replace(", CASE WHEN h.o IS NULL THEN 'unmapped' WHEN h.o <> h.h THEN 'dups' ELSE 'nodups' END AS route", ""))


def _edges(d: DataFrame) -> DataFrame:
    e = dedup.candidate_edges(dedup.mapped(d).withColumnRenamed("readID", "node"), dedup.match_keys())
    return e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


simple("dedup_candidate_edges", _edges, f"{P}, m AS (SELECT * FROM pairs WHERE {MAPPED}) SELECT a.readID AS a, b.readID AS b FROM m a JOIN m b ON {_same} AND {_near['max']} AND a.readID < b.readID")

# statistics
_flags = f"f AS (SELECT *, {MAPPED} AS mapped, pair_type = 'DD' AS dup, abs(pos2 - pos1) AS dist FROM pairs), t AS (SELECT *, mapped AND NOT dup AS nodup, mapped AND NOT dup AND chrom1 = chrom2 AS is_cis FROM f)"
_totals = f"""SELECT count(*) AS total, count(*) FILTER (chrom1 = '!' AND chrom2 = '!') AS total_unmapped, count(*) FILTER ((chrom1 = '!') <> (chrom2 = '!')) AS total_single_sided_mapped, count(*) FILTER (mapped) AS total_mapped,
count(*) FILTER (mapped AND dup) AS total_dups, count(*) FILTER (nodup) AS total_nodups, count(*) FILTER (is_cis) AS cis, count(*) FILTER (nodup AND NOT is_cis) AS trans, {', '.join(f'count(*) FILTER (is_cis AND dist >= {k}000) AS "cis_{k}kb+"' for k in stats.CIS_KB)} FROM t"""
ST = f"{P}, {_flags}"
simple("stats_totals", lambda d: stats.totals(d).select("total", "total_unmapped", "total_single_sided_mapped", "total_mapped"), f"{ST} SELECT total, total_unmapped, total_single_sided_mapped, total_mapped FROM ({_totals})")
simple("stats_dups", lambda d: stats.totals(d).select("total_dups", "total_nodups"), f"{ST} SELECT total_dups, total_nodups FROM ({_totals})")
simple("stats_pair_types", lambda d: stats.pair_types(d).drop("filter"), f"{P} SELECT pair_type, count(*) AS n FROM pairs GROUP BY ALL")
simple("stats_chrom_freq", lambda d: stats.chrom_freq(d).drop("filter"), f"{ST} SELECT chrom1, chrom2, count(*) AS n FROM t WHERE nodup GROUP BY ALL")
simple("stats_cis_trans", lambda d: stats.totals(d).select("cis", "trans"), f"{ST} SELECT cis, trans FROM ({_totals})")
_kb = [f"cis_{k}kb+" for k in stats.CIS_KB]
simple("stats_cis_thresholds", lambda d: stats.totals(d).select(*[F.col(f"`{c}`") for c in _kb]), f"{ST} SELECT {', '.join(chr(34) + c + chr(34) for c in _kb)} FROM ({_totals})")
_e = stats.distance_edges()
EDGES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({a}, {b if b is not None else 'NULL'})" for a, b in zip(_e, [*_e[1:], None], strict=True)) + ") b(lo, hi)"
HIST_SQL = f"""edges AS ({EDGES_SQL}), s AS (SELECT * FROM (VALUES ('++'), ('+-'), ('-+'), ('--')) s(strands)),
h AS (SELECT CAST(lo AS BIGINT) AS min_dist, CAST(hi AS BIGINT) AS max_dist, s.strands, count(t.readID) AS n FROM edges CROSS JOIN s LEFT JOIN t ON is_cis AND dist >= lo AND (hi IS NULL OR dist < hi) AND concat(strand1, strand2) = s.strands GROUP BY ALL)"""
simple("stats_dist_freq", lambda d: stats.dist_freq(d).drop("filter"), f"{ST}, {HIST_SQL} SELECT * FROM h")
FILTERS = {"far": "abs(pos1 - pos2) > 500", "good": "mapq1 > 20"}
simple("stats_named_filters", lambda d: stats.totals(d, FILTERS).select("filter", "total", "total_mapped", "total_nodups", "cis"), f"""{P}, tags AS (SELECT 'no_filter' AS filter, * FROM pairs UNION ALL SELECT 'far', * FROM pairs WHERE abs(pos1 - pos2) > 500 UNION ALL SELECT 'good', * FROM pairs WHERE mapq1 > 20)
SELECT filter, count(*) AS total, count(*) FILTER ({MAPPED}) AS total_mapped, count(*) FILTER ({MAPPED} AND pair_type <> 'DD') AS total_nodups, count(*) FILTER ({MAPPED} AND pair_type <> 'DD' AND chrom1 = chrom2) AS cis FROM tags GROUP BY filter""")
_fracs = ["cis", *_kb]
simple("stats_summary", lambda d: stats.summary(stats.totals(d)).select(*[F.round(f"`frac_{c}`", 9).alias(f"frac_{c}") for c in _fracs], F.round("frac_dups", 9).alias("frac_dups")), f"{ST} SELECT {', '.join(f'round({chr(34)}{c}{chr(34)} / total_nodups, 9) AS {chr(34)}frac_{c}{chr(34)}' for c in _fracs)}, round(total_dups / total_mapped, 9) AS frac_dups FROM ({_totals})")
LONG_SQL = f"""{ST}, {HIST_SQL}, tt AS ({_totals}) SELECT key, CAST(value AS BIGINT) AS value FROM (UNPIVOT tt ON * INTO NAME key VALUE value)
UNION ALL SELECT 'pair_types/' || pair_type, count(*) FROM pairs GROUP BY 1 UNION ALL SELECT 'chrom_freq/' || chrom1 || '/' || chrom2, count(*) FROM t WHERE nodup GROUP BY 1
UNION ALL SELECT 'dist_freq/' || CASE WHEN max_dist IS NULL THEN min_dist || '+' ELSE min_dist || '-' || max_dist END || '/' || strands, n FROM h"""
simple("stats_flatten_long", lambda d: stats.long_table(d).drop("filter"), LONG_SQL)
simple("stats_merge", lambda d: stats.merge([stats.long_table(d.where("mapq2 < 3")), stats.long_table(d.where("mapq2 >= 3"))]).drop("filter"), LONG_SQL)
simple("library_complexity", lambda d: stats.summary(stats.totals(d)).select(F.round("complexity_naive", 2).alias("complexity")), f"""{ST}, c AS (SELECT total_mapped AS n, total_dups AS d FROM ({_totals})) SELECT round(n / y, 2) AS complexity FROM (
SELECT n, list_reduce(list_prepend({{'lo': 0.0::DOUBLE, 'hi': n / (n - d)}}, list_transform(range(80), lambda i: {{'lo': 0.0::DOUBLE, 'hi': 0.0::DOUBLE}})), lambda s, x: CASE WHEN (1 - exp(-(s.lo + s.hi) / 2)) < (n - d) / n * (s.lo + s.hi) / 2 THEN {{'lo': s.lo, 'hi': (s.lo + s.hi) / 2}} ELSE {{'lo': (s.lo + s.hi) / 2, 'hi': s.hi}} END).hi AS y FROM c)""")


def _convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pairs(spark, sf_dir)
    t = stats.totals(d).first()
    hist = [(r["min_dist"], r["max_dist"], r["strands"], r["n"]) for r in stats.dist_freq(d).collect()]
    c = stats.convergence(hist, t["cis"], t["total_mapped"], t["total_nodups"])
    row = (int(c["convergence_dist"]), c["strands_w_max_convergence_dist"], c["n_cis_pairs_below_convergence_dist_all_strands"], c["n_cis_pairs_above_convergence_dist_all_strands"])
    return spark.createDataFrame([row], "convergence_dist long, strands string, n_below long, n_above long")


query("dist_convergence", f"""{ST}, {HIST_SQL}, a AS (SELECT *, avg(n) OVER (PARTITION BY min_dist) AS m FROM h), b AS (SELECT strands, max(min_dist) AS lo FROM a WHERE m > 0 AND abs(n - m) / m > 0.05 GROUP BY strands),
w AS (SELECT b.strands, b.lo FROM b ORDER BY lo DESC, CASE strands WHEN '++' THEN 0 WHEN '--' THEN 1 WHEN '-+' THEN 2 ELSE 3 END LIMIT 1)
SELECT (SELECT max_dist FROM h WHERE min_dist = w.lo LIMIT 1) AS convergence_dist, strands, (SELECT CAST(sum(n) AS BIGINT) FROM h WHERE min_dist <= w.lo) AS n_below, (SELECT CAST(sum(n) AS BIGINT) FROM h WHERE min_dist > w.lo) AS n_above FROM w""")(_convergence)
simple("bytile_dups", lambda d: stats.bytile_duplicates(dedup.deduplicate(d).where("route = 'dups'")), _dedup_sql("max").split("SELECT p.readID, CASE")[0] + """SELECT least(t1, t2) AS tile, greatest(t1, t2) AS parent_tile, count(*) AS dup_count FROM (SELECT array_to_string(string_split(h.readID, ':')[3:5], ':') AS t1, array_to_string(string_split(f.readID, ':')[3:5], ':') AS t2 FROM head h JOIN m f ON f.o = h.h WHERE h.o <> h.h) GROUP BY ALL""")

# scaling
SIZES = {f"chr{i}": 3000 for i in range(1, 6)}
_g = scaling.geometric_edges()
SCALE_SQL = f"""{P}, edges AS (SELECT * FROM (VALUES {', '.join(f'({a}, {b})' for a, b in zip([0, *_g], [*_g, scaling.OPEN], strict=True))}) b(lo, hi)), s AS (SELECT * FROM (VALUES ('+', '+'), ('+', '-'), ('-', '+'), ('-', '-')) s(s1, s2)),
c AS (SELECT concat('chr', i) AS chrom FROM range(1, 6) r(i)),
sc AS (SELECT c.chrom AS chrom1, CAST(0 AS BIGINT) AS start1, CAST(3000 AS BIGINT) AS end1, c.chrom AS chrom2, CAST(0 AS BIGINT) AS start2, CAST(3000 AS BIGINT) AS end2, s1 AS strand1, s2 AS strand2, CAST(lo AS BIGINT) AS min_dist, CAST(hi AS BIGINT) AS max_dist,
count(p.readID) AS n_pairs, (pow(greatest(3000 - lo, 0)::DOUBLE, 2) - pow(greatest(3000 - hi, 0)::DOUBLE, 2)) / 2 AS n_bp2
FROM edges CROSS JOIN s CROSS JOIN c LEFT JOIN pairs p ON p.chrom1 = c.chrom AND p.chrom2 = c.chrom AND p.strand1 = s1 AND p.strand2 = s2 AND lo > 0 AND hi < {scaling.OPEN} AND abs(p.pos1 - p.pos2) >= lo AND abs(p.pos1 - p.pos2) < hi GROUP BY ALL)"""
simple("scaling_cis", lambda d: scaling.cis_scaling(d, chromsizes=SIZES), f"{SCALE_SQL} SELECT * FROM sc")
simple("scaling_area", lambda d: scaling.cis_scaling(d, chromsizes=SIZES).groupBy("min_dist").agg(F.sum("n_bp2").alias("n_bp2")), f"{SCALE_SQL} SELECT min_dist, sum(n_bp2) AS n_bp2 FROM sc GROUP BY 1")
TRANS_SQL = f"""{P}, v AS ({REGIONS_SQL}), s AS (SELECT * FROM (VALUES ('+', '+'), ('+', '-'), ('-', '+'), ('-', '-')) s(s1, s2)),
a AS (SELECT p.*, x.i AS i1, y.i AS i2 FROM pairs p JOIN v x ON p.chrom1 = x.chrom AND p.pos1 >= x.s AND p.pos1 < x.e JOIN v y ON p.chrom2 = y.chrom AND p.pos2 >= y.s AND p.pos2 < y.e)
SELECT x.chrom AS chrom1, CAST(x.s AS BIGINT) AS start1, CAST(x.e AS BIGINT) AS end1, y.chrom AS chrom2, CAST(y.s AS BIGINT) AS start2, CAST(y.e AS BIGINT) AS end2, s1 AS strand1, s2 AS strand2, count(a.readID) AS n_pairs, CAST((x.e - x.s) AS DOUBLE) * (y.e - y.s) AS n_bp2
FROM v x CROSS JOIN v y CROSS JOIN s LEFT JOIN a ON a.i1 = x.i AND a.i2 = y.i AND a.strand1 = s1 AND a.strand2 = s2 WHERE x.i <> y.i GROUP BY ALL"""
query("scaling_trans", TRANS_SQL)(lambda spark, d: scaling.trans_levels(pairs(spark, d), _region_table(spark)))
query("scaling_densify_outer", TRANS_SQL.replace("SELECT x.chrom AS chrom1", "SELECT * FROM (SELECT x.chrom AS chrom1", 1) + ") WHERE n_pairs = 0")(lambda spark, d: scaling.trans_levels(pairs(spark, d), _region_table(spark)).where("n_pairs = 0"))
query("scaling_skeleton_cross", f"""{SCALE_SQL.split(', c AS')[0]}, v AS ({REGIONS_SQL}) SELECT chrom AS chrom1, CAST(s AS BIGINT) AS start1, CAST(e AS BIGINT) AS end1, chrom AS chrom2, CAST(s AS BIGINT) AS start2, CAST(e AS BIGINT) AS end2, s1 AS strand1, s2 AS strand2, CAST(lo AS BIGINT) AS min_dist, CAST(hi AS BIGINT) AS max_dist FROM v CROSS JOIN s AS st CROSS JOIN edges""")(
    lambda spark, d: scaling.skeleton(pairs(spark, d), _region_table(spark), _g)
)
simple("scaling_norm", lambda d: scaling.normalise_window(scaling.frequencies(scaling.cis_scaling(d, chromsizes=SIZES)), (100, 1000)).select("min_dist", F.round("normalised", 6).alias("normalised")).where("normalised is not null"), f"""{SCALE_SQL}, f AS (SELECT min_dist, sum(n_pairs) / nullif(sum(n_bp2), 0) AS f FROM sc GROUP BY 1), m AS (SELECT avg(f) AS m FROM f WHERE min_dist BETWEEN 100 AND 1000) SELECT min_dist, round(f / m, 6) AS normalised FROM f, m WHERE f IS NOT NULL""")
simple("scaling_unity", lambda d: scaling.normalise_unity(scaling.frequencies(scaling.cis_scaling(d, chromsizes=SIZES)), (10, 2000)).select("min_dist", F.round("normalised", 9).alias("normalised")).where("normalised is not null"), f"""{SCALE_SQL}, f AS (SELECT min_dist, max_dist, sum(n_pairs) / nullif(sum(n_bp2), 0) AS f FROM sc GROUP BY 1, 2), m AS (SELECT sum(f * (max_dist - min_dist)) AS m FROM f WHERE sqrt(min_dist::DOUBLE * max_dist) > 10 AND sqrt(min_dist::DOUBLE * max_dist) < 2000) SELECT min_dist, round(f / m, 9) AS normalised FROM f, m WHERE f IS NOT NULL""")


def queries() -> dict[str, Query]:
    from . import extra, tables

    return QUERIES | extra.QUERIES | tables.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import extra, tables

    return ORACLES | extra.ORACLES | tables.ORACLES
