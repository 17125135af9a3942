"""Pair tables derived from the driver's tables, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAIRS_SQL = """SELECT concat('M:', l_orderkey % 3, ':F', l_suppkey % 2, ':', l_partkey % 4 + 1, ':', l_orderkey % 50, ':', l_linenumber, ':', l_orderkey, '_', l_partkey, '_', l_suppkey) AS readID,
  c1 AS chrom1, CASE WHEN c1 = '!' THEN 0 ELSE l_partkey END AS pos1,
  c2 AS chrom2, CASE WHEN c2 = '!' THEN 0 ELSE l_suppkey * 20 + CAST(floor(l_quantity) AS BIGINT) END AS pos2,
  CASE WHEN c1 = '!' OR l_returnflag = 'R' THEN '-' ELSE '+' END AS strand1,
  CASE WHEN c2 = '!' OR l_linestatus = 'O' THEN '-' ELSE '+' END AS strand2,
  CASE WHEN c1 <> '!' AND c2 <> '!' AND l_partkey % 17 = 0 THEN 'DD'
       ELSE concat(CASE WHEN c1 = '!' THEN 'N' WHEN l_partkey % 13 = 0 THEN 'R' ELSE 'U' END, CASE WHEN c2 = '!' THEN 'M' ELSE 'U' END) END AS pair_type,
  CASE WHEN c1 = '!' THEN 0 ELSE CAST(floor(l_quantity) AS BIGINT) END AS mapq1,
  CASE WHEN c2 = '!' THEN 0 ELSE CAST(floor(l_tax * 100) AS BIGINT) END AS mapq2
FROM (SELECT *, CASE WHEN l_linenumber % 7 = 0 THEN '!' ELSE concat('chr', l_partkey % 5 + 1) END AS c1,
             CASE WHEN l_orderkey % 11 = 0 THEN '!' ELSE concat('chr', l_suppkey % 5 + 1) END AS c2 FROM lineitem) b"""

#: pairs with SAM columns: side 1 has one or two records, side 2 one, unmapped sides none
PAIRSAM_SQL = f"""SELECT *, CASE WHEN chrom1 = '!' THEN '.'
    WHEN mapq1 % 2 = 0 THEN concat_ws(chr(25), readID, '0', chrom1, CAST(pos1 AS VARCHAR(20)), '60', '50M', '*', '0', '0', '*', '*', concat('Yt:Z:', pair_type))
    ELSE concat(concat_ws(chr(25), readID, '16', chrom1, CAST(pos1 AS VARCHAR(20)), '60', '50M', '*', '0', '0', '*', '*', 'NM:i:1', 'Yt:Z:UU'), chr(25), 'NEXT_SAM', chr(25),
                concat_ws(chr(25), readID, '2048', chrom1, '1', '7', '10M40S', '*', '0', '0', '*', '*')) END AS sam1,
  CASE WHEN chrom2 = '!' THEN '.' ELSE concat_ws(chr(25), readID, '128', chrom2, CAST(pos2 AS VARCHAR(20)), '60', '50M', '*', '0', '0', '*', '*', concat('Yt:Z:', pair_type)) END AS sam2
FROM ({PAIRS_SQL}) p"""

#: chromosomes with haplotype suffixes, scores and alternative hits in both notations
PHASED_SQL = f"""SELECT readID, CASE WHEN chrom1 = '!' THEN '!' ELSE concat(chrom1, CASE WHEN pos1 % 9 = 0 THEN '' WHEN pos1 % 2 = 0 THEN '_h1' ELSE '_h2' END) END AS chrom1, pos1,
  CASE WHEN chrom2 = '!' THEN '!' ELSE concat(chrom2, CASE WHEN pos2 % 2 = 0 THEN '_h1' ELSE '_h2' END) END AS chrom2, pos2, strand1, strand2, pair_type,
  concat_ws('', CASE WHEN mapq1 % 3 > 0 THEN concat(chrom1, CASE WHEN pos1 % 4 < 2 THEN '_h2' ELSE '_h1' END, ',+10,50M,1,', CAST(40 + mapq1 % 2 AS VARCHAR(20)), ',0;') ELSE '' END,
                CASE WHEN mapq1 % 3 > 1 THEN concat('chr9_h1,-20,50M,2,', CAST(40 + mapq1 % 4 AS VARCHAR(20)), ',0;') ELSE '' END) AS XB1,
  concat_ws('', CASE WHEN mapq2 % 3 > 0 THEN concat(chrom2, CASE WHEN pos2 % 4 < 2 THEN '_h2' ELSE '_h1' END, ',+10,50M,1,40,0;') ELSE '' END) AS XB2,
  concat_ws('', CASE WHEN mapq1 % 3 > 0 THEN concat(chrom1, CASE WHEN pos1 % 4 < 2 THEN '_h2' ELSE '_h1' END, ',+10,50M,', CAST(mapq1 % 2 AS VARCHAR(20)), ';') ELSE '' END,
                CASE WHEN mapq1 % 3 > 1 THEN 'chr9_h1,-20,50M,1;' ELSE '' END) AS XA1,
  concat_ws('', CASE WHEN mapq2 % 3 > 0 THEN concat(chrom2, CASE WHEN pos2 % 4 < 2 THEN '_h2' ELSE '_h1' END, ',+10,50M,1;') ELSE '' END) AS XA2,
  CAST(mapq1 % 2 AS VARCHAR(20)) AS NM1, CAST(mapq2 % 2 AS VARCHAR(20)) AS NM2,
  CAST(41 + mapq1 % 2 AS VARCHAR(20)) AS AS1, CAST(41 + mapq2 % 2 AS VARCHAR(20)) AS AS2,
  CAST(40 + mapq1 % 4 AS VARCHAR(20)) AS XS1, CAST(41 AS VARCHAR(20)) AS XS2
FROM ({PAIRS_SQL}) p"""


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.sql(sql.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lineitem)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PAIRS_SQL)


def pairsam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PAIRSAM_SQL)


def phased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PHASED_SQL)
