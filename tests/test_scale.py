"""Plans: filters and columns reach the scan, and no operator gathers a chromosome or a copied place in one task."""

import os

import pytest

from pairloom.functions.conditions import select
from pairloom.operators import coverage, dedup, intervals, rows, scaling, stats
from pairloom.plans import views

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_pruning_and_pushdown(spark, tmp_path):
    views.pairs(spark, DATA).write.parquet(str(tmp_path / "pairs"))
    df = spark.read.parquet(str(tmp_path / "pairs"))
    text = plan(select(df, "pos1 >= 100 and chrom1 == 'chr1'").select("readID", "pos1"))
    assert "GreaterThanOrEqual(pos1,100)" in text and "EqualTo(chrom1,chr1)" in text and "ReadSchema: struct<readID:string,chrom1:string,pos1:bigint>" in text


def test_row_operators_do_not_shuffle(spark):
    df = views.pairsam(spark, DATA)
    for out in (rows.flip(df, ["chr1"]), rows.mark_duplicates(df), rows.split_sam(df), rows.sample(df, 0.1), rows.split_pairs(df)):
        text = plan(out)  # flip broadcasts the names of the order
        assert "hashpartitioning" not in text and "rangepartitioning" not in text and "SortMergeJoin" not in text and "EvalPython" not in text and "Pandas" not in text


def test_tables_of_regions_are_built_without_cross_products(spark):
    df = views.pairs(spark, DATA)
    view = spark.createDataFrame([("chr1", 0, 600), ("chr1", 600, 1500), ("chr2", 100, 1900)], "chrom string, start long, end long")
    for out in (scaling.cis_scaling(df, chromsizes={"chr1": 3000, "chr2": 3000}), scaling.cis_scaling(df, view), scaling.trans_levels(df, view), scaling.cis_scaling(df)):
        text = plan(out)
        assert "CartesianProduct" not in text and "NestedLoop" not in text
    with pytest.raises(ValueError):
        scaling.trans_levels(df, spark.range(3000).selectExpr("concat('chr', id) as chrom", "0L as start", "1L as end"))


def test_intervals_are_found_by_an_equi_join(spark):
    df = views.pairs(spark, DATA)
    fragments = spark.range(1, 400).selectExpr("concat('chr', id % 5 + 1) as chrom", "0L as start", "id * 10 as end")
    for out in (intervals.annotate_fragments(df, fragments), intervals.assign_regions(df, spark.createDataFrame([("chr1", 0, 600)], "chrom string, start long, end long"))):
        text = plan(out)
        assert "BroadcastHashJoin" in text and "NestedLoop" not in text and "aggregate(" not in text


def test_statistics_combine_before_the_shuffle(spark):
    text = plan(stats.totals(views.pairs(spark, DATA)))
    assert text.count("HashAggregate") >= 2 and "partial_count" in text


def test_coverage_cuts_chromosomes_into_blocks(spark):
    assert "hashpartitioning(chrom" in plan(coverage.coverage(views.pairs(spark, DATA), 5)) and ", block" in plan(coverage.coverage(views.pairs(spark, DATA), 5))


def test_any_number_of_copies_is_one_node(spark):
    """A place with very many copies must not be expanded into pairs."""
    df = spark.range(30000).selectExpr("concat('r', id) as readID", "'chr1' as chrom1", "5L as pos1", "'chr1' as chrom2", "9L as pos2", "'+' as strand1", "'-' as strand2", "'UU' as pair_type")
    out = dedup.deduplicate(df)
    assert out.where("route = 'nodups'").count() == 1 and out.where("parent_readID = 'r0'").count() == 29999
