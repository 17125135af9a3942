import pytest
from pyspark.sql import functions as F

from pairloom.streaming import pairs as streams

COLUMNS = "readID string, chrom1 string, pos1 long, chrom2 string, pos2 long, strand1 string, strand2 string, pair_type string, ts timestamp"


@pytest.fixture()
def folder(spark, tmp_path):
    rows = [(f"r{i}", "chr1" if i % 5 else "!", i % 7, "chr2", i % 3, "+", "-", "UU") for i in range(100)]
    df = spark.createDataFrame(rows, COLUMNS.rsplit(", ", 1)[0]).withColumn("ts", (F.lit(1_700_000_000) + F.substring("readID", 2, 9).cast("int") * 60).cast("timestamp"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), rows


def test_exact_duplicates(spark, folder):
    path, rows = folder
    out = streams.run(streams.drop_duplicates(streams.read_stream(spark, path, 1)))
    assert out.count() == len({(r[2], r[4]) for r in rows if r[1] != "!"})


def test_duplicates_are_forgotten_behind_the_watermark(spark, folder):
    path, rows = folder
    out = streams.run(streams.drop_duplicates(streams.read_stream(spark, path), time="ts", delay="10 days"))
    assert out.count() == len({(r[2], r[4]) for r in rows if r[1] != "!"})


def test_running_totals(spark, folder):
    path, rows = folder
    got = streams.run(streams.running_totals(streams.read_stream(spark, path, 2)), "complete").first()
    assert (got.total, got.total_mapped) == (100, 80)


def test_windows(spark, folder):
    path, _ = folder
    stream = streams.read_stream(spark, path)
    tumbling = streams.run(streams.windowed_counts(stream, "ts", "10 minutes", ["chrom2"], "1 day"), "complete")
    assert tumbling.agg(F.sum("n")).first()[0] == 100 and tumbling.agg(F.max("n")).first()[0] <= 10
    sliding = streams.run(streams.windowed_counts(stream, "ts", "10 minutes", ["chrom2"], "1 day", "5 minutes"), "complete")
    assert sliding.agg(F.sum("n")).first()[0] == 200
