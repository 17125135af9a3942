import random

import pytest

from pairloom.operators import order, rows
from pairloom.schema import PAIRSAM, RECORD_SEP, SAM_SEP

COLUMNS = ["readID", "chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2", "pair_type", "mapq1", "mapq2"]


def table(spark, n=300, seed=1):
    r = random.Random(seed)
    chroms = ["!", "chr1", "chr2", "chr10", "chrU", "chrU1"]
    data = [(f"r{i}", r.choice(chroms), r.randrange(20), r.choice(chroms), r.randrange(20), r.choice("+-"), r.choice("+-"), r.choice(["UU", "UR", "NM", "DD"]), r.randrange(60), r.randrange(60)) for i in range(n)]
    return spark.createDataFrame(data, COLUMNS), data


def test_flip_order_and_swap(spark):
    df, data = table(spark)
    order_ = ["chr1", "chr2"]
    rank = {"!": 0, "chr1": 1, "chr2": 2}
    for row in rows.flip(df, order_).collect():
        old = data[int(row.readID[1:])]
        _, c1, p1, c2, p2, s1, s2, t, m1, m2 = old
        if c1 in rank and c2 in rank:
            wrong = (rank[c1], p1) > (rank[c2], p2)
        elif c1 in rank or c2 in rank:
            wrong = c1 not in rank
        else:
            wrong = not c1 < c2
        expected = (old[0], c2, p2, c1, p1, s2, s1, t[::-1], m2, m1) if wrong else old
        assert tuple(row) == expected


def test_flip_twice_changes_nothing_for_known_chromosomes(spark):
    df, _ = table(spark)
    df = df.where("chrom1 not like 'chrU%' and chrom2 not like 'chrU%'")
    once = rows.flip(df, ["chr1", "chr2", "chr10"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, rows.flip(once, ["chr1", "chr2", "chr10"]).collect()))


def test_markasdup_edits_every_record(spark):
    rec = lambda flag, *tags: SAM_SEP.join(["r", str(flag), "chr1", "1", "60", "5M", "*", "0", "0", "A", "A", *tags])
    both = RECORD_SEP.join([rec(64, "NM:i:0", "Yt:Z:UU"), rec(2112)])
    df = spark.createDataFrame([("r", "chr1", 1, "chr1", 2, "+", "+", "UU", both, ".")], PAIRSAM)
    out = rows.mark_duplicates(df).first()
    assert out.pair_type == "DD" and out.sam2 == "."
    assert out.sam1 == RECORD_SEP.join([rec(1088, "NM:i:0", "Yt:Z:DD"), rec(3136)])
    lines = rows.split_sam(df).orderBy("record").collect()
    assert [(r.side, r.record) for r in lines] == [(1, 0), (1, 1)] and lines[0].line == rec(64, "NM:i:0", "Yt:Z:UU").replace(SAM_SEP, "\t")


def test_split_needs_both_sam_columns(spark):
    df = spark.createDataFrame([("r", "x")], "readID string, sam1 string")
    with pytest.raises(ValueError):
        rows.split_pairs(df)


def test_sort_is_bytewise_and_numeric(spark):
    df, data = table(spark)
    got = [tuple(r)[:5] + (r.pair_type,) for r in order.sort_pairs(df, ordinal="readID").collect()]
    assert got == [d[:5] + (d[7],) for d in sorted(data, key=lambda d: (d[1], d[3], d[2], d[4], d[7], d[0]))]
    assert [r.chrom1 for r in order.sort_pairs(df, c1=2, c2="chrom2").collect()] == sorted(d[1] for d in data)
    with pytest.raises(ValueError):
        order.sort_pairs(df, c1="nothing")


def test_merge_is_sorted_and_keeps_all_rows(spark):
    df, data = table(spark)
    parts = [df.where("mapq1 < 20"), df.where("mapq1 >= 20")]
    got = [tuple(r) for r in order.merge(parts).collect()]
    line = lambda d: "\t".join(map(str, d))
    assert got == sorted(data, key=lambda d: (d[1], d[3], d[2], d[4], d[7], line(d)))
    assert order.merge(parts[:1]) is parts[0]
    with pytest.raises(ValueError, match="different columns"):
        order.merge([df, df.drop("mapq1")])


def test_sample_is_a_share_and_does_not_depend_on_layout(spark):
    df = spark.range(20000).selectExpr("concat('r', id) as readID")
    a = {r.readID for r in rows.sample(df, 0.3, 5).collect()}
    assert a == {r.readID for r in rows.sample(df.repartition(17), 0.3, 5).collect()}
    assert abs(len(a) / 20000 - 0.3) < 0.02 and a != {r.readID for r in rows.sample(df, 0.3, 6).collect()}
    assert rows.sample(df, 0).count() == 0 and rows.sample(df, 1).count() == 20000
    with pytest.raises(ValueError):
        rows.sample(df, 1.5)


def test_mapped_filters_partition_the_table(spark):
    df, data = table(spark)
    n = {k: rows.filter_mapped(df, k).count() for k in ("both", "one", "none", "not_both")}
    assert n["both"] + n["one"] + n["none"] == len(data) and n["not_both"] == n["one"] + n["none"]
