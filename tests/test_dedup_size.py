"""Duplicates: whole rows are shuffled once, places without another close by are let go, and no limit changes a result."""

import random

import pytest

from pairloom.operators import dedup

SCHEMA = "readID string, chrom1 string, pos1 long, chrom2 string, pos2 long, strand1 string, strand2 string, pair_type string, mapq1 int"


def table(spark, seed, n, span, copies):
    rng = random.Random(seed)
    rows = [("r%d" % rng.randint(0, n), rng.choice(("chr1", "!")) if rng.random() < 0.2 else "chr1", rng.randint(0, span), "chr2", rng.randint(0, span), rng.choice("+-"), "+", "UU", rng.randint(0, 1)) for _ in range(n)]
    return spark.createDataFrame([r for r in rows for _ in range(rng.choice((1, 1, copies)))], SCHEMA)


def routed(df, **options):
    return sorted(map(tuple, dedup.deduplicate(df, **options).collect()), key=repr)


def test_whole_rows_are_shuffled_once(spark):
    out = dedup.deduplicate(table(spark, 1, 50, 10, 2)).select("readID", "parent_readID", "route")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_near_places_are_found_across_tiles(spark):
    rng = random.Random(3)
    for r in (1, 3):
        side = 128 * (r + 1)
        places = {(side * rng.randint(-1, 1) + rng.randint(-9, 9), side * rng.randint(-1, 1) + rng.randint(-9, 9)) for _ in range(120)}
        places |= {(rng.randint(0, 3 * side), rng.randint(0, 3 * side)) for _ in range(200)}
        spots = spark.createDataFrame([("a", p, q, 1) for p, q in places], "k string, pos1 long, pos2 long, copies long")
        got = {(x.pos1, x.pos2) for x in dedup.neighbours(spots, ["k"], r).where("near").collect()}
        close = {p for p in places for q in places if p != q and max(abs(p[0] - q[0]), abs(p[1] - q[1])) <= r}
        assert close and close <= got and len(got) < len(places)


@pytest.mark.parametrize("rule", ["transitive", "greedy"])
def test_limits_change_no_result(spark, monkeypatch, rule):
    df = table(spark, 5, 150, 12, 7).unionByName(table(spark, 6, 60, 4000, 9)).repartition(4)
    expected = routed(df, rule=rule, extra=["mapq1"])
    monkeypatch.setattr(dedup, "HOT", 3)
    assert routed(df, rule=rule, extra=["mapq1"]) == expected
    monkeypatch.setattr(dedup, "BROADCAST", 0)
    assert routed(df, rule=rule, extra=["mapq1"]) == expected
    exact = routed(df, max_mismatch=0)
    monkeypatch.setattr(dedup, "HOT", 1_000_000)
    assert routed(df, max_mismatch=0) == exact


def test_rows_alone_are_not_shuffled(spark):
    rng = random.Random(8)
    far = [("f%d" % i, "chr1", 1000 * i, "chr2", 500 * i, "+", "+", "UU", 0) for i in range(4000)]
    near = [("n%d" % i, "chr1", p, "chr2", q, "+", "+", "UU", 0) for i, (p, q) in enumerate([(15, 31), (16, 32), (31, 16), (32, 15), (-1, 300), (0, 300), (-500, 7), (-500, 7), (2**40, 9), (2**40 + 3, 12)])]
    rows = [*far, *near, ("u", "!", 0, "chr2", 5, "-", "+", "NU", 0), ("x", "chr1", None, "chr2", 5, "+", "+", "UU", 0), ("y", "chr1", 15, "chr2", 31, None, "+", "UU", 0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    placed = (dedup.F.col("chrom1") != "!") & dedup.F.col("pos1").isNotNull()
    found = {r.readID for r in dedup.with_crowded(df, placed, dedup.match_keys(), 3).where("crowded_").collect()}
    assert {r[0] for r in near} <= found and len(found) < 500 and not found & {"u", "x"}
    routes = {r.readID: (r.route, r.parent_readID) for r in dedup.deduplicate(df).collect()}
    assert len(routes) == len(rows) and {k for k, v in routes.items() if v[0] == "unmapped"} == {"u", "x"}
    assert sorted(k for k, v in routes.items() if v[0] == "dups") == ["n1", "n3", "n5", "n7", "n9"] and routes["n3"][1] == "n2"


def test_a_full_table_of_bits_changes_no_result(spark, monkeypatch):
    df = table(spark, 5, 150, 12, 7).unionByName(table(spark, 6, 60, 4000, 9)).repartition(4)
    expected, exact = routed(df), routed(df, max_mismatch=0)
    monkeypatch.setattr(dedup, "BITS", 64)
    assert routed(df) == expected and routed(df, max_mismatch=0) == exact
