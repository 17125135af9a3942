"""Operators against plain Python on random pairs."""

import bisect
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import coverage, dedup, graph, intervals, phase, scaling, stats
from pairloom.sources.text import parse_yaml, render_stats, render_yaml

COLUMNS = ["readID", "chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2", "pair_type"]


def random_pairs(n=250, seed=3, span=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        c1, c2 = r.choice(["!", "chr1", "chr1", "chr2"]), r.choice(["!", "chr1", "chr2", "chr2"])
        out.append((f"r{i:04}", c1, 0 if c1 == "!" else r.randrange(1, span), c2, 0 if c2 == "!" else r.randrange(1, span), "-" if c1 == "!" else r.choice("+-"), "-" if c2 == "!" else r.choice("+-"), r.choice(["UU", "UU", "UR", "DD"])))
    return out


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(random_pairs(), COLUMNS)


def brute_dedup(data, mismatch, method, rule):
    rows = sorted((d for d in data if d[1] != "!" and d[3] != "!"), key=lambda d: (d[1], d[3], d[2], d[4], d[7], d[0]))

    def match(a, b):
        x, y = abs(a[2] - b[2]), abs(a[4] - b[4])
        return (a[1], a[3], a[5], a[6]) == (b[1], b[3], b[5], b[6]) and (max(x, y) if method == "max" else x + y) <= mismatch

    parent = {}
    if rule == "greedy":
        kept = []
        for d in rows:
            first = next((k for k in kept if match(k, d)), None)
            parent[d[0]] = first[0] if first else None
            if first is None:
                kept.append(d)
        return parent
    seen = set()
    for d in rows:
        if d[0] in seen:
            continue
        group, todo = {d[0]}, [d]
        while todo:
            a = todo.pop()
            for b in rows:
                if b[0] not in group and match(a, b):
                    group.add(b[0])
                    todo.append(b)
        seen |= group
        parent |= {g: None if g == d[0] else d[0] for g in group}
    return parent


@pytest.mark.parametrize("rule", ["transitive", "greedy"])
@pytest.mark.parametrize("method, mismatch", [("max", 3), ("sum", 3), ("max", 0), ("max", 1)])
def test_dedup(pairs, rule, method, mismatch):
    data = random_pairs()
    expected = brute_dedup(data, mismatch, method, rule)
    got = dedup.deduplicate(pairs, mismatch, method, rule).collect()
    assert len(got) == len(data)
    for r in got:
        if r.route == "unmapped":
            assert r.readID not in expected
        elif rule == "greedy":
            # which of several rows removes a later one is open; that one does is not
            assert (r.route == "dups") == (expected[r.readID] is not None)
        else:
            assert r.parent_readID == expected[r.readID]


def test_dedup_options(pairs):
    with pytest.raises(ValueError):
        dedup.deduplicate(pairs, method="euclid").count()
    with pytest.raises(ValueError):
        dedup.match_keys([("a", "b")])
    wide = pairs.withColumn("cell", F.substring("readID", 5, 1))
    by_cell = dedup.deduplicate(wide, extra=["cell"])
    names = {r.readID: r.cell for r in wide.collect()}
    assert all(names[r.parent_readID] == r.cell for r in by_cell.where("route = 'dups'").collect())
    marked = dedup.marked(dedup.deduplicate(pairs))
    assert marked.count() == pairs.count() and marked.where("route = 'dups' and pair_type <> 'DD'").count() == 0


@pytest.mark.parametrize("rule, mismatch", [("transitive", 3), ("greedy", 3), ("transitive", 0)])
def test_copies_that_bear_the_parents_name_are_duplicates(pairs, rule, mismatch):
    """A table merged with itself keeps as many rows as the table alone."""
    count = lambda df: {r.route: r["count"] for r in dedup.deduplicate(df, mismatch, rule=rule).groupBy("route").count().collect()}
    alone, twice = count(pairs), count(pairs.unionByName(pairs))
    assert twice["nodups"] == alone["nodups"] and twice["unmapped"] == 2 * alone["unmapped"] and sum(twice.values()) == 2 * sum(alone.values())
    copies = dedup.deduplicate(pairs.unionByName(pairs), mismatch, rule=rule).where("route = 'dups'")
    assert copies.where("parent_readID is null").count() == 0


def test_dedup_of_nothing(pairs):
    assert dedup.deduplicate(pairs.where("false")).count() == 0


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)]
    root = {n: n for link in links for n in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {n for a, b in links if a != b for n in (a, b)}
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for n in linked}


@pytest.mark.parametrize("method", ["max", "sum"])
def test_coverage(pairs, method):
    data = [d for d in random_pairs() if d[1] != "!" and d[3] != "!"]
    ends = [(d[1], d[2]) for d in data] + [(d[3], d[4]) for d in data]
    count = lambda c, p: sum(e[0] == c and abs(e[1] - p) <= 4 for e in ends) - 1
    got = {r.readID: r for r in coverage.coverage(pairs, 4, method=method, block=7).collect()}
    assert len(got) == len(data)
    for d in data:
        a, b = count(d[1], d[2]), count(d[3], d[4])
        assert (got[d[0]].cov1, got[d[0]].cov2, got[d[0]].coverage) == (a, b, (max(a, b) if method == "max" else a + b) + 1)
    routed = coverage.filter_by_coverage(pairs, 20, 4, method=method, mark_multi=True).collect()
    assert len(routed) == pairs.count()
    assert all((r.route == "high") == (r.readID in got and got[r.readID].coverage > 20) for r in routed)
    assert all(r.pair_type == "DD" for r in routed if r.route == "high")


def test_coverage_counts_rows_not_names(spark):
    """Pairs of one molecule share a name; each is counted by its own places."""
    data = [("x", "chr1", 10, "chr1", 900, "+", "+", "UU"), ("x", "chr3", 5, "chr3", 70, "+", "+", "UU"), ("y", "chr3", 5, "chr3", 500, "+", "+", "UU"), ("x", "!", 0, "chr1", 10, "-", "+", "NU"), ("y", "chr3", 5, "chr3", 500, "+", "+", "UU")]
    df = spark.createDataFrame(data, "readID string, chrom1 string, pos1 long, chrom2 string, pos2 long, strand1 string, strand2 string, pair_type string")
    got = sorted((r.readID, r.chrom1, r.pos2, r.route) for r in coverage.filter_by_coverage(df, 2, 3).collect())
    assert got == [("x", "!", 10, "unmapped"), ("x", "chr1", 900, "low"), ("x", "chr3", 70, "high"), ("y", "chr3", 500, "high"), ("y", "chr3", 500, "high")]


def test_fragments(spark, pairs):
    ends = {"chr1": [10, 25, 40], "chr2": [5, 70]}
    table = spark.createDataFrame([(c, 0, e) for c, v in ends.items() for e in v], "chrom string, start long, end long")
    for annotate in (intervals.annotate_fragments,):
        for r in annotate(pairs, table).collect():
            for c, p, got in ((r.chrom1, r.pos1, (r.rfrag1, r.rfrag_start1, r.rfrag_end1)), (r.chrom2, r.pos2, (r.rfrag2, r.rfrag_start2, r.rfrag_end2))):
                if c not in ends:
                    assert got == (-1, 0, 0)
                    continue
                bounds = [0] + [e + 1 for e in ends[c]]
                i = min(bisect.bisect_right(bounds, p) - 1, len(bounds) - 2)
                assert got == (i, bounds[i], bounds[i + 1])


def test_regions(spark, pairs):
    regions = [("chr1", 0, 10), ("chr1", 20, 30), ("chr2", 5, 50)]
    out = intervals.assign_regions(pairs, spark.createDataFrame(regions, "chrom string, start long, end long")).collect()
    for r in out:
        i = next((i for i, (c, s, e) in enumerate(regions) if c == r.chrom1 and s <= r.pos1 < e), -1)
        assert r.region1 == i and r.region_start1 == (regions[i][1] if i >= 0 else None)


def test_statistics(pairs):
    data = random_pairs()
    t = stats.totals(pairs).first()
    mapped = [d for d in data if d[1] != "!" and d[3] != "!"]
    nodups = [d for d in mapped if d[7] != "DD"]
    cis = [d for d in nodups if d[1] == d[3]]
    assert (t.total, t.total_mapped, t.total_dups, t.total_nodups, t.cis, t.trans) == (len(data), len(mapped), len(mapped) - len(nodups), len(nodups), len(cis), len(nodups) - len(cis))
    assert t.total_unmapped + t.total_single_sided_mapped + t.total_mapped == t.total
    hist = stats.dist_freq(pairs).collect()
    edges = stats.distance_edges()
    assert len(edges) == 72 and len(hist) == 72 * 4 and sum(r.n for r in hist) == len(cis)
    for r in hist:
        hi = r.max_dist or math.inf
        assert r.n == sum(r.min_dist <= abs(d[2] - d[4]) < hi and d[5] + d[6] == r.strands for d in cis)
    parts = stats.merge([stats.long_table(pairs.where("pos1 < 20")), stats.long_table(pairs.where("pos1 >= 20"))])
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, stats.long_table(pairs).collect()))
    tree = stats.nested(stats.long_table(pairs))
    assert tree["summary"]["frac_cis"] == len(cis) / len(nodups) and stats.lookup(tree, "pair_types/UU") == sum(d[7] == "UU" for d in data)
    assert parse_yaml(render_yaml(tree))["total"] == len(data) and "total\t250\n" in render_stats(tree)


def test_named_filters(pairs):
    by = {r.filter: r.total for r in stats.totals(pairs, {"near": "abs(pos1 - pos2) < 10", "none": "pos1 < 0"}).collect()}
    assert by == {"no_filter": 250, "near": sum(abs(d[2] - d[4]) < 10 for d in random_pairs())}


@pytest.mark.parametrize("n, dups, optical", [(100, 10, 0), (1000, 400, 100), (10, 0, 0), (0, 0, 0), (10, 10, 0), (10**9, 10**8, 0)])
def test_complexity(spark, n, dups, optical):
    x = stats.library_complexity(n, dups, optical)
    got = spark.range(1).select(stats.complexity(F.lit(n), F.lit(dups), F.lit(optical)).alias("x")).first().x
    assert got == pytest.approx(x) if x is not None else got is None
    if x:
        reads, unique = n - optical, n - dups
        assert x * (1 - math.exp(-reads / x)) == pytest.approx(unique, rel=1e-6)


def test_convergence():
    edges = stats.distance_edges()
    hist = [(lo, hi, s, 1000 if lo >= 10000 else (100 if s == "++" else 200)) for lo, hi in zip(edges, [*edges[1:], None]) for s in stats.STRANDS]
    out = stats.convergence(hist, 1000, 2000, 1500)
    assert out["convergence_dist"] == 10000 and out["strands_w_max_convergence_dist"] == "++"
    total = sum(h[3] for h in hist)
    assert out["n_cis_pairs_below_convergence_dist_all_strands"] + out["n_cis_pairs_above_convergence_dist_all_strands"] == total
    flat = stats.convergence([(lo, hi, s, 5) for lo, hi, s, _ in hist], 0, 0, 0)
    assert flat["strands_w_max_convergence_dist"] == "??" and flat["frac_cis_in_cis_above_convergence_dist_all_strands"] == 0


def test_tiles(spark):
    df = spark.createDataFrame([("a:b:1:2:3:x", "a:b:1:2:4:x"), ("a:b:1:2:4:y", "a:b:1:2:3:z"), ("a:b:1:2:3:q", "a:b:1:2:3:w")], "readID string, parent_readID string")
    assert sorted(map(tuple, stats.bytile_duplicates(df).collect())) == [("1:2:3", "1:2:3", 1), ("1:2:3", "1:2:4", 2)]
    assert stats.optical_from_tiles(stats.bytile_duplicates(df)).first().dups_by_tile_median == 3


def test_scaling(spark, pairs):
    edges = scaling.geometric_edges()
    assert len(edges) == 71 and edges[0] == 1 and edges[-1] == 10**9
    data = random_pairs()
    cis = scaling.cis_scaling(pairs, chromsizes={"chr1": 100, "chr2": 80}).collect()
    assert len(cis) == 2 * 4 * 72
    inside = [d for d in data if d[1] == d[3] != "!" and abs(d[2] - d[4]) >= 1]
    assert sum(r.n_pairs for r in cis) == len(inside)
    for r in cis:
        assert r.n_pairs == sum(d[1] == r.chrom1 and (d[5], d[6]) == (r.strand1, r.strand2) and max(r.min_dist, 1) <= abs(d[2] - d[4]) < r.max_dist for d in inside)
        assert r.n_bp2 == (max(r.end1 - r.min_dist, 0) ** 2 - max(r.end1 - r.max_dist, 0) ** 2) / 2
    trans = scaling.trans_levels(pairs, chromsizes={"chr1": 100, "chr2": 80}).collect()
    assert len(trans) == 8 and sum(r.n_pairs for r in trans) == sum({d[1], d[3]} == {"chr1", "chr2"} for d in data)
    free = scaling.cis_scaling(pairs)
    assert free.where("chrom1 = 'chr1'").agg(F.sum("n_pairs")).first()[0] == sum(d[1] == "chr1" for d in inside)
    freq = scaling.frequencies(scaling.cis_scaling(pairs, chromsizes={"chr1": 100, "chr2": 80}))
    unity = scaling.normalise_unity(freq, None).where("frequency is not null").collect()
    assert sum(r.normalised * (r.max_dist - r.min_dist) for r in unity) == pytest.approx(1)
    window = scaling.normalise_window(freq, (2, 10)).where("min_dist between 2 and 10").collect()
    assert sum(r.normalised for r in window) / len(window) == pytest.approx(1)


def test_area_between_regions_adds_up(spark):
    """A region cut in two: both parts and twice nothing but the space between make the whole."""
    def value(column):
        return spark.range(1).select(column.alias("x")).first().x

    lit = F.lit
    whole = value(scaling.area(lit(3), lit(9), lit(20)))
    parts = sum(value(scaling.area(lit(3), lit(9), lit(n))) for n in (12, 8))
    between = value(scaling.area_between(lit(3), lit(9), lit(0), lit(12), lit(12), lit(20)))
    assert whole == pytest.approx(parts + between)


def hits(*h):
    return "".join(f"{c},+1,5M,{','.join(map(str, rest))};" for c, *rest in h)


@pytest.mark.parametrize(
    "chrom, xb, a, x, expected",
    [
        ("chr1_A", "", 10, 5, ("0", "chr1")),
        ("chr1_B", "", 10, 5, ("1", "chr1")),
        ("chr1", "", 10, 5, ("!", "chr1")),
        ("chr1_A", hits(("chr1_B", 0, 10, 60)), 10, 10, (".", "chr1")),
        ("chr1_A", hits(("chr1_A", 0, 10, 60)), 10, 10, ("!", "!")),
        ("chr1_A", hits(("chr2_B", 0, 10, 60)), 10, 10, ("!", "!")),
        ("chr1_A", hits(("chr1_B", 0, 10, 60), ("chr5_B", 0, 10, 60)), 10, 10, ("!", "!")),
        ("chr1_A", hits(("chr1_B", 0, 10, 60), ("chr5_B", 0, 8, 60)), 10, 10, (".", "chr1")),
        ("chr1_A", "", 10, 10, ("!", "!")),
        ("!", "", 0, 0, ("!", "!")),
    ],
)
def test_phase(spark, chrom, xb, a, x, expected):
    df = spark.createDataFrame([("r", chrom, 7, "chr2_B", 9, "+", "+", "UU", xb, "", a, 10, x, 5)], "readID string, chrom1 string, pos1 long, chrom2 string, pos2 long, strand1 string, strand2 string, pair_type string, XB1 string, XB2 string, AS1 int, AS2 int, XS1 int, XS2 int")
    r = phase.phase(df, ("_A", "_B"), report_scores=True).first()
    assert (r.phase1, r.chrom1) == expected and (r.phase2, r.chrom2, r.pos2) == ("1", "chr2", 9)
    if expected[1] == "!" and chrom != "!":
        assert (r.pos1, r.strand1, r.pair_type) == (0, "-", "MU")
    assert "XB1" not in phase.phase(df, ("_A", "_B"), clean=True).columns
    with pytest.raises(ValueError):
        phase.phase(df, ("_A", "_B"), mode="XA")


def test_candidates_are_complete(spark, pairs):
    mapped = dedup.mapped(pairs).withColumnRenamed("readID", "node")
    got = {tuple(sorted(map(str, (r.a, r.b)))) for r in dedup.candidate_edges(mapped, dedup.match_keys(), 2).collect()}
    data = [d for d in random_pairs() if d[1] != "!" and d[3] != "!"]
    expected = {(a[0], b[0]) for a, b in itertools.combinations(data, 2) if (a[1], a[3], a[5], a[6]) == (b[1], b[3], b[5], b[6]) and max(abs(a[2] - b[2]), abs(a[4] - b[4])) <= 2}
    assert got == expected
