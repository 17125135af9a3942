"""Pairs from alignments: small molecules with their pairs worked out by hand."""

import pytest

from pairloom.operators import molecules as M
from pairloom.operators import walks as W
from pairloom.operators.walks import Segment
from pairloom.sources import sam

CHROMS = ["chr1", "chr2", "chr3"]


def seg(chrom="chr1", pos5=100, strand="+", at=0, span=20, unique=True, mapped=True):
    end = pos5 + span - 1 if strand == "+" else pos5 - span + 1
    if not (mapped and unique):
        chrom, pos5, end, strand = "!", 0, 0, "-"
    return Segment(chrom=chrom, pos5=pos5, pos3=end, strand=strand, mapq=60 if unique else 0, is_mapped=mapped, is_unique=mapped and unique, dist_to_5=at, algn_read_span=span, read_len=60)


def brief(pairs):
    return [(p.one.chrom, p.one.pos5, p.one.strand, p.two.chrom, p.two.pos5, p.two.strand, p.one.type + p.two.type, p.index, p.kind) for p in pairs]


def test_two_linear_reads():
    pairs, _, _ = W.parse_molecule([seg(pos5=10)], [seg("chr2", 50, "-")])
    assert brief(pairs) == [("chr1", 10, "+", "chr2", 50, "-", "UU", 1, "R1-2")]


@pytest.mark.parametrize("missing", [1, 2])
def test_an_empty_side(missing):
    sides = ([], [seg()]) if missing == 1 else ([seg()], [])
    assert brief(W.parse_molecule(*sides)[0])[0][6] == "XX"


def test_gaps():
    filled = W.fill_gaps([seg(at=30), seg(at=51)], 20)
    assert [s.is_mapped for s in filled] == [False, True, True] and filled[0].algn_read_span == 30
    assert len(W.fill_gaps([seg(at=20)], 20)) == 1 and len(W.fill_gaps([seg(at=0, mapped=False)], 20)) == 1
    # every null alignment takes up a place, so the last alignment is not looked at
    assert len(W.fill_gaps([seg(at=30), seg(at=90)], 20)) == 3


def chimera(three=seg("chr2", 500, "-", at=20)):
    return [seg(pos5=10), three], [seg("chr2", 300, "+")]


def test_rescue():
    pairs, _, _ = W.parse_molecule(*chimera(), policy="mask")
    assert brief(pairs) == [("chr1", 10, "+", "chr2", 300, "+", "UR", 1, "R1")]
    turned = W.parse_molecule(*chimera()[::-1], policy="mask")[0]
    assert brief(turned)[0][6:] == ("RU", 1, "R2")
    for three in (seg("chr3", 500, "-", at=20), seg("chr2", 500, "+", at=20), seg("chr2", 200, "-", at=20), seg("chr2", 1200, "-", at=20)):
        assert brief(W.parse_molecule(*chimera(three), policy="mask")[0])[0][6] == "WW"
    assert brief(W.parse_molecule(*chimera(seg(mapped=False, at=20)), policy="mask")[0])[0][6] == "UR"


@pytest.mark.parametrize("policy, first", [("5any", 0), ("5unique", 10), ("3any", 0), ("3unique", 30)])
def test_policies(policy, first):
    a = [seg(unique=False), seg(pos5=10, at=20), seg("chr3", 30, at=40), seg(unique=False, at=60)]
    pairs, _, _ = W.parse_molecule(a, [seg("chr2", 7)], policy)
    assert pairs[0].one.pos5 == first and pairs[0].two.pos5 == 7
    with pytest.raises(ValueError):
        W.parse_molecule(a, a, "nonsense")


def test_walk_without_overlap():
    a, b = [seg("chr1", 10), seg("chr2", 100, at=20)], [seg("chr3", 50)]
    assert brief(W.parse_molecule(a, b, "all")[0]) == [
        ("chr1", 10, "+", "chr2", 119, "-", "UU", 1, "R1"),
        ("chr2", 100, "+", "chr3", 50, "+", "UU", 2, "R1-2"),
    ]


def test_walk_with_a_junction_in_both_reads():
    a = [seg("chr1", 10), seg("chr2", 100, at=20)]
    b = [seg("chr2", 119, "-"), seg("chr1", 29, "-", at=20)]
    assert W.overlap_length(a, b, 3) == 1 and W.overlap_length(a, [b[0]], 3) == 0
    assert brief(W.parse_molecule(a, b, "all")[0]) == [("chr1", 10, "+", "chr2", 119, "-", "UU", 1, "R1&2")]


def test_walk_whose_ends_overlap():
    a, b = [seg("chr1", 10), seg("chr2", 100, at=20)], [seg("chr2", 150, "-")]
    assert brief(W.parse_molecule(a, b, "all")[0]) == [("chr1", 10, "+", "chr2", 150, "-", "UU", 1, "R1")]


def test_expansion():
    pairs, _, _ = W.parse_molecule_all([seg("chr1", 10), seg("chr2", 100, at=20), seg("chr3", 200, at=40)], [], expanded=True, single_end=False)
    assert ("E1_R1-2" in {p.kind for p in pairs}) or ("E1_R1" in {p.kind for p in pairs})
    three = [seg("chr1", 10), seg("chr2", 100, at=20), seg("chr3", 200, at=40)]
    found, _, _ = W.parse_molecule_all([], three, single_end=True, expanded=True)
    assert [(p.index, p.kind) for p in found] == [(1, "R1"), (1, "E1_R1"), (2, "R1")]
    assert (found[1].one.chrom, found[1].two.chrom) == ("chr1", "chr3")
    assert [p.kind for p in W.parse_molecule_all([], three, single_end=True, expanded=True, depth=0)[0]] == ["R1", "R1"]
    (alone,), _, _ = W.parse_molecule_all([], three[:1], single_end=True)
    assert alone.kind == "R1" and alone.two.chrom == "!"


@pytest.mark.parametrize("position, pos", [("outer", (10, 119)), ("junction", (29, 100)), ("read", (10, 100)), ("walk", (10, 100))])
@pytest.mark.parametrize("orientation, strands", [("pair", "+-"), ("junction", "-+"), ("read", "++"), ("walk", "++")])
def test_what_is_reported(position, pos, orientation, strands):
    p = W.report(seg("chr1", 10), seg("chr2", 100), 1, "R1", position, orientation)
    assert (p.one.pos5, p.two.pos5) == pos and p.one.strand + p.two.strand == strands


SAM = """@SQ\tSN:chr1\tLN:1000
a\t65\tchr1\t10\t60\t5S20M\t*\t0\t0\tACGTACGTACGTACGTACGTACGTA\tIIIIIIIIIIIIIIIIIIIIIIIII\tNM:i:1\tMD:Z:3A16
a\t145\tchr2\t200\t60\t10M2D10M5H\t*\t0\t0\tACGTACGTACGTACGTACGT\tIIIIIIIIIIIIIIIIIIII\tNM:i:0
b\t77\t*\t0\t0\t*\t*\t0\t0\tA\tI
b\t141\t*\t0\t0\t*\t*\t0\t0\tA\tI
c\t65\tchr2\t10\t60\t20M\t*\t0\t0\tA\tI
c\t129\tchr1\t20\t0\t20M\t*\t0\t0\tA\tI
d\t65\tchr3\t10\t60\t20M\t*\t0\t0\tA\tI
e\t65\tchr2\t10\t60\t30S20M\t*\t0\t0\tA\tI
e\t129\tchr1\t20\t60\t20M\t*\t0\t0\tA\tI
"""


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sam") / "a.sam"
    path.write_text(SAM)
    return sam.read_sam(spark, str(path))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_from_text(records):
    got = rows(M.parse(records, CHROMS, walks_policy="mask", drop_sam=True))
    assert got == [
        ("a", "chr1", 10, "chr2", 221, "+", "-", "UU"),
        ("b", "!", 0, "!", 0, "-", "-", "NN"),
        ("c", "!", 0, "chr2", 10, "-", "+", "MU"),
        ("d", "!", 0, "!", 0, "-", "-", "XX"),
        # 30 clipped bases are a null alignment in front: a chimera whose 5' part isn't unique is rescued
        ("e", "!", 0, "chr1", 20, "-", "+", "NR"),
    ]
    unflipped = rows(M.parse(records, CHROMS, walks_policy="5any", drop_sam=True, flip=False, report_alignment_end="3"))
    assert unflipped[0][:5] == ("a", "chr1", 29, "chr2", 200) and unflipped[2][1:5] == ("chr2", 29, "!", 0) and unflipped[4][7] == "NR"


def test_columns_and_sam(records):
    r = {x.readID: x for x in M.parse(records, CHROMS, add_pair_index=True, add_columns=["mapq", "cigar", "NM", "mismatches", "dist_to_5"], drop_seq=True).collect()}
    a = r["a"]
    assert (a.walk_pair_index, a.walk_pair_type, a.mapq1, a.cigar2, a.NM1, a.NM2, a.dist_to_51, a.dist_to_52) == (1, "R1-2", 60, "10M2D10M5H", "1", "0", 5, 5)
    assert a.mismatches1 == "A:A:40:12:8" and a.sam1.endswith("Yt:Z:UU") and "\x19*\x19*\x19NM" in a.sam1
    assert r["d"].sam2 == "" and r["c"].sam2.startswith("c\x1965")
    with pytest.raises(ValueError):
        M.parse(records, CHROMS, add_columns=["nonsense"])
    with pytest.raises(ValueError):
        M.parse(records, CHROMS, walks_policy="nonsense")
    assert rows(M.parse(records, CHROMS, drop_readid=True, drop_sam=True))[0][0] == "."


def test_fast_path_equals_the_walk_logic(records, monkeypatch):
    fast = rows(M.parse(records, CHROMS, add_columns=["mapq", "NM", "algn_idx"], add_pair_index=True))
    # a gap limit below zero sends every mapped molecule through the walk logic; nothing else may change for those without clips
    slow = {r[0]: r for r in rows(M.parse(records.where("qname in ('b', 'c', 'd')"), CHROMS, add_columns=["mapq", "NM", "algn_idx"], add_pair_index=True, max_inter_align_gap=20))}
    assert all(slow[r[0]] == r for r in fast if r[0] in slow)


def test_parsed_alignments(records):
    lines = {(r.readID, r.side): r.line for r in M.parsed_alignments(records).collect()}
    assert lines[("a", 1)] == "a\t1\tchr1\t10\t+\t60\t5S20M\t5\t25\t20" and lines[("d", 2)] == "d\t2\t"


def test_cigars_are_measured_once_each_and_outside_the_plan(spark):
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    texts = ["*", None, "", "10S40M", "5H5S40M3S2H", "3S2I4M1D2S", "20M2D10M3I17M", "M10", "4=3X", *["".join(f"{rng.randint(0, 99)}{rng.choice('MIDNSHP=X')}" for _ in range(rng.randint(1, 7))) for _ in range(300)]]
    rows = [("r%d" % (i // 3), rng.choice((64, 128)) + 4 * (rng.random() < 0.2) + 16 * (rng.random() < 0.5), "chr1", rng.randint(1, 99), rng.randint(0, 3), c, "*", "*", [], ("", 0, i), "x") for i, c in enumerate(texts)]
    df = spark.createDataFrame(rows, "qname string, flag int, rname string, pos long, mapq int, cigar string, seq string, qual string, tags array<string>, place struct<file:string,start:long,n:long>, record string")
    flat = M.alignments(df).select("algn.*", "pos", "turned").toArrow()
    flat = flat.set_column(flat.column_names.index("strand"), "minus", pa.array([x == "-" for x in flat["strand"].to_pylist()]))
    told = M.measured(flat)
    for c in told:
        assert np.array_equal(told[c], flat[c].to_numpy()), c
    assert "aggregate(" not in M.parse(df, ["chr1"], drop_sam=True)._jdf.queryExecution().executedPlan().toString()
