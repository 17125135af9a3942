"""The walk rules on arrays are those of walks; a table is dealt out once, and nothing is gathered in lists or sent row by row."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import molecules, walk_batches, walks
from pairloom.operators.walks import Segment

CHROMS = ["!", "chr1", "chr2"]


def side(rng, most):
    out = []
    for at in sorted(rng.choice((0, 0, 20, 20, 35, 60, 90)) for _ in range(rng.randint(0, most))):
        mapped = rng.random() < 0.85
        unique = mapped and rng.random() < 0.85
        p, minus = rng.choice((10, 12, 30, 31, 200)), rng.random() < 0.5
        place = {"chrom": rng.choice(CHROMS[1:]), "pos5": p + 19 * minus, "pos3": p + 19 * (not minus), "strand": "-" if minus else "+"} if unique else {}
        out.append(Segment(**place, mapq=9, is_mapped=mapped, is_unique=unique, dist_to_5=at if mapped else 0, dist_to_3=100 - at, algn_read_span=20 if mapped else 0, read_len=120))
    return sorted(out, key=lambda s: s.dist_to_5)


def pooled(sides):
    flat = [x for m in sides for s in m for x in s]
    columns = {c: np.array([getattr(x, c) for x in flat], bool if c.startswith("is_") else np.int64) for c in (*walk_batches.CORE, "dist_to_3") if c not in ("chrom", "minus")}
    columns |= {"chrom": np.array([CHROMS.index(x.chrom) for x in flat], np.int64), "minus": np.array([x.strand == "-" for x in flat], bool)}
    which = np.array([i for m in sides for i, s in enumerate(m) for _ in s])
    return walk_batches.pool(columns), [np.flatnonzero(which == i) for i in (0, 1)], [np.array([len(m[i]) for m in sides]) for i in (0, 1)]


def told(p, out):
    def end(e, i):
        return (CHROMS[e.chrom[i]], e.pos5[i], e.pos3[i], "+-"[int(e.minus[i])], walk_batches.TYPES[e.type[i]], e.side[i], e.idx[i], e.count[i], *[p[c][e.id[i]] for c in ("dist_to_5", "dist_to_3", "algn_read_span", "read_len")])

    return [(m, k, walk_batches.kind_name(c), end(out.one, i), end(out.two, i)) for i, (m, k, c) in enumerate(zip(out.molecule, out.index, out.kind, strict=True))]


def expected(found):
    def end(s):
        return (s.chrom, s.pos5, s.pos3, s.strand, s.type, s.read_side, s.algn_idx, s.same_side_algn_count, s.dist_to_5, s.dist_to_3, s.algn_read_span, s.read_len)

    return [(m, q.index, q.kind, end(q.one), end(q.two)) for m, pairs in enumerate(found) for q in pairs]


@pytest.mark.parametrize("most", [1, 2, 4, 9])
def test_arrays_tell_what_the_rules_tell(most):
    rng = random.Random(most)
    sides = [(side(rng, most), side(rng, most)) for _ in range(400)]
    # reads that show the same junctions from both ends
    for _ in range(100):
        a = [Segment("chr1", 10 * i, 10 * i + 19, "+", 9, True, True, 20 * i, 80, "*", 20, 20, 20, 0, 0, 100) for i in range(rng.randint(1, 5))]
        b = [Segment("chr1", x.pos3 + rng.choice((0, 0, 3)), x.pos5, "-", 9, True, True, 20 * i, 80, "*", 20, 20, 20, 0, 0, 100) for i, x in enumerate(reversed(a[rng.randint(0, len(a) - 1) :]))]
        sides.append((a, b))
    for gap in (20, None):
        for policy in walks.POLICIES:
            p, rows, n = pooled(sides)
            assert told(p, walk_batches.parse(p, rows, n, policy, 150, gap)) == expected([walks.parse_molecule(a, b, policy, 150, gap)[0] for a, b in sides])
        for position in walks.POSITIONS:
            for options in ({}, {"expanded": True}, {"expanded": True, "depth": 2, "orientation": "walk"}, {"single_end": True, "orientation": "junction"}, {"single_end": True, "expanded": True, "depth": 1}):
                p, rows, n = pooled(sides)
                assert told(p, walk_batches.parse_all(p, rows, n, gap, position=position, **options)) == expected([walks.parse_molecule_all(a, b, gap, position=position, **options)[0] for a, b in sides])


def test_depth_bounds_the_work_of_a_long_walk():
    walk = [Segment("chr1", 100 * i, 100 * i + 19, "+", 9, True, True, 20 * i, 0, "*", 20, 20, 20) for i in range(3000)]
    start = time.monotonic()
    p, rows, n = pooled([(walk, [Segment()])])
    out = walk_batches.parse_all(p, rows, n, None, expanded=True, depth=2)
    assert len(out.molecule) == 3000 + 2998 + 2997 and time.monotonic() - start < 5


def test_one_shuffle_and_no_rows_in_python(spark):
    r = spark.range(4).select(F.concat(F.lit("r"), F.floor(F.col("id") / 2).cast("string")).alias("qname"), F.when(F.col("id") % 2 == 0, 64).otherwise(128).alias("flag"), F.lit("chr1").alias("rname"), (F.col("id") + 1).alias("pos"), F.lit(60).alias("mapq"), F.lit("50M").alias("cigar"), F.lit("*").alias("seq"), F.lit("*").alias("qual"), F.array().cast("array<string>").alias("tags"), F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("start"), F.col("id").alias("n")).alias("place"), F.lit("x").alias("record"))
    out = molecules.parse(r, ["chr1"], drop_sam=True)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "MapInArrow" in text and "Pandas" not in text and "ObjectHashAggregate" not in text
    assert out.count() == 2


def test_molecules_span_batches(spark):
    import pyarrow as pa

    names = ["a"] * 3 + ["b"] + ["c"] * 7 + [None] * 2 + ["d"]
    for size in (1, 2, 3, 20):
        batches = [pa.RecordBatch.from_arrays([pa.array(names[i : i + size], pa.string())], ["readID"]) for i in range(0, len(names), size)]
        tables = [t["readID"].to_pylist() for t in molecules._molecules(iter(batches))]
        assert [x for t in tables for x in t] == names and not any(set(x) & set(y) for x, y in zip(tables, tables[1:], strict=False))
