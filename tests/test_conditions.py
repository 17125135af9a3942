import pytest

from pairloom.functions.conditions import ConditionError, compile_condition, select, split_by

ROWS = [
    ("r1", "chr1", 10, "chr1", 200, "+", "-", "UU", 30, 5),
    ("r2", "chr1", 10, "chr2", 20, "+", "+", "UR", 0, 60),
    ("r3", "!", 0, "chrX", 7, "-", "+", "NU", 0, 60),
    ("chr1", "chr10", 5, "chr10", 5, "-", "-", "DD", 10, 10),
]
COLUMNS = ["readID", "chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2", "pair_type", "mapq1", "mapq2"]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


@pytest.mark.parametrize(
    "condition, expected",
    [
        ('pair_type == "UU"', ["r1"]),
        ("chrom1 == chrom2", ["r1", "chr1"]),
        ('(chrom1 == "chr1") and not (pair_type == "UU")', ["r2"]),
        ("abs(pos1 - pos2) >= 100", ["r1"]),
        ("5 <= pos1 < 10", ["chr1"]),
        ('readID == "chr1"', ["chr1"]),  # a column's name inside a literal is a literal
        ("csv_match(pair_type, 'UU,NU')", ["r1", "r3"]),
        ("wildcard_match(chrom2, 'chr?')", ["r1", "r2", "r3"]),
        ("wildcard_match(chrom2, 'chr*0')", ["chr1"]),
        ("regex_match(pair_type, '[UN]U')", ["r1", "r3"]),
        ("regex_match(pair_type, 'U')", []),  # the whole value
        ("region_match(chrom1, pos1, 'chr1', 10)", ["r1", "r2"]),
        ("region_match(chrom2, pos2, 'chr2', 1, 20)", ["r2"]),
        ("region_match(chrom2, pos2, 'chr2', 21, -1)", []),
        ("COLS[1] == '!'", ["r3"]),
        ("pair_type[0] == 'D'", ["chr1"]),
        ("pair_type in ['UR', 'DD']", ["r2", "chr1"]),
        ("'R' in pair_type", ["r2"]),
        ("pair_type not in ('UU', 'DD', 'NU')", ["r2"]),
        ("chrom1.startswith('chr1') and mapq1 > mapq2 / 2", ["r1", "chr1"]),
        ("True", ["r1", "r2", "r3", "chr1"]),
        ("(pos1 if strand1 == '+' else pos2) == 10", ["r1", "r2"]),
        ("max(mapq1, mapq2) % 7 == 4", ["r2", "r3"]),
    ],
)
def test_conditions(pairs, condition, expected):
    assert sorted(r.readID for r in select(pairs, condition).collect()) == sorted(expected)


@pytest.mark.parametrize("condition", ["__import__('os')", "nothing == 1", "pos1 +", "lambda: 1", "pos1", "chrom1 == [x for x in 'a']", "open('x') == 1", "pair_type.format(1) == ''", "COLS[99] == ''", "region_match(chrom1, pos1, 'a', foo=1)", "regex_match(chrom1, '(?P<x>a)')"])
def test_refused(pairs, condition):
    with pytest.raises((ConditionError, TypeError)):
        compile_condition(condition, pairs.columns)


def test_split_conserves_rows_and_nulls_go_to_the_rest(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "readID string, x int")
    hit, rest = split_by(df, "x == 1")
    assert [r.readID for r in hit.collect()] == ["a"] and [r.readID for r in rest.collect()] == ["b"]


def test_casts_and_registered_functions(spark):
    df = spark.createDataFrame([("a", "7"), ("b", "12")], "readID string, x string")
    assert [r.readID for r in select(df, "x < 10", {"x": "int"}).collect()] == ["a"]
    assert [r.readID for r in select(df, "twice(x) == 24", {"x": "int"}, {"twice": lambda c: c * 2}).collect()] == ["b"]
