import pytest

from pairloom.cli import main
from pairloom.sources import text
from pairloom.sources.header import Header

ROWS = [
    ("r1:a:1:1:1:1", "chr1", 10, "chr1", 50, "+", "-", "UU"),
    ("r2:a:1:1:2:1", "chr1", 11, "chr1", 51, "+", "-", "UU"),
    ("r3:a:1:1:1:1", "chr2", 7, "chr1", 9, "-", "-", "UR"),
    ("r4:a:1:1:1:1", "!", 0, "chr2", 9, "-", "-", "NU"),
]
SAM = "@SQ\tSN:chr1\tLN:100\na\t65\tchr1\t10\t60\t20M\t*\t0\t0\t*\t*\na\t129\tchr2\t20\t60\t20M\t*\t0\t0\t*\t*\n"


@pytest.fixture()
def files(tmp_path):
    head = Header.standard({"chr1": 100, "chr2": 100}).render()
    (tmp_path / "a.pairs").write_text(head + "".join("\t".join(map(str, r)) + "\n" for r in ROWS))
    (tmp_path / "sizes").write_text("chr1\t100\nchr2\t100\n")
    (tmp_path / "frags").write_text("chr1\t0\t20\nchr1\t20\t100\nchr2\t0\t100\n")
    (tmp_path / "a.sam").write_text(SAM)
    return tmp_path


def run(spark, files, *argv):
    out = str(files / f"out{len(list(files.iterdir()))}")
    main([str(files / a[1:]) if a.startswith("@") else a for a in argv] + ["-o", out], spark)
    return out


def ids(spark, path):
    return [r.readID[:2] for r in text.read_parts(spark, path).df.collect()]


def test_commands(spark, files):
    out = run(spark, files, "select", "chrom1 == chrom2", "@a.pairs", "--output-rest", "@rest")
    assert ids(spark, out) == ["r1", "r2"] and sorted(ids(spark, str(files / "rest"))) == ["r3", "r4"]
    assert ids(spark, run(spark, files, "sort", "@a.pairs")) == ["r4", "r1", "r2", "r3"]
    assert len(ids(spark, run(spark, files, "merge", "@a.pairs", "@a.pairs"))) == 8
    flipped = text.read_parts(spark, run(spark, files, "flip", "@a.pairs", "-c", "@sizes")).df.where("readID like 'r3%'").first()
    assert (flipped.chrom1, flipped.pair_type) == ("chr1", "RU")
    out = run(spark, files, "dedup", "@a.pairs", "--output-dups", "@dups", "--output-unmapped", "@unmapped", "--output-stats", "@dstats", "--output-bytile-stats", "@tiles", "--mark-dups")
    assert sorted(ids(spark, out)) == ["r1", "r3"] and ids(spark, str(files / "dups")) == ["r2"] and ids(spark, str(files / "unmapped")) == ["r4"]
    assert {r.key: r.value for r in text.read_stats(spark, str(files / "dstats")).collect()}["total_dups"] == "1"
    annotated = text.read_parts(spark, run(spark, files, "restrict", "@a.pairs", "-f", "@frags")).df.where("readID like 'r1%'").first()
    assert (annotated.rfrag1, annotated.rfrag2) == (0, 1)
    assert sorted(ids(spark, run(spark, files, "filterbycov", "@a.pairs", "--max-cov", "2", "--max-dist", "1"))) == ["r2", "r3"]
    one = run(spark, files, "stats", "@a.pairs")
    both = run(spark, files, "stats", "--merge", one, one)
    assert {r.key: r.value for r in text.read_stats(spark, both).collect()}["total"] == "8"
    for argv in (["markasdup", "@a.pairs"], ["split", "@a.pairs"], ["sample", "0.5", "@a.pairs"], ["scaling", "@a.pairs"], ["header", "@a.pairs", "validate-columns"], ["stats", "@a.pairs", "--yaml", "--filter", "near:abs(pos1 - pos2) < 50"]):
        run(spark, files, *argv)


def test_parsing_commands(spark, files):
    for name in ("parse", "parse2"):
        out = run(spark, files, name, "@a.sam", "-c", "@sizes", "--drop-sam", "--output-stats", f"@{name}-stats")
        table = text.read_parts(spark, out)
        assert [tuple(r) for r in table.df.collect()] == [("a", "chr1", 10, "chr2", 20, "+", "+", "UU")]
        assert "@SQ\tSN:chr1\tLN:100" in table.header.samheader


def keyed(spark, path):
    return {r.key: r.value for r in text.read_stats(spark, path).collect()}


def test_options_of_statistics(spark, files):
    one = keyed(spark, run(spark, files, "stats", "@a.pairs", "--n-dist-bins-decade", "2"))
    assert one["chromsizes/chr1"] == "100" and sum(k.startswith("dist_freq/") for k in one) == 4 * len({0, *(round(10 ** (k / 2)) for k in range(19))})
    out = run(spark, files, "stats", "@a.pairs", "--no-with-chromsizes")
    assert not any(k.startswith("chromsizes") for k in keyed(spark, out))
    with_sizes = run(spark, files, "stats", "@a.pairs")
    assert keyed(spark, run(spark, files, "stats", "--merge", out, with_sizes))["chromsizes/chr1"] == "100"
    (files / "other").write_text("total\t1\nchromsizes/chr1\t7\n")
    with pytest.raises(ValueError):
        run(spark, files, "stats", "--merge", with_sizes, "@other")
    run(spark, files, "filterbycov", "@a.pairs", "--max-cov", "2", "--max-dist", "1", "--output-stats", "@cov")
    assert keyed(spark, str(files / "cov"))["total"] == "4" and keyed(spark, str(files / "cov"))["total_dups"] == "1"


def test_dedup_with_columns_of_other_names(spark, files):
    names = ["readID", "chr1", "p1", "chr2", "p2", "str1", "str2", "pair_type"]
    body = "".join("\t".join(map(str, r)).replace("!", "none") + "\n" for r in ROWS)
    (files / "b.pairs").write_text(Header.standard({"chr1": 100}, columns=names).render() + body)
    given = ["--c1", "chr1", "--c2", "chr2", "--p1", "p1", "--p2", "p2", "--s1", "str1", "--s2", "str2", "--unmapped-chrom", "none"]
    out = run(spark, files, "dedup", "@b.pairs", *given, "--output-dups", "@dups", "--output-unmapped", "@un", "--output-stats", "@st", "--output-bytile-stats", "@ti", "--filter", "near:abs(pos1 - pos2) < 5", "--yaml")
    table = text.read_parts(spark, out)
    assert table.df.columns == names and sorted(ids(spark, out)) == ["r1", "r3"] and ids(spark, str(files / "dups")) == ["r2"] and ids(spark, str(files / "un")) == ["r4"]
    tree = text.parse_yaml("\n".join(r.value for r in spark.read.text(str(files / "st")).collect()))
    assert tree["no_filter"]["total_dups"] == 1 and tree["near"]["total"] == 1 and tree["no_filter"]["dups_by_tile_median"] == 1 and "complexity_dups_by_tile_median" in tree["no_filter"]["summary"]


def test_names_are_transformed(spark, files):
    lines = SAM.replace("\na\t65", "\na/1\t65").replace("\na\t129", "\na/2\t129")
    (files / "b.sam").write_text(lines)
    out = run(spark, files, "parse", "@b.sam", "-c", "@sizes", "--drop-sam", "--readid-transform", "readID[:-2] + '_x'")
    assert [r.readID for r in text.read_parts(spark, out).df.collect()] == ["a_x"]
    assert len(ids(spark, run(spark, files, "parse", "@b.sam", "-c", "@sizes", "--drop-sam", "--readid-transform", "readID.split('/')[0]"))) == 1
    with pytest.raises(ValueError):
        run(spark, files, "parse", "@b.sam", "-c", "@sizes", "--readid-transform", "readID + str(i)")


@pytest.mark.parametrize("argv", [["select", "nothing == 1", "x", "-o", "y"], ["sort", "x", "--nproc", "8", "-o", "y"], ["nonsense"]])
def test_refused(spark, argv, files):
    with pytest.raises((SystemExit, Exception)):
        main(argv, spark)
