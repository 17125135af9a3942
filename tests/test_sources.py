import gzip
import struct

import pytest
from pyspark.sql import functions as F

from pairloom.operators import order
from pairloom.sources import sam, text
from pairloom.sources.header import Header, HeaderError, merge_chromosomes, merge_headers, program_chains, same_columns, transfer

SIZES = {"chr2": 200, "chr1": 100}


def header():
    return Header.standard(SIZES, "test", ["readID", "chrom1"])


def test_standard_header_reads_back():
    h = Header.parse([*header().render().splitlines(), "r1\tchr1", "#not a header any more"])
    assert h == header() and h.chromsizes == SIZES and h.columns == ["readID", "chrom1"] and not h.is_empty
    assert h.fits("a\tb") and not h.fits("a")


def test_header_changes():
    h = header()
    assert h.mark_sorted().lines[1].startswith("#sorted") and h.mark_sorted().mark_sorted() == h.mark_sorted()
    assert h.subset_chroms(["chr1"]).chromsizes == {"chr1": 100}
    assert h.append_columns(["x"]).columns == ["readID", "chrom1", "x"]
    assert transfer(Header(()), h) == h
    with pytest.raises(HeaderError):
        transfer(h.append_columns(["x"]), h)
    with pytest.raises(HeaderError):
        Header(()).mark_sorted()


def test_programs_form_a_chain():
    h = header().add_program("parse").add_program("sort", "sort x").add_program("dedup")
    chains = program_chains(h.samheader)
    assert [[f.split("\t")[1] for f in c] for c in chains] == [["ID:parse", "ID:sort", "ID:dedup"]]
    assert h.lines[-1].startswith("#columns")
    with pytest.raises(HeaderError):
        program_chains(["@PG\tID:a\tPP:b"])
    with pytest.raises(HeaderError):
        program_chains(["@PG\tID:a\tPP:b", "@PG\tID:b\tPP:a"])


def test_merged_headers():
    a, b = header().with_samheader(["@SQ\tSN:chr1", "@PG\tID:x"]), header().with_samheader(["@SQ\tSN:chr1", "@PG\tID:x"])
    m = merge_headers([a, b])
    assert m.chromsizes == {"chr1": 100, "chr2": 200} and list(m.chromsizes) == ["chr1", "chr2"]
    assert [s for s in m.samheader if s.startswith("@PG")] == ["@PG\tID:x-1", "@PG\tID:x-2"]
    assert len(program_chains(m.add_program("sort").samheader)) == 2 and same_columns([a, b])
    with pytest.raises(HeaderError):
        merge_headers([a, a.with_columns(["z"])])
    with pytest.raises(HeaderError):
        merge_headers([a, b.with_samheader(["@SQ\tSN:chr7"])])
    assert merge_chromosomes(["b", "a"], ["b", "c"], []) == ["a", "b", "c"]
    with pytest.raises(HeaderError):
        merge_chromosomes(["a", "b"], ["b", "a"])


def write(path, content):
    path.write_text(content)
    return str(path)


BODY = "r1\tchr1\t5\tchr2\t7\t+\t-\tUU\nr2\t!\t0\tchr2\t7\t-\t-\tNU\nr3\tchr1\t1\tchr1\t2\t+\t-\n"


def test_text_with_and_without_header(spark, tmp_path):
    plain = text.read_pairs(spark, write(tmp_path / "a.pairs", BODY), ordinal="o")
    assert plain.header.is_empty and [r.readID for r in plain.df.orderBy("o").collect()] == ["r1", "r2", "r3"]
    assert plain.df.where("readID = 'r3'").first().pair_type is None  # fewer fields than columns
    full = text.read_pairs(spark, write(tmp_path / "b.pairs", Header.standard(SIZES).render() + BODY))
    assert full.header.chromsizes == SIZES and full.df.count() == 3 and dict(full.df.dtypes)["pos1"] == "bigint"
    with gzip.open(tmp_path / "c.pairs.gz", "wt") as f:
        f.write(Header.standard(SIZES).render() + BODY)
    assert text.read_pairs(spark, str(tmp_path / "c.pairs.gz")).df.count() == 3
    for bad in ("x.lz4", "x.bam"):
        with pytest.raises(ValueError):
            text.lines(spark, bad)
    with pytest.raises(ValueError):
        text.read_pairs(spark, "x", cmd_in="zcat")


def test_round_trip_in_order(spark, tmp_path):
    table = text.read_pairs(spark, write(tmp_path / "a.pairs", Header.standard(SIZES).render() + BODY))
    table = table.apply(order.sort_pairs, program="sort").with_header(table.header.mark_sorted())
    text.write_pairs(table, str(tmp_path / "parts"))
    again = text.read_parts(spark, str(tmp_path / "parts"))
    assert again.header.is_sorted and sorted(map(tuple, again.df.fillna("").collect())) == sorted(map(tuple, table.df.fillna("").collect()))
    text.write_pairs(table, str(tmp_path / "one"), single=True)
    (part,) = [p for p in (tmp_path / "one").iterdir() if p.name.startswith("part")]
    lines = part.read_text().splitlines()
    assert lines[: len(table.header.lines)] == list(table.header.lines) and [x.split("\t")[0] for x in lines[len(table.header.lines) :]] == ["r2", "r3", "r1"]


def test_small_tables(spark, tmp_path):
    assert text.read_chromsizes(spark, write(tmp_path / "sizes", "chr2\t20\nchr1\t10\n")) == {"chr2": 20, "chr1": 10}
    assert text.chrom_order(["chr2", "chr1"], ["chrB", "chrA", "chr1"]) == {"!": 0, "chr2": 1, "chr1": 2, "chrA": 3, "chrB": 4}
    assert [tuple(r) for r in text.read_bed(spark, write(tmp_path / "bed", "#c\nchr1\t0\t5\n")).collect()] == [("chr1", 0, 5)]
    assert [tuple(r) for r in text.read_regions(spark, write(tmp_path / "view", "chrom\tstart\tend\nchr1\t0\t5\n")).collect()] == [("chr1", 0, 5)]
    assert [tuple(r) for r in text.read_stats(spark, write(tmp_path / "stats", "total\t5\n")).collect()] == [("total", "5")]


def bam(records, names=("chr1", "chr2")):
    head = b"@SQ\tSN:chr1\tLN:100\n"
    out = b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", len(names))
    for n in names:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 100)
    for name, flag, rid, pos, mapq, cigar, seq in records:
        body = struct.pack("<iiBBHHHiiii", rid, pos - 1, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(op)) for n, op in cigar)
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + bytes([30] * len(seq)) + b"NMC\1" + b"MDZ5\0"
        out += struct.pack("<i", len(body)) + body
    return gzip.compress(out)


def test_bam_equals_sam(spark, tmp_path):
    (tmp_path / "a.bam").write_bytes(bam([("r1", 65, 0, 10, 60, [(2, "S"), (3, "M")], "ACGTN"), ("r1", 129, 1, 20, 0, [(5, "M")], "AAAAA")]))
    lines = "@SQ\tSN:chr1\tLN:100\nr1\t65\tchr1\t10\t60\t2S3M\t*\t0\t0\tACGTN\t?????\tNM:i:1\tMD:Z:5\nr1\t129\tchr2\t20\t0\t5M\t*\t0\t0\tAAAAA\t?????\tNM:i:1\tMD:Z:5\n"
    from_text = sam.read_sam(spark, write(tmp_path / "a.sam", lines)).drop("place")
    assert sorted(map(tuple, sam.read_bam(spark, str(tmp_path / "a.bam")).drop("place").collect())) == sorted(map(tuple, from_text.collect()))
    assert sam.read_sam_header(spark, str(tmp_path / "a.sam")) == ["@SQ\tSN:chr1\tLN:100"]


def test_only_leading_lines_are_a_header(spark, tmp_path):
    """A # line further down is a record."""
    body = BODY + "#odd\tchr1\t5\tchr2\t7\t+\t-\tUU\n"
    t = text.read_pairs(spark, write(tmp_path / "a.pairs", Header.standard(SIZES).render() + body))
    assert len(t.header.lines) == len(Header.standard(SIZES).lines) and sorted(r.readID for r in t.df.collect()) == ["#odd", "r1", "r2", "r3"]
    again = text.PairsTable(t.df, t.header)
    text.write_pairs(again, str(tmp_path / "parts"))
    assert text.read_parts(spark, str(tmp_path / "parts")).df.count() == 4
    (tmp_path / "two").mkdir()
    for name, head in (("1", "#command: x\n"), ("2", "#command: y\n")):
        write(tmp_path / "two" / name, Header.standard(SIZES).render() + head + body)
    both = text.read_pairs(spark, str(tmp_path / "two"))
    assert both.df.count() == 8 and both.header.lines[-1] == "#command: x"


def test_a_long_header_is_read_in_a_few_steps(spark, tmp_path):
    sizes = {f"chr{i}": i + 1 for i in range(3000)}
    t = text.read_pairs(spark, write(tmp_path / "a.pairs", Header.standard(sizes).render() + BODY))
    assert t.header.chromsizes == sizes and t.df.count() == 3


def test_a_header_beyond_the_bound_is_refused(spark, tmp_path):
    path = write(tmp_path / "long.pairs", "#a\n#b\n#columns: readID\n")
    assert text.read_header(spark, path, most=3).columns
    with pytest.raises(ValueError):
        text.read_header(spark, path, most=2)


def test_long_tags_are_read_whole(spark):
    from pairloom.operators import molecules
    from pairloom.plans import extra

    r = extra._as_records(spark.createDataFrame([(1, 64, "chr1", 5, 60, "20M", 1)], "k long, flag int, rname string, pos long, mapq int, cigar string, n long"))
    r = r.withColumn("tags", F.array(F.concat(F.lit("MD:Z:"), F.repeat(F.lit("1"), (1 << 20) + 7))))
    assert molecules.alignments(r, tags=["MD"]).select(F.length(F.col("algn.tags")["MD"])).first()[0] == (1 << 20) + 7
