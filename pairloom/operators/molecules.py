"""From alignment records to pairs.

Records become typed alignments by built-in functions (uniqueness, tags, mismatches). Records of one
name form a molecule (dealt out by name and sorted once, so they need not be neighbours). Sorted rows go as Arrow batches through
the walk rules, which work on whole arrays; only columns that are asked for are sent. There a batch's different CIGARs are
measured once each, and ends and the order on the read follow from that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conditions import compile_value
from ..schema import RECORD_SEP, SAM_SEP
from . import walk_batches, walks

ALIGNMENT = (
    "struct<dist_to_5:int,query_start:int,n:struct<file:string,start:long,n:long>,chrom:string,pos5:long,pos3:long,strand:string,mapq:int,is_mapped:boolean,is_unique:boolean,"
    "dist_to_3:int,cigar:string,algn_ref_span:int,algn_read_span:int,matched_bp:int,clip3_ref:int,clip5_ref:int,read_len:int,mismatches:string,seq:string,tags:map<string,string>,record:string>"
)
COLUMNS = ("mapq", "pos5", "pos3", "cigar", "read_len", "matched_bp", "algn_ref_span", "algn_read_span", "dist_to_5", "dist_to_3", "mismatches", "seq", "read_side", "algn_idx", "same_side_algn_count")
NUMBERS = {"mapq", "pos5", "pos3", "read_len", "matched_bp", "algn_ref_span", "algn_read_span", "dist_to_5", "dist_to_3", "read_side", "algn_idx", "same_side_algn_count"}
#: what a pair's end has of its own, not its alignment
PLACES = {"pos5": "pos5", "pos3": "pos3", "read_side": "side", "algn_idx": "idx", "same_side_algn_count": "count"}


METRICS = ("matched_bp", "algn_ref_span", "algn_read_span", "read_len", "clip5_ref", "clip3_ref", "query_start")


@lru_cache(maxsize=1 << 15)
def cigar_numbers(cigar: str) -> tuple[int, ...]:
    """METRICS of one CIGAR, as cigar_metrics tells them."""
    matched = ref = read = length = clip5 = clip3 = start = 0
    for k, op in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar):
        k = int(k)
        if op == "M":
            matched, ref, read, length = matched + k, ref + k, read + k, length + k
        elif op == "D":
            ref += k
        elif op == "I":
            read, length = read + k, length + k
        elif op in "SH":
            if op == "S" and read == 0:
                start += k
            if matched == 0:
                clip5 = k
            else:
                clip3 = k
            length += k
    return matched, ref, read, length, clip5, clip3, start


def measured(rows: pa.Table) -> dict[str, np.ndarray]:
    """METRICS, both ends and their distances, and truths of rows(cigar, pos, turned, is_mapped, is_unique), as alignments tells them."""
    codes = pc.dictionary_encode(pc.fill_null(rows["cigar"].combine_chunks(), "*"))
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    each = np.array([cigar_numbers(c) for c in codes.dictionary.to_pylist()], np.int64).reshape(-1, len(METRICS))[codes.indices.to_numpy()]
    out = {c: each[:, i] for i, c in enumerate(METRICS)}
    mapped, unique, turned = (pc.fill_null(rows[c], False).to_numpy().astype(bool) for c in ("is_mapped", "is_unique", "turned"))
    first = pc.fill_null(rows["pos"], 0).to_numpy().astype(np.int64)
    last = first - 1 + out["algn_ref_span"]
    either = lambda truth, a, b: np.where(truth, np.where(turned, b, a), 0)
    out |= {"pos5": either(unique, first, last), "pos3": either(unique, last, first), "dist_to_5": either(mapped, out["clip5_ref"], out["clip3_ref"]), "dist_to_3": either(mapped, out["clip3_ref"], out["clip5_ref"])}
    return out | {"is_mapped": mapped, "is_unique": unique, "minus": ~unique | turned}


def cigar_metrics(cigar: Column) -> Column:
    """struct<matched_bp, algn_ref_span, algn_read_span, read_len, clip5_ref, clip3_ref, query_start>.

    M counts for all, I for the read, D for the reference, S and H for the read's length and the clip before or after the
    first match; other operations are ignored.
    """
    n, op = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1)), F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    names = ("matched_bp", "algn_ref_span", "algn_read_span", "read_len", "clip5_ref", "clip3_ref", "query_start")
    zero = F.struct(*[F.lit(0).alias(c) for c in names])

    def add(s: Column, x: Column) -> Column:
        k, o = x["n"].cast("int"), x["o"]
        is_ = lambda letters: o.isin(list(letters))
        plus = lambda c, letters: (s[c] + F.when(is_(letters), k).otherwise(0)).alias(c)
        clip, before = is_("SH"), s["matched_bp"] == 0
        lead = (s["algn_read_span"] == 0) & (o == "S")
        return F.struct(
            plus("matched_bp", "M"),
            plus("algn_ref_span", "MD"),
            plus("algn_read_span", "MI"),
            plus("read_len", "MISH"),
            F.when(clip & before, k).otherwise(s["clip5_ref"]).alias("clip5_ref"),
            F.when(clip & ~before, k).otherwise(s["clip3_ref"]).alias("clip3_ref"),
            (s["query_start"] + F.when(lead, k).otherwise(0)).alias("query_start"),
        )

    return F.aggregate(F.arrays_zip(n.alias("n"), op.alias("o")), zero, add)


def _mismatches(cigar: pd.Series, seq: pd.Series, qual: pd.Series, md: pd.Series, pos: pd.Series) -> pd.Series:
    """ref:read:phred:reference position:read position of every mismatch, from the MD tag; positions from 0."""
    out = []
    for c, s, q, m, start in zip(cigar, seq, qual, md, pos, strict=True):
        if not m or not s or s == "*":
            out.append("")
            continue
        places, read, ref = [], 0, start - 1
        for k, op in re.findall(r"(\d+)([MIDNSHP=X])", c):
            k = int(k)
            if op in "M=X":
                places += zip(range(read, read + k), range(ref, ref + k), strict=True)
            read += k if op in "MIS=X" else 0
            ref += k if op in "MDN=X" else 0
        found, at = [], 0
        for run, deleted, base in re.findall(r"(\d+)|(\^[A-Za-z]+)|([A-Za-z])", m):
            if run:
                at += int(run)
            elif base:
                r, g = places[at]
                phred = ord(q[r]) - 33 if q and q != "*" else 0
                found.append(f"{base.upper()}:{s[r].upper()}:{phred}:{g}:{r}")
                at += 1
        out.append(",".join(found))
    return pd.Series(out)


def alignments(records: DataFrame, min_mapq: int = 1, tags: Sequence[str] = (), store_seq: bool = False, mismatches: bool = False, readid: Column | str | None = None, sums: bool = True) -> DataFrame:
    """records -> (readID, side, algn, pos, turned): typed alignments; pos and turned are the record's. sums: False leaves what a CIGAR tells to measured. readid: what becomes of a name, as a column or an expression in readID."""
    flag = lambda bit: F.col("flag").bitwiseAND(F.lit(bit)) != 0
    t = records.withColumn("m", cigar_metrics(F.coalesce("cigar", F.lit("*"))) if sums else F.lit(None).cast("struct<" + ",".join(f"{c}:int" for c in METRICS) + ">"))
    mapped = ~flag(4)
    unique = mapped & (F.col("mapq") >= min_mapq)
    minus = flag(16)
    first, last = F.col("pos"), F.col("pos") - 1 + F.col("m.algn_ref_span")

    def tag_value(name: str) -> Column:
        found = F.transform(F.filter("tags", lambda x: x.startswith(name + ":")), lambda x: F.substring(x, F.lit(6), F.length(x)))
        return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))

    kept = F.create_map(*[x for name in tags for x in (F.lit(name), tag_value(name))]) if tags else F.create_map().cast("map<string,string>")
    where_ = lambda a, b: F.when(~unique, F.lit(0)).when(minus, b).otherwise(a).cast("long")
    dist = lambda a, b: F.when(~mapped, F.lit(0)).when(minus, b).otherwise(a)
    md = tag_value("MD")
    algn = F.struct(
        dist(F.col("m.clip5_ref"), F.col("m.clip3_ref")).alias("dist_to_5"),
        F.col("m.query_start").alias("query_start"),
        F.col("place").alias("n"),
        F.when(unique, F.col("rname")).otherwise("!").alias("chrom"),
        where_(first, last).alias("pos5"),
        where_(last, first).alias("pos3"),
        F.when(~unique | minus, "-").otherwise("+").alias("strand"),
        F.col("mapq"),
        mapped.alias("is_mapped"),
        unique.alias("is_unique"),
        dist(F.col("m.clip3_ref"), F.col("m.clip5_ref")).alias("dist_to_3"),
        F.col("cigar"),
        F.col("m.algn_ref_span").alias("algn_ref_span"),
        F.col("m.algn_read_span").alias("algn_read_span"),
        F.col("m.matched_bp").alias("matched_bp"),
        F.col("m.clip3_ref").alias("clip3_ref"),
        F.col("m.clip5_ref").alias("clip5_ref"),
        F.col("m.read_len").alias("read_len"),
        (F.when(unique, F.pandas_udf(_mismatches, T.StringType())("cigar", "seq", "qual", md, "pos")).otherwise("") if mismatches else F.lit("")).alias("mismatches"),
        (F.col("seq") if store_seq else F.lit("")).alias("seq"),
        kept.alias("tags"),
        F.col("record").alias("record"),
    )
    if isinstance(readid, str):
        renamed = t.withColumn("readID", F.col("qname"))
        t, name = renamed, compile_value(readid, ["readID"])
    else:
        name = F.col("qname") if readid is None else readid
    return t.select(name.alias("readID"), F.when(flag(0x40), 1).otherwise(2).alias("side"), algn.alias("algn"), "pos", minus.alias("turned"))


def grouped(algns: DataFrame) -> DataFrame:
    """(readID, a, b): each side's alignments from 5' to 3', ties in the order on the read, then of the file."""

    def order(x: Column, y: Column) -> Column:
        place = lambda s: F.struct(s["dist_to_5"], s["query_start"], s["n"])
        return F.when(place(x) < place(y), -1).when(place(x) > place(y), 1).otherwise(0)

    by = lambda i: F.array_sort(F.collect_list(F.when(F.col("side") == i, F.col("algn"))), order).alias("ab"[i - 1])
    return algns.groupBy("readID").agg(by(1), by(2))


def _output_type(drop_sam: bool, columns: Sequence[str], index: bool) -> str:
    out = "readID string, chrom1 string, pos1 long, chrom2 string, pos2 long, strand1 string, strand2 string, pair_type string"
    if not drop_sam:
        out += ", sam1 string, sam2 string"
    if index:
        out += ", walk_pair_index int, walk_pair_type string"
    for c in columns:
        for i in (1, 2):
            out += f", `{c}{i}` " + ("long" if c in NUMBERS else "string")
    return out


def _records_text(record: pa.Array, rows: np.ndarray, n: np.ndarray, kind: pa.Array, drop_seq: bool) -> pa.Array:
    """SAM columns: for each pair the records of n rows, each with the pair's type."""
    each = record.take(pa.array(rows))
    if drop_seq:
        each = pc.replace_substring_regex(each, r"^((?:[^\t]*\t){9})[^\t]*\t[^\t]*", "\\1*\t*")
    each = pc.binary_join_element_wise(pc.replace_substring(each, "\t", SAM_SEP), pc.binary_join_element_wise("Yt:Z:", kind.take(pa.array(np.repeat(np.arange(len(n)), n))), ""), SAM_SEP)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), each), RECORD_SEP)


def _molecules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by readID in tables that hold whole molecules."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.run_end_encode(batch["readID"]).run_ends.to_numpy()
        cut = int(ends[-2]) if len(ends) > 1 else 0
        if cut or held and held[-1]["readID"][-1] != batch["readID"][0]:
            yield pa.Table.from_batches([*held, *([batch.slice(0, cut)] if cut else [])]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def parse(
    records: DataFrame,
    chroms: Sequence[str],
    walks_policy: str = "5unique",
    min_mapq: int = 1,
    max_molecule_size: int = 750,
    max_inter_align_gap: int = 20,
    report_alignment_end: str = "5",
    flip: bool = True,
    drop_readid: bool = False,
    drop_seq: bool = False,
    drop_sam: bool = False,
    add_pair_index: bool = False,
    add_columns: Sequence[str] = (),
    readid: Column | str | None = None,
    mode: str = "parse",
    **more,
) -> DataFrame:
    """records (as read_sam gives them) -> pairs.

    chroms: names in the order that decides flipping. mode ``parse`` follows a walk policy; ``parse2`` reports all pairs of a
    walk, with the options of walks.parse_molecule_all in ``more`` (max_insert, position, orientation, slack, single_end,
    expanded, depth). add_columns: names of COLUMNS or SAM tags (two capitals), one column per side.
    """
    if report_alignment_end not in ("5", "3"):
        raise ValueError("report_alignment_end must be 5 or 3")
    if walks_policy not in walks.POLICIES:
        raise ValueError(f"unknown walk policy: {walks_policy}")
    tags = [c for c in add_columns if c not in COLUMNS]
    if any(not (len(t) == 2 and t.isupper() and t.isalnum()) for t in tags):
        raise ValueError(f"unknown columns: {tags}")
    if mode not in ("parse", "parse2"):
        raise ValueError("mode must be parse or parse2")
    algns = alignments(records, min_mapq, tags, "seq" in add_columns, "mismatches" in add_columns, readid, sums=False)
    ranks = {c: i for i, c in enumerate(chroms)}
    schema = _output_type(drop_sam, add_columns, add_pair_index)
    end = "pos5" if report_alignment_end == "5" else "pos3"
    own = [c for c in add_columns if c in METRICS]
    shipped = {c: F.col(f"algn.{c}") for c in ("chrom", "cigar", "is_mapped", "is_unique")} | {c: F.col(c) for c in ("pos", "turned")}
    shipped |= {c: F.col(f"algn.{c}") for c in add_columns if c in COLUMNS and c not in PLACES and c not in METRICS and not c.startswith("dist_to_")}
    shipped |= {f"tag_{t}": F.coalesce(F.try_element_at(F.col("algn.tags"), F.lit(t)), F.lit("")) for t in tags} | ({} if drop_sam else {"record": F.col("algn.record")})
    carried = [c for c in shipped if c not in ("pos", "turned", "is_mapped", "is_unique") and (c != "cigar" or c in add_columns)]
    names = [c.strip("`") for c in (x.rsplit(" ", 1)[0] for x in schema.split(", "))]

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        given = {c: rows[c].combine_chunks() if isinstance(rows[c], pa.ChunkedArray) else rows[c] for c in rows.column_names}
        first = np.concatenate([[0], pc.run_end_encode(given["readID"]).run_ends.to_numpy()]).astype(np.int64)
        side, told = given["side"].to_numpy(), measured(rows)
        molecule = np.repeat(np.arange(len(first) - 1), np.diff(first))
        by = np.lexsort((told["query_start"], told["dist_to_5"], side, molecule))  # stable: ties stay in the order of the file
        side, told = side[by], {c: x[by] for c, x in told.items()}
        given |= {c: given[c].take(pa.array(by)) for c in carried}
        n = [np.add.reduceat((side == i).astype(np.int64), first[:-1]) for i in (1, 2)]
        code = pc.dictionary_encode(given["chrom"])
        found = code.dictionary.to_pylist()
        known = {c: i for i, c in enumerate(["!", *[c for c in found if c != "!"]])}
        core = {c: told[c] for c in (*walk_batches.CORE, "dist_to_3", *own) if c != "chrom"}
        core["chrom"] = np.array([known[c] for c in found], np.int64)[code.indices.to_numpy()]
        p = walk_batches.pool(core)
        of_side = [np.flatnonzero(side == i) for i in (1, 2)]
        if mode == "parse":
            out = walk_batches.parse(p, of_side, n, walks_policy, max_molecule_size, max_inter_align_gap)
        else:
            out = walk_batches.parse_all(p, of_side, n, max_inter_align_gap, **more)
        one, two, swap = out.one, out.two, np.zeros(len(out.molecule), bool)
        if flip:  # by place if both sides have one, else the better mapped side comes second
            rank = np.array([ranks.get(c, -1) for c in known], np.int64)
            x, y = ((rank[e.chrom], getattr(e, end), e.chrom != walk_batches.UNPLACED, p["is_mapped"][e.id] * 2 + p["is_unique"][e.id]) for e in (one, two))
            swap = np.where(x[2] & y[2], (x[0] > y[0]) | (x[0] == y[0]) & (x[1] > y[1]), x[3] > y[3])
            one, two = walk_batches.where(swap, two, one), walk_batches.where(swap, one, two)
        chrom, types = pa.array(list(known)), pa.array(walk_batches.TYPES)
        text = lambda e: types.take(pa.array(e.type))
        kind = pc.binary_join_element_wise(text(one), text(two), "")
        name = pa.repeat(".", len(swap)) if drop_readid else given["readID"].take(pa.array(first[out.molecule]))
        strand = lambda e: pa.array(["+", "-"]).take(pa.array(e.minus.astype(np.int8)))
        columns = [name, chrom.take(pa.array(one.chrom)), getattr(one, end), chrom.take(pa.array(two.chrom)), getattr(two, end), strand(one), strand(two), kind]
        if not drop_sam:  # in a molecule with several pairs the SAM columns change sides with every pair that is flipped, and stay so
            turns = np.cumsum(swap)
            odd = (turns - (turns - swap)[np.searchsorted(out.molecule, out.molecule)]) % 2
            start, size = (first[:-1][out.molecule], (first[:-1] + n[0])[out.molecule]), (n[0][out.molecule], n[1][out.molecule])
            for i in (0, 1):
                at, count = (np.where(odd == i, *x) for x in (start, size))
                columns.append(_records_text(given["record"], np.repeat(at, count) + walk_batches.running(count), count, kind, drop_seq))
        if add_pair_index:
            codes, which = np.unique(out.kind, return_inverse=True)
            columns += [out.index, pa.array([walk_batches.kind_name(int(c)) for c in codes], pa.string()).take(pa.array(which))]
        for c in add_columns:
            for e in (one, two):
                if c in PLACES:
                    columns.append(getattr(e, PLACES[c]))
                elif c in p.columns:
                    columns.append(p[c][e.id])
                else:
                    column = given[c if c in COLUMNS else f"tag_{c}"]
                    null = pa.array([{"cigar": "*"}.get(c, 0 if c in NUMBERS else "")], column.type)
                    columns.append(pa.concat_arrays([column, null]).take(pa.array(np.minimum(e.id, p.null))))
        return pa.RecordBatch.from_arrays([(x if isinstance(x, pa.Array) else pa.array(x)).cast(kinds[c]) for c, x in zip(names, columns, strict=True)], names)

    kinds = {c: {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[x.rsplit(" ", 1)[1]] for c, x in zip(names, schema.split(", "), strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(pairs, _molecules(batches))

    flat = algns.select("readID", "side", *[x.alias(c) for c, x in shipped.items()], F.col("algn.n").alias("n"))
    ordered = flat.repartition("readID").sortWithinPartitions("readID", "side", "n")
    return ordered.drop("n").mapInArrow(run, schema)


def parsed_alignments(records: DataFrame, min_mapq: int = 1) -> DataFrame:
    """(readID, side, line): one line per read side with eight fields per alignment, from 5' to 3'."""
    long = grouped(alignments(records, min_mapq)).select("readID", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("a").alias("x")), F.struct(F.lit(2).alias("side"), F.col("b").alias("x")))).alias("s"))
    cell = lambda a: F.concat_ws("\t", a["chrom"], a["pos5"].cast("string"), a["strand"], a["mapq"].cast("string"), a["cigar"], a["dist_to_5"].cast("string"), (a["dist_to_5"] + a["algn_read_span"]).cast("string"), a["matched_bp"].cast("string"))
    return long.select("readID", F.col("s.side").alias("side"), F.concat_ws("\t", "readID", F.col("s.side").cast("string"), F.array_join(F.transform("s.x", cell), "\t")).alias("line"))
