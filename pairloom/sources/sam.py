"""Alignment records: SAM text, and BAM decoded from whole files."""

from __future__ import annotations

import gzip
import io
import re
import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import leading

FIELDS = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags array<string>, record string, place struct<file:string,start:long,n:long>"


def read_sam_header(spark: SparkSession, path: str) -> list[str]:
    """The leading @ lines."""
    return leading(spark, path, lambda line: re.match(r"@[A-Z][A-Z]\t", line) is not None)


def read_sam(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """SAM text as records with typed fields, the tags, the whole line, and its place in the file."""
    paths = [path] if isinstance(path, str) else list(path)
    if any(p.endswith((".cram", ".lz4")) for p in paths):
        raise ValueError("CRAM and LZ4 are not supported")
    text = spark.read.text(paths, lineSep="\n").select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n")).alias("place"))
    f = F.split("value", "\t", -1)
    get = lambda i, kind: F.get(f, F.lit(i)).try_cast(kind)
    names = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
    kinds = ("string", "int", "string", "long", "int", "string", "string", "long", "long", "string", "string")
    body = text.where(~F.col("value").rlike("^@[A-Z][A-Z]\t") & (F.col("value") != ""))
    return body.select(*[get(i, k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))], F.slice(f, 12, 1 << 20).alias("tags"), F.col("value").alias("record"), "place")


#: fixed values of the BAM format
_SEQ, _CIGAR = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_ONE = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def _tags(data: bytes) -> Iterator[str]:
    at = 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            yield f"{name}:A:{chr(data[at])}"
            at += 1
        elif kind in "ZH":
            end = data.index(b"\0", at)
            yield f"{name}:{kind}:{data[at:end].decode()}"
            at = end + 1
        elif kind == "B":
            of, n = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{_ONE[of]}", data, at + 5)
            yield f"{name}:B:{of}," + ",".join(f"{v:g}" if of == "f" else str(v) for v in values)
            at += 5 + n * struct.calcsize(_ONE[of])
        else:
            value = struct.unpack_from("<" + _ONE[kind], data, at)[0]
            yield f"{name}:f:{value:g}" if kind == "f" else f"{name}:i:{value}"
            at += struct.calcsize(_ONE[kind])


def decode_bam(stream: io.BufferedIOBase) -> Iterator[tuple[str, ...] | list[str]]:
    """The header's lines as a list, then a tuple of the eleven fields and the tags for every record."""
    if stream.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    read = lambda n: struct.unpack("<i", stream.read(4))[0] if n is None else stream.read(n)
    yield [line for line in read(read(None)).rstrip(b"\0").decode().split("\n") if line]
    names = []
    for _ in range(read(None)):
        names.append(read(read(None))[:-1].decode())
        read(4)
    ref = lambda i: names[i] if i >= 0 else "*"
    while head := stream.read(4):
        data = stream.read(struct.unpack("<i", head)[0])
        rid, pos, l_name, mapq, _, n_cigar, flag, l_seq, next_id, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
        at = 32
        name = data[at : at + l_name - 1].decode()
        at += l_name
        cigar = "".join(f"{c >> 4}{_CIGAR[c & 15]}" for c in struct.unpack_from(f"<{n_cigar}I", data, at)) or "*"
        at += 4 * n_cigar
        packed = data[at : at + (l_seq + 1) // 2]
        seq = "".join(_SEQ[b >> 4] + _SEQ[b & 15] for b in packed)[:l_seq] or "*"
        at += (l_seq + 1) // 2
        qual = data[at : at + l_seq]
        quality = "*" if not qual or qual[0] == 255 else "".join(chr(q + 33) for q in qual)
        at += l_seq
        mate = "=" if next_id == rid and rid >= 0 else ref(next_id)
        yield (name, str(flag), ref(rid), str(pos + 1), str(mapq), cigar, mate, str(next_pos + 1), str(tlen), seq, quality, *_tags(data[at:]))


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """BAM files as the same records. A file is one task (its blocks can only be read in turn): many files, not many tasks a file, spread the work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows: list[tuple] = []
                for i, r in enumerate(decode_bam(gzip.GzipFile(fileobj=io.BytesIO(content)))):
                    if isinstance(r, list):
                        continue
                    rows.append((r[0], int(r[1]), r[2], int(r[3]), int(r[4]), r[5], r[6], int(r[7]), int(r[8]), r[9], r[10], list(r[11:]), "\t".join(r), {"file": name, "start": 0, "n": i}))
                    if len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=_names())
                        rows = []
                yield pd.DataFrame(rows, columns=_names())

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, FIELDS)


def _names() -> list[str]:
    return [f.strip().split(" ")[0] for f in FIELDS.replace("struct<file:string,start:long,n:long>", "x").split(",")]


def write_sam(lines: DataFrame, path: str, column: str = "line") -> None:
    """SAM lines, as split_sam gives them, as text files."""
    lines.select(F.col(column).alias("value")).write.mode("error").text(path)
