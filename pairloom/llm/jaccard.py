"""N-gram Jaccard join by parity sketches (exact: no linked pair of different texts is lost).

A document is its set of distinct k-word shingles. Two documents link when den * |A and B| >= num * |A or B|, so their
symmetric difference is at most d = (den - num) * (|A| + |B|) / (den + num).

Sketch: every shingle flips one bit of a long bit string that is cut into parts; the part a shingle falls in is given by the high
bits of its hash, its bit there by the whole hash. As each shingle of the symmetric difference flips one
bit, the Hamming distance of two sketches is at most that difference. Two uses are made of this:

* Pigeonhole join. Sizes form bands, a factor of ``RATIO`` apart; for every band sketches have
  ``parts = d_max + 1 + spare`` parts, so linked documents agree on 1 + spare parts at least. Documents join on
  (band, part number, bits of the part), the bits standing as the XOR of their positions' hashes. A document takes part
  in its own band and in higher ones that a partner could lie in. As a partner agrees on parts - d of its parts
  at least, a document leaves out its parts - d - 1 emptiest ones, which agree by chance or by a common line (d by its
  own size here): in the one order of fullness and key that all follow, the last part that two linked documents share
  is left out by neither.
* Hamming test. A folded sketch of 512 bits stays with every document; candidate pairs whose distance
  exceeds d go before any text is read.

Candidates are verified on the sets of whole texts. Only connectivity is needed, so a part shared by many documents is not
expanded into pairs: all are compared with the part's most central document, the one whose parts are shared most (the original among its
edited copies), and the components so far are formed. Parts that still hold several components are then
compared in full: their documents are dealt into blocks of about ``BLOCK``, and for every two blocks a task applies the Hamming test to all
pairs of different components and lets only those pass that meet it. Documents with equal sets are one node from
the start; a task emits the parts of equal sets once.

Defined cases: null and empty texts, and texts of white space, have an empty set and link with nothing; very long texts are read whole; parts that are shared equally often
are ordered by key; an empty table gives an empty result; a null id
is never linked (component null); rows that repeat an id and text are copies of each other; other columns
are ignored. Nodes are 64-bit fingerprints of sets: among n different sets, n * n / 2**65 pairs
are mistaken for copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .components import components
from .store import cut, light_batches

RATIO = 1.4
SPARE = 0.05
FOLD = 8  # words of 64 bits
SMALL_SIDE = 1_000_000
SEEN = 1 << 18
BLOCK = 1024
_U = np.uint64


def band_edges() -> np.ndarray:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * RATIO)))
    return np.array(edges, np.int64)


EDGES = band_edges()


def max_difference(a, b, num: int, den: int):
    """Largest symmetric difference of linked sets of these sizes."""
    return (den - num) * (a + b) // (den + num)


def sets_of(texts: list, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    words, offsets = T.word_hashes(texts)
    values, at = T.shingles(words, offsets, k)
    for i in range(len(texts)):
        s = np.sort(values[at[i] : at[i + 1]])
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s)
    return out


def fingerprint(s: np.ndarray) -> int:
    return int(T.signed(T.mix64(np.array([T.mix64(s + _U(77)).sum(dtype=_U) + _U(len(s))], _U)))[0])


def folded(s: np.ndarray) -> np.ndarray:
    """The 512-bit parity sketch as 8 words."""
    odd = np.bincount((s & _U(64 * FOLD - 1)).astype(np.int64), minlength=64 * FOLD).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def part_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Join keys of one set: a hash of (band, part number, bits) for every part that is not left out."""
    n, out = len(s), []
    for band in range(int(np.searchsorted(EDGES, n, side="right")) - 1, len(EDGES) - 1):
        if n * den < num * EDGES[band]:
            break
        top = int(EDGES[band + 1]) - 1
        most = max_difference(top, top, num, den)
        if not most:  # only equal sets link
            continue
        parts = most + 1 + int(np.ceil(SPARE * (most + 1)))
        if parts >= 1 << 31:
            raise ValueError("a document has over 10**9 words")
        part = ((s >> _U(32)) * _U(parts)) >> _U(32)
        edge = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
        bits = np.bitwise_xor.reduceat(T.mix64(s ^ _U(0xA5A5A5A5)), edge)
        count = np.diff(np.concatenate((edge, [n])))
        number = part[edge]
        drop = parts - max_difference(n, min(top, n * den // num), num, den) - 1
        if drop < parts - len(edge):
            missing = np.setdiff1d(np.arange(parts, dtype=_U), number)
            number, bits, count = np.concatenate((number, missing)), np.concatenate((bits, np.zeros(len(missing), _U))), np.concatenate((count, np.zeros(len(missing), np.int64)))
        else:
            drop -= parts - len(edge)
        key = T.mix64(bits ^ T.mix64(number + (_U(band + 1) << _U(40))))
        out.append(key[np.lexsort((key, count))[drop:]] if drop > 0 else key)
    return np.concatenate(out) if out else np.zeros(0, _U)


FOLDS = [f"s{i}" for i in range(FOLD)]


def nodes_of(docs: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, f, s0..s7): size of the set, its fingerprint, folded sketch."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in T.chunks(batch, text):
                sets = sets_of(part[text].tolist(), k)
                out = pd.DataFrame({"id": part[key], "n": [len(s) for s in sets], "f": [fingerprint(s) for s in sets]})
                out[FOLDS] = np.stack([folded(s) for s in sets])
                yield out

    return docs.select(key, text).mapInPandas(run, f"id {kind}, n long, f long, " + ", ".join(f"{c} long" for c in FOLDS))


def _parts(docs: DataFrame, k: int, num: int, den: int, text: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.arange(1, SEEN + 1)  # the last fingerprint of each slot, at first one of another slot; what it misses costs repeated rows, no more
        for batch in batches:
            for part in T.chunks(batch, text):
                keys, owners = [], []
                for s in sets_of(part[text].tolist(), k):
                    f = fingerprint(s)
                    if not len(s) or seen[f % SEEN] == f:
                        continue
                    seen[f % SEEN] = f
                    keys.append(part_keys(s, num, den))
                    owners.append(np.full(len(keys[-1]), f, np.int64))
                if keys:
                    yield pd.DataFrame({"key": T.signed(np.concatenate(keys)), "f": np.concatenate(owners)})

    return docs.select(text).where(F.col(text).isNotNull()).mapInPandas(run, "key long, f long")


def _sets(docs: DataFrame, k: int, text: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in T.chunks(batch, text):
                sets = sets_of(part[text].tolist(), k)
                yield pd.DataFrame({"f": [fingerprint(s) for s in sets], "shingles": [s.tobytes() for s in sets]})

    return docs.select(text).mapInPandas(run, "f long, shingles binary")


def _linked(num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch["x"], batch["y"], strict=True)):
                a, b = np.frombuffer(x, _U), np.frombuffer(y, _U)
                small, large = (a, b) if len(a) <= len(b) else (b, a)
                common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum()) if len(small) else 0
                keep[i] = den * common >= num * (len(a) + len(b) - common) and len(small) > 0
            yield batch.loc[keep, ["a", "b"]]

    return run


def _near_pairs(x: dict, y: dict | None, num: int, den: int) -> tuple[list, list]:
    """Hamming test between two blocks of a part's documents, or within one: pairs of different components that may link."""
    a, b = [], []
    other = x if y is None else y
    for i in range(len(x["f"])):
        lo = i + 1 if y is None else 0
        n, m = x["n"][i], other["n"][lo:]
        at = np.flatnonzero((other["c"][lo:] != x["c"][i]) & (np.minimum(n, m) * den >= np.maximum(n, m) * num))
        if len(at):
            at = at[np.bitwise_count(other["s"][lo:][at] ^ x["s"][i]).sum(1) <= max_difference(n, m[at], num, den)]
        if len(at):
            found = other["f"][lo:][at]
            a.append(np.minimum(x["f"][i], found))
            b.append(np.maximum(x["f"][i], found))
    return a, b


def _compared(num: int, den: int):
    """Rows sorted by key, i, j, side: each (key, i, j) is a pair of blocks, or one block if i = j."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def compare(rows: pd.DataFrame) -> pd.DataFrame:
            v = {c: rows[c].to_numpy() for c in ("key", "i", "j", "side", "f", "c", "n")} | {"s": np.ascontiguousarray(rows[FOLDS].to_numpy(np.int64)).view(np.uint64)}  # counts of bits want unsigned numbers
            new = np.ones(len(rows), bool)
            new[1:] = (v["key"][1:] != v["key"][:-1]) | (v["i"][1:] != v["i"][:-1]) | (v["j"][1:] != v["j"][:-1])
            edge = np.append(np.flatnonzero(new), len(rows))
            a, b = [], []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                part = lambda p, q: {c: v[c][p:q] for c in ("f", "c", "n", "s")}
                if v["i"][lo] == v["j"][lo]:
                    found = _near_pairs(part(lo, hi), None, num, den) if hi - lo > 1 else ([], [])
                else:
                    mid = lo + int(np.searchsorted(v["side"][lo:hi], 1))
                    found = _near_pairs(part(lo, mid), part(mid, hi), num, den)
                a += found[0]
                b += found[1]
            return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}) if a else pd.DataFrame({"a": [], "b": []}, dtype=np.int64)

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            last = rows.iloc[-1]
            open_ = ((rows["key"] == last["key"]) & (rows["i"] == last["i"]) & (rows["j"] == last["j"])).to_numpy()
            held = rows[open_]
            yield compare(rows[~open_])
        if held is not None and len(held):
            yield compare(held)

    return run


def _verified(docs: DataFrame, nodes: DataFrame, ids: DataFrame, pairs: DataFrame, k: int, num: int, den: int, key: str, text: str) -> DataFrame:
    """Those of pairs(a, b) that link. nodes: one row per fingerprint; ids: (f, id) of one document each."""
    left = nodes.select(F.col("f").alias("a"), F.col("n").alias("na"), *[F.col(c).alias(f"x{c}") for c in FOLDS])
    right = nodes.select(F.col("f").alias("b"), F.col("n").alias("nb"), *[F.col(c).alias(f"y{c}") for c in FOLDS])
    near = pairs.join(left, "a").join(right, "b")
    apart: Column = sum((F.bit_count(F.col(f"x{c}").bitwiseXOR(F.col(f"y{c}"))) for c in FOLDS[1:]), F.bit_count(F.col("xs0").bitwiseXOR(F.col("ys0"))))
    most = F.floor((den - num) * (F.col("na") + F.col("nb")) / (den + num))
    near = cut(near.where((F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (apart <= most)).select("a", "b"))
    need = near.select(F.col("a").alias("f")).union(near.select(F.col("b").alias("f"))).distinct()
    wanted = cut(need.join(ids, "f"))
    side = wanted.select(F.col("id").alias("id_")).distinct()
    side = F.broadcast(side) if wanted.count() <= SMALL_SIDE else side
    texts = docs.select(key, text).join(side, F.col(key) == F.col("id_"), "left_semi")
    sets = cut(_sets(texts, k, text).join(wanted.select("f"), "f", "left_semi").dropDuplicates(["f"]))
    both = near.join(sets.select(F.col("f").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("f").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInPandas(_linked(num, den), "a long, b long")


def join(docs: DataFrame, k: int, num: int, den: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs -> (id, n, f, component): one row per document with the class f of equal sets and the component's smallest id."""
    light_batches(docs.sparkSession)
    rows = cut(nodes_of(docs, k, key, text))
    real = rows.where("n > 0 and id is not null")
    nodes = real.groupBy("f").agg(F.max("n").alias("n"), F.min("id").alias("id"), *[F.max(c).alias(c) for c in FOLDS])
    nodes = cut(nodes)
    ids = nodes.select("f", "id")

    by_key = Window.partitionBy("key")
    shared = _parts(docs.where(F.col(key).isNotNull()), k, num, den, text)
    shared = shared.withColumns({"top": F.max("f").over(by_key), "low": F.min("f").over(by_key)}).where("low < top")
    shared = cut(shared.select("key", "f").distinct())
    size = cut(shared.groupBy("key").agg(F.count("*").alias("size")))
    central = shared.join(size, "key").groupBy("f").agg(F.sum("size").alias("w"))
    shared = cut(shared.join(central, "f").select("key", "f", "w"))
    top = shared.groupBy("key").agg(F.max_by("f", F.struct("w", "f")).alias("top"))

    pairs = cut(shared.join(top, "key").where("f <> top").select(F.least("f", "top").alias("a"), F.greatest("f", "top").alias("b")).distinct())
    links = cut(_verified(docs, nodes.drop("id"), ids, pairs, k, num, den, key, text))
    component = components(links)

    wide = shared.join(size.where("size > 2"), "key").join(component, F.col("f") == F.col("node"), "left").select("key", "f", F.coalesce("component", "f").alias("c"))
    wide = cut(wide)
    mixed = wide.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("size")).where("c1 < c2").select("key", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    held = wide.join(mixed, "key").join(nodes.drop("id"), "f").withColumn("mine", F.pmod(F.xxhash64("f"), F.col("blocks")))
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j"), (F.col("mine") > o).cast("int").alias("side")))
    held = held.withColumn("m", F.explode(meet)).select("key", "f", "c", "n", *FOLDS, "m.*")
    held = held.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    more = held.mapInPandas(_compared(num, den), "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti")
    found = _verified(docs, nodes.drop("id"), ids, cut(more), k, num, den, key, text)
    component = components(found.unionByName(component.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")))

    classes = nodes.select("f", "id").join(component, F.col("f") == F.col("node"), "left").select("f", "id", F.coalesce("component", "f").alias("c"))
    first = classes.groupBy("c").agg(F.min("id").alias("component"))
    classes = cut(classes.join(first, "c").select("f", "component"))
    out = real.select("id", "n", "f").join(classes, "f").select("id", "n", "f", "component")
    rest = rows.where("n = 0 or id is null").select("id", "n", "f", F.col("id").alias("component"))
    return out.unionByName(rest)


def deduplicate(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, key: str = "doc_id") -> DataFrame:
    """docs without those whose component has a smaller id; of rows that repeat an id one stays. Null ids and empty texts stay."""
    found = cut(join(docs, k, num, den, key).select("id", "component"))
    gone = found.where("id <> component").select(F.col("id").alias("gone_")).distinct()
    gone = F.broadcast(gone) if gone.count() <= SMALL_SIDE else gone
    kept = docs.join(gone, F.col(key) == F.col("gone_"), "left_anti")
    if found.where("id is not null").groupBy("id").count().where("count > 1").isEmpty():
        return kept
    return kept.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(kept.where(F.col(key).isNull()))


def op7(spark, sf_dir: str) -> DataFrame:
    from .store import table

    out = join(table(spark, sf_dir, "documents"), 3, 90, 100)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: the same in DuckDB, by all pairs of documents that share a shingle; fit for small tables
ORACLE = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS v FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(v) >= 3 THEN [v[i] || ' ' || v[i + 1] || ' ' || v[i + 2] FOR i IN range(1, len(v) - 1)] WHEN len(v) > 0 THEN [array_to_string(v, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
low AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.m, d.doc_id)) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.x = d.doc_id"""
