"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes.

The benchmark is the stated query set: its items go, in blocks of at most ``BLOCK_WORDS`` words, to every
worker as one array of word hashes with a sorted index of its ``least``-word windows (the seeds). Every document is read once
per block, as a whole: its windows are rolled along the text and looked up in the
index; documents without a shared seed stop there. For an item with shared seeds the tiling runs as
described by Wise (1993): the longest common run of unmarked words is found by Karp-Rabin hashes of the current
search length, which shrinks from the longest run down to ``least``; all non-overlapping matches of that length are marked, longest
first, until none is left. Coverage is the share of the item's words that lie in tiles, so passages whose parts
were put in another order still count. A document is contaminated by an item with a coverage of ``threshold`` or more.

Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased: punctuation and line breaks don't hide a match.

Defined cases: a null or empty text has no tiles; very long texts are read whole, stretch by stretch around their seeds; of matches of one length the one that comes first in the document, then in the
item, is marked first; items with fewer than ``least`` words match nothing; null
items are ignored; rows that repeat are judged each on their own, and repeated items with one id and one text
give one row; an empty benchmark gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .store import light_batches

BLOCK_WORDS = 2_000_000


class Index:
    """Word hashes of a block of items and the sorted hashes of their windows."""

    def __init__(self, ids: list, texts: list[str], least: int) -> None:
        self.ids, self.least = ids, least
        self.words, self.offsets = T.word_hashes(texts, T.SPLIT_PUNCT)
        windows, at = T.shingles(self.words, self.offsets, least)
        full = np.diff(self.offsets) >= least
        owner = np.repeat(np.arange(len(ids)), np.diff(at))
        keep = full[owner]
        windows, owner = windows[keep], owner[keep]
        order = np.argsort(windows, kind="stable")
        self.windows, self.owner = windows[order], owner[order]

    def item(self, i: int) -> np.ndarray:
        return self.words[self.offsets[i] : self.offsets[i + 1]]

    def candidates(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the windows that are seeds, for each the first place in the index)."""
        if not len(self.windows) or not len(windows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        left = np.minimum(np.searchsorted(self.windows, windows), len(self.windows) - 1)
        hit = np.flatnonzero(self.windows[left] == windows)
        return hit, left[hit]


def _ids(*arrays: np.ndarray) -> list[np.ndarray]:
    """Small consecutive numbers in place of hashes."""
    _, codes = np.unique(np.concatenate(arrays), return_inverse=True)
    return np.split(codes, np.cumsum([len(a) for a in arrays])[:-1])


def _windows(codes: np.ndarray, free: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and Karp-Rabin hashes of the windows of unmarked words."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    marked = np.concatenate(([0], np.cumsum(~free)))
    start = np.flatnonzero(marked[length:] == marked[:-length])
    value = T.mix64(codes.astype(np.uint64) + np.uint64(1))
    up, down = T._POWERS.get(len(codes))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * up, dtype=np.uint64)))
    return start, (total[start + length] - total[start]) * down[start]


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in doc, length) of two word sequences, no word in two tiles."""
    a, b = _ids(item, doc)
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    out: list[tuple[int, int, int]] = []
    low, length = least, min(len(a), len(b))

    def common(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sa, ha = _windows(a, free_a, size)
        sb, hb = _windows(b, free_b, size)
        return sa, ha, sb[np.isin(hb, ha)], hb[np.isin(hb, ha)]

    while length >= low:
        # the longest length that still has a match: matches of a length imply matches of all shorter ones
        lo, hi = low - 1, length
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if len(common(mid)[2]) else (lo, mid - 1)
        if lo < low:
            break
        length = lo
        sa, ha, sb, hb = common(length)
        places: dict[int, list[int]] = {}
        for s, h in zip(sa.tolist(), ha.tolist(), strict=True):
            places.setdefault(h, []).append(s)
        for t, h in zip(sb.tolist(), hb.tolist(), strict=True):
            if not free_b[t : t + length].all():
                continue
            for s in places[h]:
                if free_a[s : s + length].all() and (a[s : s + length] == b[t : t + length]).all():
                    free_a[s : s + length] = False
                    free_b[t : t + length] = False
                    out.append((s, t, length))
                    break
        length -= 1
    return out


def _cover(starts: np.ndarray, span: int, n: int) -> np.ndarray:
    """Which of n words lie in the windows."""
    keep = np.zeros(n + 1, np.int64)
    np.add.at(keep, starts, 1)
    np.add.at(keep, np.minimum(starts + span, n), -1)
    return np.cumsum(keep[:-1]) > 0


def _near(doc: np.ndarray, hits: np.ndarray, span: int) -> np.ndarray:
    """The words of doc near its seeds, with breaks between stretches, so that long documents tile fast."""
    at = np.flatnonzero(_cover(hits, span, len(doc)))
    breaks = np.flatnonzero(np.diff(at) > 1) + 1
    return np.insert(doc[at], breaks, T.mix64(np.arange(len(breaks), dtype=np.uint64) + np.uint64(1 << 40)))


def matches(docs: DataFrame, index: Index, threshold: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        least = index.least
        for batch in batches:
            rows = []
            for part in T.chunks(batch, text):
                words, offsets = T.word_hashes(part[text].tolist(), T.SPLIT_PUNCT)
                windows, at = T.shingles(words, offsets, least)
                hit, place = index.candidates(windows)
                owner = np.searchsorted(at, hit, side="right") - 1
                for d in np.unique(owner):
                    mine = owner == d
                    start, first = hit[mine] - at[d], place[mine]
                    doc = words[offsets[d] : offsets[d + 1]]
                    if len(doc) < least:
                        continue
                    seeds = T.shingles(doc, np.array([0, len(doc)]), least)[0][start]
                    last = np.searchsorted(index.windows, seeds, side="right")
                    by_item: dict[int, list[int]] = {}
                    for s, f, e in zip(start.tolist(), first.tolist(), last.tolist(), strict=True):
                        for i in set(index.owner[f:e].tolist()):
                            by_item.setdefault(i, []).append(s)
                    for i, starts in by_item.items():
                        item = index.item(i)
                        # tiles consist of seeds, so the words that seeds cover bound the coverage
                        if _cover(np.array(starts), least, len(doc)).sum() < threshold * len(item):
                            continue
                        found = tiles(item, _near(doc, np.array(starts), least), least)
                        covered = sum(n for _, _, n in found)
                        if covered >= threshold * len(item):
                            rows.append((part[key].iloc[d], index.ids[i], len(item), covered, len(found), covered / len(item)))
            yield pd.DataFrame(rows, columns=["key", "item_id", "n_words", "n_covered", "n_tiles", "coverage"])

    schema = f"key {kind}, item_id long, n_words long, n_covered long, n_tiles long, coverage double"
    return docs.select(key, text).mapInPandas(run, schema).withColumnRenamed("key", key)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.6, key: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_words, n_covered, n_tiles, coverage) of every contaminated document and item.

    The benchmark is cut into blocks by a running sum of its sizes; only one block's texts are on the driver at a time.
    """
    light_batches(docs.sparkSession)
    bench = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    sized = bench.withColumn("n", F.length("text"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    blocks = total // (5 * block_words) + 1
    out = None
    for b in range(blocks):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect() if blocks > 1 else sized.orderBy("item_id", "text").collect()
        found = matches(docs, Index([r["item_id"] for r in rows], [r["text"] for r in rows], least), threshold, key, text)
        out = found if out is None else out.unionByName(found)
    return out


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones; rows with a null doc_id go if any of them is contaminated."""
    bad = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("bad_")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_"]), "left_anti")


def op4(spark, sf_dir: str) -> DataFrame:
    from .store import table

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
