"""Cross-entropy difference of matched n-gram models.

Target model: bigrams of the documents labelled good and not toxic. Background model: bigrams of all documents. Both share one
vocabulary, one order and one smoothing, so they differ by their counts alone: p(w | v) = (c(v, w) + M * p(w)) / (c(v) + M),
p(w) = (c(w) + 1) / (N + V), where V is the number of distinct words, ``WORDS`` at least. Words and bigrams are kept apart by 64-bit hashes, whatever
their number: what is counted grows with the corpus.

A document's own tokens are taken out of both models' counts before it is scored (leave one out): else
target documents would be recognised by themselves. Score: mean over tokens of target loss minus background loss, in nats; lower is
closer to the target.

The logarithm of p(w | v) is one of a numerator, which needs c(v, w) and c(w), less one of c(v) + M. The most frequent words (``HOT`` at most, found on a
sample, counted exactly) and the bigrams among them are broadcast and summed where the text is. Every other bigram holds a rarer word, the
second one if it is rare, else the first, and goes to that word's bucket: there all its bigrams meet, so that c(v, w), c(w) and c(v) are known in one
shuffle. A rare word is a small share of the tokens, so no bucket is heavy; buckets number as the tokens. Blocks of documents travel as packed
arrays; buckets send back one sum a document.

Defined cases: null and empty texts have 0 tokens and null losses; very long texts are read whole; rows that repeat are counted and scored each; words that are equally
frequent are chosen by hash, which changes no count; an empty table gives an empty result; labels that are null don't make
a target; without target documents the target model is the smoothing alone; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .store import light_batches

WORDS = 1 << 19
MASS = 8.0
SMALL_SIDE = 1_000_000
#: broadcast words; documents that choose them; tokens a bucket; bigrams and documents a block
HOT, SAMPLE, BUCKET, BLOCK, BLOCK_DOCS = 2048, 20_000, 2_000_000, 1_000_000, 60_000
START = np.uint64(1)


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, word before it) of every token as hashes and the offsets of the texts; the first token follows a start mark."""
    h, at = T.word_hashes(texts, T.SPLIT_PUNCT)
    before = np.zeros(len(h), np.uint64)
    before[1:] = h[:-1]
    before[at[:-1][np.diff(at) > 0]] = START
    return h, before, at


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as bytes, with five bytes for kind and length before each."""
    return b"".join(x for a in arrays for x in (a.dtype.char.encode(), len(a).to_bytes(4, "little"), a.tobytes()))


def load(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n = np.dtype(data[at : at + 1].decode()), int.from_bytes(data[at + 1 : at + 5], "little")
        out.append(np.frombuffer(data, kind, n, at + 5))
        at += 5 + n * kind.itemsize
    return out


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _found(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x in a sorted table, -1 where it isn't there."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def _history(hot: np.ndarray, before: np.ndarray) -> np.ndarray:
    return np.where(before == START, len(hot), _found(hot, before))


def _frequent(text: str, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = pd.Series(dtype="int64")
        for batch in batches:
            for part in T.chunks(batch, text):
                word, n = np.unique(tokens(part[text].tolist())[0], return_counts=True)
                total = total.add(pd.Series(n, T.signed(word)), fill_value=0)
        n = total.astype("int64")
        yield pd.DataFrame({"word": n.index.to_numpy(np.int64), "n": n.to_numpy(), "all": n.sum()})[(n * 4 * most >= n.sum()).to_numpy()]

    return run


#: kinds of counts
TOTAL, WORD, BEFORE, PAIR, DISTINCT = range(5)


def _count(text: str, hot: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(hot)
        kinds = {TOTAL: 1, WORD: k, BEFORE: k + 1, PAIR: k * (k + 1)}
        sums = {kind: np.zeros((2, size), np.int64) for kind, size in kinds.items()}
        words, held = [], 0
        for batch in batches:
            for part in T.chunks(batch, text):
                h, before, at = tokens(part[text].tolist())
                mine = np.repeat(part["target"].to_numpy(bool), np.diff(at))
                w, v = _found(hot, h), _history(hot, before)
                for kind, code in ((TOTAL, np.zeros(len(h), np.int64)), (WORD, w), (BEFORE, v), (PAIR, np.where((w >= 0) & (v >= 0), v * k + w, -1))):
                    np.add.at(sums[kind][0], code[code >= 0], 1)
                    np.add.at(sums[kind][1], code[(code >= 0) & mine], 1)
                words.append(np.unique(h))
                held += len(words[-1])
                if held > 4_000_000:
                    words = [np.unique(np.concatenate(words))]
                    held = 0
        for kind, (every, target) in sums.items():
            code = np.flatnonzero(every)
            yield pd.DataFrame({"kind": kind, "code": code, "n": every[code], "t": target[code]})
        if words:
            code = T.signed(np.unique(np.concatenate(words)))
            for lo in range(0, len(code), 500_000):
                yield pd.DataFrame({"kind": DISTINCT, "code": code[lo : lo + 500_000], "n": 0, "t": 0})

    return run


def counts(rows: DataFrame, text: str, hot: np.ndarray) -> dict:
    """Counts of the hot words, of the bigrams among them and of all tokens; at most a row for each of these reaches the driver."""
    each = rows.mapInPandas(_count(text, hot), "kind int, code long, n long, t long").groupBy("kind", "code").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    each = each.withColumn("code", F.when(F.col("kind") == DISTINCT, -1).otherwise(F.col("code")))
    told = each.groupBy("kind", "code").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.count("*").alias("rows")).toArrow().to_pandas()
    k = len(hot)
    out = {"hot": hot, "size": max(WORDS, int(told.loc[told["kind"] == DISTINCT, "rows"].sum()))}
    for name, kind, size in (("total", TOTAL, 1), ("word", WORD, k), ("before", BEFORE, k + 1)):
        part = told[told["kind"] == kind]
        out[name] = np.zeros((2, size), np.int64)
        out[name][:, part["code"]] = part["t"], part["n"]
    part = told[told["kind"] == PAIR].sort_values("code")
    out["code"], out["pair"] = part["code"].to_numpy(), np.array([part["t"], part["n"]], np.int64)
    return out


def _numerator(pair, word, n, own, size, taken, vocabulary) -> np.ndarray:
    return np.log(pair - n * taken + MASS * (word - own * taken + 1.0) / (size + vocabulary))


def _blocks(key: str, text: str, shared, buckets: int, block: int):
    """Texts to packed blocks: a header (keys, sums over what is broadcast) a block and, for every bucket, the bigrams that belong there."""

    def pack(number: int, docs: list, held: list) -> Iterator[dict]:
        keys, n, target, sums = ([x for d in docs for x in d[0]], *(np.concatenate([d[i] for d in docs]) for i in (1, 2)), np.concatenate([d[3] for d in docs], 1))
        yield {"bucket": number % buckets, "block": number, "header": True, "payload": pickle.dumps((keys, n, sums), 5)}
        rare, pair, hot, doc, times, own, gone = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((pair, rare))
        rare, pair, hot, doc, times, own, gone = (x[order] for x in (rare, pair, hot, doc, times, own, gone))
        bucket = ((rare >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            first = np.flatnonzero(np.concatenate(([True], (pair[lo + 1 : hi] != pair[lo : hi - 1]) | (rare[lo + 1 : hi] != rare[lo : hi - 1])))) + lo
            word = np.flatnonzero(np.concatenate(([True], rare[first[1:]] != rare[first[:-1]])))
            here, place = np.unique(doc[lo:hi], return_inverse=True)
            body = (rare[first[word]], _small(np.diff(word, append=len(first))), pair[first], hot[first], _small(np.diff(first, append=hi)), _small(here), _small(n[here]), target[here])
            yield {"bucket": int(bucket[lo]), "block": number, "header": False, "payload": dump(*body, _small(place), *(_small(x[lo:hi]) for x in (times, own, gone)))}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        hot, k = m["hot"], len(m["hot"])
        number, size, have, docs, held = TaskContext.get().partitionId() << 32, 0, 0, [], []
        for batch in batches:
            for part in T.chunks(batch, text):
                h, before, at = tokens(part[text].tolist())
                n, mine = np.diff(at), part["target"].to_numpy(bool)
                doc = np.repeat(np.arange(len(part)), n)
                salt = T.mix64(doc.astype(np.uint64) + np.uint64(1))
                bigram = T.mix64(h * np.uint64(3) + T.mix64(before))
                # distinct words and distinct bigrams of each document
                _, wf, wi, wn = np.unique(T.mix64(h ^ salt), return_index=True, return_inverse=True, return_counts=True)
                _, pf, pi, pn = np.unique(T.mix64(bigram ^ salt), return_index=True, return_inverse=True, return_counts=True)
                follows = wn.copy()
                follows[wi[at[1:][n > 0] - 1]] -= 1
                own, gone = wn[wi[pf]], np.zeros(len(pf), np.int64)
                gone[pi[wf]] = follows
                w, v = _found(hot, h), _history(hot, before)
                gone[w[pf] >= 0] = 0
                near = (w[pf] >= 0) & (v[pf] >= 0)
                p, d = pf[near], doc[pf[near]]
                code = _found(m["code"], v[p] * k + w[p])
                known = w[wf] >= 0
                sums = np.zeros((2, len(part)))
                for i in (0, 1):
                    taken = mine.astype(np.int64) if i == 0 else np.ones(len(part), np.int64)
                    sums[i] -= np.bincount(d, pn[near] * _numerator(m["pair"][i][code], m["word"][i][w[p]], pn[near], own[near], m["total"][i][0] - n[d] * taken[d], taken[d], m["size"]), len(part))
                    f, g = follows[known], doc[wf[known]]
                    sums[i] += np.bincount(g, f * np.log(m["before"][i][w[wf[known]]] - f * taken[g] + MASS), len(part))
                    sums[i] += np.where(n > 0, np.log(np.maximum(m["before"][i][k] - taken, 0) + MASS), 0.0)
                if have and have + len(part) > BLOCK_DOCS:
                    yield pd.DataFrame(list(pack(number, docs, held)))
                    number, size, have, docs, held = number + 1, 0, 0, [], []
                p = pf[~near]
                held.append((np.where(w[p] < 0, h[p], before[p]), bigram[p], np.where(w[p] < 0, -1, w[p]).astype(np.int16), *(x.astype(np.int32) for x in (doc[p] + have, pn[~near], own[~near], gone[~near]))))
                docs.append((part[key].tolist(), n, mine, sums))
                size, have = size + len(p), have + len(part)
                if size > block:
                    yield pd.DataFrame(list(pack(number, docs, held)))
                    number, size, have, docs, held = number + 1, 0, 0, [], []
        if docs:
            yield pd.DataFrame(list(pack(number, docs, held)))

    return run


def _bucket(shared):
    """All blocks of a bucket to sums a document."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        m = shared.value
        out = [{"block": b, "header": True, "payload": p} for b, p in group.loc[group["header"], ["block", "payload"]].itertuples(index=False)]
        rest = group[~group["header"]]
        blobs = [load(p) for p in rest["payload"]]
        if blobs:
            rare = np.unique(np.concatenate([b[0] for b in blobs]))
            pairs = np.unique(np.concatenate([b[2] for b in blobs]))
            # of the target and of all: a rare word's tokens, how often it is followed, and bigrams
            word, before, both = np.zeros((2, len(rare))), np.zeros((2, len(rare))), np.zeros((2, len(pairs)))

            def places(b):
                w = np.repeat(np.searchsorted(rare, b[0]), b[1])
                return np.repeat(w, b[4]), np.repeat(np.searchsorted(pairs, b[2]), b[4]), np.repeat(b[3], b[4])

            for b in blobs:
                w, p, hot = places(b)
                times, gone, mine = b[9].astype(float), b[11].astype(float), b[7][b[8]]
                for i, only in enumerate((mine, np.ones(len(w)))):
                    word[i] += np.bincount(w, times * only * (hot < 0), len(rare))
                    before[i] += np.bincount(w, gone * only, len(rare))
                    both[i] += np.bincount(p, times * only, len(pairs))
            for number, b in zip(rest["block"], blobs, strict=True):
                w, p, hot = places(b)
                n, mine, d = b[6].astype(float), b[7].astype(float), b[8]
                times, own, gone = (x.astype(float) for x in b[9:])
                sums = []
                for i, taken in enumerate((mine, np.ones(len(n)))):
                    c = np.where(hot < 0, word[i][w], m["word"][i][hot] if len(m["hot"]) else 0)
                    loss = -times * _numerator(both[i][p], c, times, own, m["total"][i][0] - (n * taken)[d], taken[d], m["size"])
                    some = gone > 0
                    loss[some] += gone[some] * np.log(before[i][w[some]] - (gone * taken[d])[some] + MASS)
                    sums.append(np.bincount(d, loss, len(n)))
                out.append({"block": number, "header": False, "payload": dump(b[5], *sums)})
        return pd.DataFrame(out, columns=["block", "header", "payload"])

    return run


def _documents(key: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys, n, sums = pickle.loads(group.loc[group["header"], "payload"].iloc[0])
        for p in group.loc[~group["header"], "payload"]:
            here, *part = load(p)
            sums[:, here] += np.array(part)
        loss = sums / np.where(n > 0, n, np.nan)
        return pd.DataFrame({key: keys, "n_tokens": n, "target_loss": loss[0], "background_loss": loss[1], "difference": loss[0] - loss[1]})

    return run


def score(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """docs, target(key) -> (key, n_tokens, target_loss, background_loss, difference). ``hot``, ``bucket`` and ``block`` are matters of load alone."""
    spark = docs.sparkSession
    light_batches(spark)
    ids = target.select(F.col(key).alias("k_")).where("k_ is not null").distinct()
    side = F.broadcast(ids) if ids.count() <= SMALL_SIDE else ids
    rows = docs.select(key, text).join(side.withColumn("hit_", F.lit(True)), F.col(key) == F.col("k_"), "left")
    # as text: pandas has no whole numbers beside nulls
    kind = docs.schema[key].dataType.simpleString()
    held = "string" if kind in ("tinyint", "smallint", "int", "bigint") else kind
    rows = rows.select(F.col(key).cast(held).alias(key), text, F.coalesce("hit_", F.lit(False)).alias("target"))

    n = docs.count()
    share = min(1.0, SAMPLE / max(n, 1))
    some = docs.select(text) if share == 1 else docs.select(text).sample(share, seed=7)
    often = some.mapInPandas(_frequent(text, max(hot, 1)), "word long, n long, all long")
    top = often.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(hot).collect()
    model = counts(rows, text, np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64)))
    buckets = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), model["total"][1][0] // bucket, 1))
    shared = spark.sparkContext.broadcast(model)
    sent = rows.mapInPandas(_blocks(key, text, shared, buckets, block), "bucket int, block long, header boolean, payload binary")
    back = sent.groupBy("bucket").applyInPandas(_bucket(shared), "block long, header boolean, payload binary")
    out = back.groupBy("block").applyInPandas(_documents(key), f"`{key}` {held}, n_tokens long, target_loss double, background_loss double, difference double")
    return out.withColumn(key, F.col(key).cast(kind))


def op10(spark, sf_dir: str) -> DataFrame:
    from .store import table

    labels = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return score(table(spark, sf_dir, "documents"), labels)
