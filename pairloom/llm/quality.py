"""Quality classifier from weak labels.

Seven heuristic labellers look at each whole text and vote good, bad or nothing; most know one kind of junk only and vote bad or
nothing. Expectation-maximisation estimates each labeller's accuracy, the share of its votes that hit the hidden label, with
a Beta prior that takes it for better than chance, from the counts of all vote patterns of the corpus: at most 3**7 rows, whatever its size.
The posterior labels then train a linear scorer (logistic regression) on hashed features of the text: trigrams of character
classes and repeated words, square roots of their shares. The scorer judges every document.

The scorer is fitted on at most ``SAMPLE`` different texts, picked by a hash; everything else covers all
documents.

Defined cases: texts of fewer than three words, null and empty ones among them, get the score 0.5 and are kept; very long texts are read whole; repeated rows score alike; a score that
equals the threshold keeps; labellers that tie leave a posterior of one half;
rows with null ids are scored; other columns pass through ``filter_documents`` untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .store import light_batches

SAMPLE = 5_000
DIM = 1024
LABELLERS = ("symbols", "capitals", "repeats", "exclaims", "variety", "stops", "plain")


def _class_lut() -> np.ndarray:
    """Character classes: letters by case, digits, line ends, blanks, other ASCII each by itself."""
    lut = np.arange(256, dtype=np.int32)
    lut[65:91], lut[97:123], lut[48:58], lut[128:] = 65, 97, 48, 97
    lut[[9, 11, 12, 13, 32]] = 32
    return lut


CLASS = _class_lut()
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#$%&*|<>{}[]\\^~=+@_`")] = True
STOP = np.zeros(256, bool)
STOP[list(b".,;:?!")] = True


class Batch:
    """Counts of a batch of texts, by text."""

    def __init__(self, texts: list) -> None:
        self.buf, self.at = T.encode(texts)
        hashes, self.words = T.word_hashes(texts, lower=False)
        self.n = np.diff(self.words)
        sep = T.SPLIT_WHITE[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], sep, [True]))))
        self.start, self.end = edge[0::2], edge[1::2]
        self.hashes = hashes
        self.owner = np.repeat(np.arange(len(texts)), self.n)
        self.again = np.zeros(len(hashes), bool)
        self.again[1:] = (hashes[1:] == hashes[:-1]) & (self.owner[1:] == self.owner[:-1])

    def per_word(self, flag: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=flag, minlength=len(self.n))

    def holds(self, flag: np.ndarray) -> np.ndarray:
        """Which words hold a flagged byte."""
        total = np.concatenate((np.zeros(1, np.int32), np.cumsum(flag, dtype=np.int32)))
        return total[self.end] > total[self.start]

    def per_byte(self, flag: np.ndarray) -> np.ndarray:
        total = np.concatenate((np.zeros(1, np.int32), np.cumsum(flag, dtype=np.int32)))
        return total[self.at[1:]] - total[self.at[:-1]]

    def distinct(self) -> np.ndarray:
        order = np.lexsort((self.hashes, self.owner))
        h, o = self.hashes[order], self.owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o[new], minlength=len(self.n))


def votes(texts: list) -> np.ndarray:
    """One row per text, one column per labeller: 1 good, 0 bad, 2 nothing."""
    b = Batch(texts)
    n = np.maximum(b.n, 1)
    upper = b.per_byte((b.buf >= 65) & (b.buf <= 90))
    letters = upper + b.per_byte((b.buf >= 97) & (b.buf <= 122))
    double = np.zeros(len(b.buf), bool)
    double[1:] = (b.buf[1:] == 33) & (b.buf[:-1] == 33)
    stops = np.zeros(len(b.start), bool)
    stops[:] = STOP[b.buf[b.end - 1]] & ~b.holds(SYMBOL[b.buf] | double)
    # letters and digits, but for one sign at the end
    odd = ~T.SPLIT_WHITE[b.buf] & T.SPLIT_PUNCT[b.buf]
    total = np.concatenate((np.zeros(1, np.int32), np.cumsum(odd, dtype=np.int32)))
    plain = (total[b.end] - total[b.start] - STOP[b.buf[b.end - 1]]) <= 0
    share = {
        "symbols": b.per_word(b.holds(SYMBOL[b.buf])) / n,
        "capitals": upper / np.maximum(letters, 1),
        "repeats": b.per_word(b.again) / n,
        "exclaims": b.per_word(b.holds(double)) / n,
        "variety": b.distinct() / n,
        "stops": b.per_word(stops) / n,
        "plain": b.per_word(plain) / n,
    }
    out = np.full((len(texts), len(LABELLERS)), 2, np.int8)

    def vote(name: str, good: np.ndarray, bad: np.ndarray, least: int, most: int = 1 << 62) -> None:
        told = (b.n >= least) & (b.n <= most)
        column = out[:, LABELLERS.index(name)]
        column[told & good] = 1
        column[told & bad] = 0

    never = np.zeros(len(texts), bool)
    vote("symbols", never, share["symbols"] > 0.2, 3)
    vote("capitals", never, share["capitals"] > 0.5, 5)
    vote("repeats", never, share["repeats"] > 0.3, 5)
    vote("exclaims", never, share["exclaims"] > 0.2, 3)
    poor = share["variety"] < np.where(b.n <= 3000, 0.3, 0.1)
    vote("variety", never, poor, 20)
    vote("stops", (share["stops"] > 0.06) & ~poor, share["stops"] == 0, 30)
    vote("plain", (share["plain"] > 0.9) & ~poor, share["plain"] < 0.65, 3)
    return out


def _bucket_lut() -> np.ndarray:
    code = np.arange(1 << 21, dtype=np.uint64)
    return (T.mix64(code) % np.uint64(DIM - 2)).astype(np.int32)


_BUCKET: np.ndarray | None = None


def features(texts: list) -> np.ndarray:
    """Square roots of the shares of hashed class trigrams, those of short texts shrunk; the last two columns: repeated words, others."""
    global _BUCKET
    if _BUCKET is None:
        _BUCKET = _bucket_lut()
    b = Batch(texts)
    kind = CLASS[b.buf]
    out = np.zeros((len(texts), DIM), np.float32)
    if len(kind) >= 3:
        code = (kind[:-2] << 14) | (kind[1:-1] << 7) | kind[2:]
        first, last = np.minimum(b.at[:-1], len(code)), np.minimum(b.at[1:] - 1, len(code))
        for i, (lo, hi) in enumerate(zip(first, np.maximum(first, last - 2 + 1), strict=True)):
            if hi > lo:
                out[i] = np.sqrt(np.bincount(_BUCKET[code[lo:hi]], minlength=DIM) / (hi - lo + 50))
    again = b.per_word(b.again)
    out[:, DIM - 2], out[:, DIM - 1] = np.sqrt(again / (b.n + 8)), np.sqrt((b.n - again) / (b.n + 8))
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray, prior: tuple[float, float] = (0.8, 0.2), rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns -> (share of good, accuracy of each labeller, posterior of good by pattern).

    Both classes are taken for equally likely where the votes are read, so that rare junk isn't voted down by its rarity
    alone. The Beta prior of an accuracy weighs as much as a tenth of the documents.
    """
    told = (patterns != 2).any(1)
    n = max(1.0, float(counts[told].sum()))
    accuracy, share = np.full(patterns.shape[1], prior[0]), 1.0
    post = np.full(len(counts), 0.5)
    for _ in range(rounds):
        odds = np.log(accuracy / (1 - accuracy))
        z = (patterns == 1) @ odds - (patterns == 0) @ odds
        new = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        right = (patterns == 1) * post[:, None] + (patterns == 0) * (1 - post)[:, None]
        accuracy = ((right * counts[:, None]).sum(0) + 0.1 * n * prior[0]) / (((patterns != 2) * counts[:, None]).sum(0) + 0.1 * n)
        accuracy = np.clip(accuracy, 0.55, 0.99)
        if done:
            break
    share = float((post * counts)[told].sum() / n)
    return share, accuracy, post


def fit_linear(x: np.ndarray, y: np.ndarray, decay: float = 1e-5, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps; the rarer class weighs up to four times as much."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    w, bias = np.zeros(x.shape[1], np.float32), np.float32(0)
    rare = max(1.0, min(4.0, (y >= 0.5).sum() / max(1, (y < 0.5).sum())))
    weight = np.where(y < 0.5, rare, 1.0).astype(np.float32)
    weight /= max(1.0, float(weight.sum()))
    look_w, look_b = w, bias
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ look_w + look_b, -40, 40)))
        g = weight * (p - y)
        new_w, new_b = look_w - np.float32(4) * (g @ x + np.float32(decay) * look_w), look_b - np.float32(4) * g.sum()
        pace = np.float32(t / (t + 3))
        look_w, look_b = new_w + pace * (new_w - w), new_b + pace * (new_b - bias)
        w, bias = new_w, new_b
    return w, float(bias)


def judge(texts: list, w: np.ndarray, bias: float) -> np.ndarray:
    """Scores; 0.5 for texts of fewer than three words, which nothing can be said about."""
    x = features(texts)
    scores = 1 / (1 + np.exp(-np.clip((x @ w + bias).astype(float), -40, 40)))
    few = x[:, DIM - 2] ** 2 + x[:, DIM - 1] ** 2 < 2.5 / 10.5  # n / (n + 8) of n words
    return np.where(few, 0.5, scores)


def _code(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ 3 ** np.arange(v.shape[1])


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float, dict]:
    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in T.chunks(batch, text):
                code, n = np.unique(_code(votes(part[text].tolist())), return_counts=True)
                yield pd.DataFrame({"code": code, "n": n})

    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in T.chunks(batch, text):
                texts = part[text].tolist()
                yield pd.DataFrame({"h": part["h"], "code": _code(votes(texts)), "x": [row.tobytes() for row in features(texts)]})

    light_batches(docs.sparkSession)
    found = docs.select(text).mapInPandas(answer, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    if not found:
        return np.zeros(DIM), 0.0, {}
    code, counts = np.array([r["code"] for r in found]), np.array([r["n"] for r in found], float)
    patterns = code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    share, accuracy, post = estimate(patterns, counts)
    hashed = docs.select(text, F.xxhash64(text).alias("h"))
    every = max(1, int(np.ceil(hashed.agg(F.approx_count_distinct("h")).first()[0] / (0.9 * SAMPLE))))
    # texts, not rows: however often one is copied, it is learned from once
    picked = hashed.where(F.pmod("h", F.lit(every)) == 0).dropDuplicates(["h"])
    rows = picked.mapInPandas(sampled, "h long, code long, x binary").orderBy("h").limit(SAMPLE).toPandas()
    label = dict(zip(code.tolist(), post, strict=True))
    if not len(rows):
        return np.zeros(DIM), 0.0, {}
    rows = rows[rows["code"] != 3 ** len(LABELLERS) - 1]  # a vote at least
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), DIM)
    w, bias = fit_linear(x, np.array([label[c] for c in rows["code"]]))
    return w, bias, {"share": share, "accuracy": dict(zip(LABELLERS, accuracy, strict=True))}


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.35) -> DataFrame:
    """docs -> docs + score (probability of good) + keep."""
    w, bias, _ = train(docs, key, text)
    model = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), bias))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, bias = model.value
        for batch in batches:
            for part in T.chunks(batch, text):
                yield pd.DataFrame({key: part[key], "score": judge(part[text].tolist(), w, bias)})

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, score double")
    return out.withColumn("keep", F.col("score") >= threshold)


def filter_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.35) -> DataFrame:
    """The rows that the scorer keeps, with their own columns."""
    w, bias, _ = train(docs, key, text)
    model = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), bias))

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        w, bias = model.value
        frame = pd.DataFrame({"t": texts})
        parts = [pd.Series(judge(part["t"].tolist(), w, bias) >= threshold, index=part.index) for part in T.chunks(frame, "t")]
        return pd.concat(parts) if parts else pd.Series([], dtype=bool)

    return docs.where(good(F.col(text)))


def op5(spark, sf_dir: str) -> DataFrame:
    from .store import table

    return score(table(spark, sf_dir, "documents"))
