"""Toxicity by cumulative-link ordinal regression.

P(grade <= j) = logistic(theta_j - w.x) with ordered thresholds theta and one weight vector w for all of them; the result is
the expected grade. Features are sparse: hashed words and word beginnings of 4, 6 and 8 bytes (A-Z lower-cased, punctuation
cut off), present or not, and their rate per 100 words.

Training data are labelled rows, toxic or not. Toxic rows get grades 1 to 3 by thirds of the rate of marker features, those
whose log odds for toxic rows exceed ``MARKER`` with confidence; other rows have grade 0. The model is fitted on at most ``SAMPLE``
labelled rows, picked by a hash of the id, on features that enough of them have; every document is scored as a whole.

Defined cases: null and empty texts have no features and get the thresholds alone; very long texts are read whole; labels that are null are ignored; of labels that
differ for one id the toxic one counts; of texts that differ for one id the one with the least hash is learned from; rows that repeat score alike; features that tell equally much are
chosen by number; an empty table gives an empty result; without labelled rows of both kinds every document has expected severity 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .store import light_batches

SAMPLE = 12_000
CHOSEN = 20_000
BITS = 20
GRADES = 4
MARKER = 2.0
PREFIXES = (0, 4, 6, 8)


def features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature, count) of all distinct features, by text, and the number of words of each text."""
    rows, codes = [], []
    n = np.zeros(len(texts), np.int64)
    for i, prefix in enumerate(PREFIXES):
        h, at = T.word_hashes(texts, T.SPLIT_PUNCT, prefix=prefix)
        n = np.diff(at)
        rows.append(np.repeat(np.arange(len(texts)), n))
        codes.append((T.mix64(h + np.uint64(i)) >> np.uint64(64 - BITS)).astype(np.int64))
    key, count = np.unique((np.concatenate(rows) << BITS) | np.concatenate(codes), return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), count, n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Chosen features, their two weights, and the thresholds."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, theta: np.ndarray) -> None:
        self.chosen, self.weights, self.theta = chosen, weights, theta

    def design(self, feature: np.ndarray, count: np.ndarray, words: np.ndarray):
        """Columns and values of the entries whose feature was chosen: presence, and rate in columns of their own."""
        if not len(self.chosen):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0), np.zeros(0)
        at = np.minimum(np.searchsorted(self.chosen, feature), len(self.chosen) - 1)
        hit = np.flatnonzero(self.chosen[at] == feature)
        return hit, at[hit], np.ones(len(hit)), np.log1p(100.0 * count[hit] / np.maximum(words[hit], 1))

    def probabilities(self, texts: list) -> np.ndarray:
        row, feature, count, n = features(texts)
        hit, column, one, rate = self.design(feature, count, n[row])
        k = len(self.chosen)
        z = np.bincount(row[hit], weights=self.weights[:k][column] * one + self.weights[k:][column] * rate, minlength=len(texts)) if len(hit) else np.zeros(len(texts))
        below = _sigmoid(self.theta[None, :] - z[:, None])
        return np.diff(np.concatenate([np.zeros((len(texts), 1)), below, np.ones((len(texts), 1))], axis=1), axis=1)


def log_odds(a: Column, n: Column, p: int, q: int) -> Column:
    """Log odds ratio of a feature that a of p toxic rows and n - a of q other rows have, drawn to 0 by 1.64 standard errors."""
    cells = [a, F.greatest(n - a, F.lit(0)), F.greatest(F.lit(p) - a, F.lit(0)), F.greatest(F.lit(q) - n + a, F.lit(0))]
    pt, nt, pf, nf = [c + F.lit(0.5) for c in cells]
    odds = F.log(pt / pf) - F.log(nt / nf)
    return F.signum(odds) * F.greatest(F.abs(odds) - 1.64 * F.sqrt(1 / pt + 1 / nt + 1 / pf + 1 / nf), F.lit(0.0))


def fit(chosen: np.ndarray, marker: np.ndarray, row: np.ndarray, feature: np.ndarray, count: np.ndarray, words: np.ndarray, toxic: np.ndarray, decay: float = 2e-3, rounds: int = 400) -> Model:
    """chosen, marker: sorted features; row, feature, count: entries of the rows; words: of each row.

    Adam on the likelihood of the grades, as the features' frequencies differ by orders of magnitude.
    """
    if not toxic.any() or toxic.all():
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES - 1, 40.0))
    is_marker = np.isin(feature, marker)
    rate = np.bincount(row[is_marker], weights=count[is_marker].astype(float), minlength=len(toxic)) / np.maximum(words, 1)
    grade = np.zeros(len(toxic), np.int64)
    edges = np.quantile(rate[toxic], [1 / 3, 2 / 3])
    grade[toxic] = 1 + np.searchsorted(edges, rate[toxic], side="left")

    model = Model(chosen, np.zeros(2 * len(chosen)), np.array([2.0, 3.0, 4.0]))
    hit, column, one, rate = model.design(feature, count, words[row])
    r, k = row[hit], len(chosen)
    weight = 1.0 / len(toxic)

    def gradient(w: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.bincount(r, weights=w[:k][column] * one + w[k:][column] * rate, minlength=len(toxic)) if len(r) else np.zeros(len(toxic))
        upper = np.concatenate([theta, [np.inf]])[grade] - z
        lower = np.concatenate([[-np.inf], theta])[grade] - z
        cu, cl = np.where(np.isinf(upper), 1.0, _sigmoid(np.nan_to_num(upper, posinf=40))), np.where(np.isinf(lower), 0.0, _sigmoid(np.nan_to_num(lower, neginf=-40)))
        du, dl = cu * (1 - cu), cl * (1 - cl)
        p = np.maximum(cu - cl, 1e-9)
        dz = -(du - dl) / p * weight
        gw = np.concatenate([np.bincount(column, weights=dz[r] * v, minlength=k) for v in (one, rate)]) - decay * w
        gt = np.zeros(GRADES - 1)
        for j in range(GRADES - 1):
            gt[j] = weight * ((du / p)[grade == j].sum() - (dl / p)[grade == j + 1].sum())
        return gw, gt

    w, theta = model.weights, model.theta
    m, v = np.zeros(2 * k + GRADES - 1), np.zeros(2 * k + GRADES - 1)
    for t in range(1, rounds + 1):
        g = np.concatenate(gradient(w, theta))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, theta = w + step[: 2 * k], np.maximum.accumulate(theta + step[2 * k :] + np.array([0, 1e-6, 2e-6]))
    return Model(chosen, w, theta)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    light_batches(docs.sparkSession)
    told = labels.where("toxic is not null").groupBy(F.col(key).alias("k_")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    total = told.count()
    every = max(1, -(-total // int(0.9 * SAMPLE)))
    told = told.where(F.pmod(F.xxhash64("k_"), F.lit(every)) == 0).orderBy(F.xxhash64("k_"), "k_").limit(SAMPLE)

    kind = docs.schema[key].dataType.simpleString()
    # one row per id before anything is collected: of several texts the one with the least hash
    rows = docs.select(key, text).join(F.broadcast(told), F.col(key) == F.col("k_")).groupBy(key, "y").agg(F.min_by(text, F.xxhash64(text)).alias(text))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in T.chunks(batch, text):
                row, feature, _, _ = features(part[text].tolist())
                f, at = np.unique(feature, return_inverse=True)
                yield pd.DataFrame({"f": f, "a": np.bincount(at, weights=part["y"].to_numpy()[row]).astype(np.int64) if len(f) else f, "n": np.bincount(at) if len(f) else f})

    p = told.where("y > 0").count()
    q = told.count() - p
    seen = rows.mapInPandas(counted, "f long, a long, n long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).where("n >= 3")
    found = seen.select("f", log_odds(F.col("a"), F.col("n"), p, q).alias("bound")).where("abs(bound) > 0.7").orderBy(F.abs("bound").desc(), "f").limit(CHOSEN).toPandas()
    chosen = np.sort(found["f"].to_numpy(np.int64))
    marker = np.sort(found.loc[found["bound"] > MARKER, "f"].to_numpy(np.int64))
    known = docs.sparkSession.sparkContext.broadcast(chosen)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in T.chunks(batch, text):
                row, feature, count, n = features(part[text].tolist())
                keep = np.isin(feature, known.value)
                row, feature, count = row[keep], feature[keep].astype(np.int32), count[keep].astype(np.int32)
                cuts = np.searchsorted(row, np.arange(len(part) + 1))
                span = list(zip(cuts[:-1], cuts[1:], strict=True))
                yield pd.DataFrame({"k": part[key], "y": part["y"], "n": n, "f": [feature[a:b].tobytes() for a, b in span], "c": [count[a:b].tobytes() for a, b in span]})

    rows = rows.mapInPandas(entries, f"k {kind}, y int, n long, f binary, c binary").toPandas()
    rows = rows.sort_values("k", ignore_index=True)
    feature = np.frombuffer(b"".join(rows["f"]), np.int32).astype(np.int64)
    count = np.frombuffer(b"".join(rows["c"]), np.int32)
    row = np.repeat(np.arange(len(rows)), [len(f) // 4 for f in rows["f"]])
    return fit(chosen, marker, row, feature, count, rows["n"].to_numpy(), rows["y"].to_numpy(int) > 0)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, p0..p3, expected_severity, toxic): toxic when grade 1 or higher has a probability above the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, key, text))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for batch in batches:
            for part in T.chunks(batch, text):
                p = m.probabilities(part[text].tolist())
                yield pd.DataFrame({key: part[key]} | {f"p{j}": p[:, j] for j in range(GRADES)} | {"expected_severity": p @ np.arange(GRADES)})

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, " + ", ".join(f"p{j} double" for j in range(GRADES)) + ", expected_severity double")
    return out.withColumn("toxic", F.col("p0") < 1 - threshold)


def op6(spark, sf_dir: str) -> DataFrame:
    from .store import table

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
