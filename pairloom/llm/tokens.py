"""Token counts by a map-side two-tier lookup.

Tier one: a compact table of the token counts of frequent pre-tokens, counted in a bounded sample of whole texts
(``SAMPLE`` documents, chosen by a hash of the id; at most ``FREQUENT`` entries) and broadcast, read-only. Tier two: what misses it is looked up in
the cache of the worker process, which lives on from task to task, and what is new there is encoded by the library, a batch of texts at a time. The cache has two
generations of ``CACHE`` entries at most: when the younger one is full it becomes the older one, and entries in use come back from there. Pre-tokens never leave their task:
there is no shuffle. Sample and caches decide speed only; counts are exact whatever they hold.

Texts are cut at the tokenizer's special strings, which count as one token each, the library's default, and then into pre-tokens by its splitting
pattern. Where a text holds code points on which regular-expression libraries may disagree (below), it is first cut before every blank that follows a printable
ASCII sign, as a pre-token starts there in any case; the pieces with such code points go to the library (and its answers to tier two), the others take both tiers.
Tokenizers of another make than byte-level BPE without a normaliser, and added strings that take blanks along, are left to the library text by text.

Defined cases: a null text counts as empty: 0 bytes, 0 tokens; very long texts are counted whole; repeated rows are counted row by row; ties in frequency fall to the
smaller pre-token and change nothing but speed; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .store import light_batches

SAMPLE = 2_000
FREQUENT = 1 << 16
CACHE = 1 << 18
LONGEST = 64
#: fixed value: the splitting pattern of byte-level BPE
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: scripts and general punctuation that all Unicode versions at hand class alike
RANGES = "\t-\r\\x20-\x7E\xA0-ɏͰ-ͳΆ-ώЀ-ҁ‐-‧‰-⁞€"
PLAIN = re.compile(f"[{RANGES}]*")
CUT = re.compile("(?<=[!-~])(?= )")


def _plain_pattern() -> str:
    """The splitting pattern for PLAIN texts with letters and numbers spelt out, for the faster library."""
    plain = regex.compile(f"[{RANGES}]")
    inside = [c for c in map(chr, range(0x20AD)) if plain.match(c)]
    letters, numbers = ("".join(c for c in inside if regex.match(p, c)) for p in (r"\p{L}", r"\p{N}"))
    return PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")


class Tier(dict):
    """Tier one. What misses it is noted in ``missed`` and counts 0."""

    missed: list[str]

    def __missing__(self, word: str) -> int:
        self.missed.append(word)
        return 0


class SentencePiece:
    """Counts of whole texts by a sentencepiece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def frequent(self, texts: Iterator[str]) -> dict[str, int]:
        return {}

    def count(self, texts: list[str], known: Tier) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts)]


class Lookup:
    """A worker's tokenizer and its cache."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.find = re.compile(_plain_pattern()).findall
        made = json.loads(self.tokenizer.to_str())
        splitter, model = made["pre_tokenizer"] or {}, made["model"]
        self.whole = made["normalizer"] is not None or (model["type"], splitter.get("type"), splitter.get("use_regex", True), splitter.get("add_prefix_space")) != ("BPE", "ByteLevel", True, False)
        added = self.tokenizer.get_added_tokens_decoder().values()
        names = sorted((a.content for a in added if not (a.lstrip or a.rstrip or a.single_word or a.normalized)), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.greedy = [a.content for a in added if a.lstrip or a.rstrip or a.single_word or a.normalized]

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for i in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]

    def pieces(self, text: str) -> tuple[int, list[str], list[str]]:
        """(special strings, pre-tokens, pieces that are left to the library)."""
        if self.whole or any(a in text for a in self.greedy):
            return 0, [], [text] if text else []
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        words: list[str] = []
        odd: list[str] = []
        for part in parts:
            for piece in [part] if PLAIN.fullmatch(part) else CUT.split(part):
                if PLAIN.fullmatch(piece):
                    words += self.find(piece)
                else:
                    odd.append(piece)
        return len(parts) - 1, words, odd

    def frequent(self, texts: Iterator[str]) -> dict[str, int]:
        seen: Counter[str] = Counter()
        for text in texts:
            seen.update(w for w in self.pieces(text)[1] if len(w) <= LONGEST)
            if len(seen) > 32 * FREQUENT:  # rare ones go, which costs speed at most
                seen = Counter(dict(seen.most_common(8 * FREQUENT)))
        words = [w for w, _ in islice(sorted(seen.items(), key=lambda x: (-x[1], x[0])), FREQUENT)]
        return dict(zip(words, self.lengths(words), strict=True))

    def cached(self, words: set[str]) -> dict[str, int]:
        """Token counts by tier two."""
        found = {w: n for w in words if (n := self.young.get(w)) is not None}
        back = {w: n for w in words.difference(found) if (n := self.old.get(w)) is not None}
        new = list(words.difference(found, back))
        back.update(zip(new, self.lengths(new), strict=True))
        if len(self.young) + len(back) > CACHE:
            self.young, self.old = {}, self.young
        self.young.update((w, n) for w, n in islice(back.items(), CACHE) if len(w) <= LONGEST)
        return found | back

    def count(self, texts: list[str], known: Tier) -> list[int]:
        totals, misses = [], []
        for text in texts:
            special, words, odd = self.pieces(text)
            known.missed = odd
            totals.append(special + sum(map(known.__getitem__, words)))
            misses.append(odd)
        if any(misses):
            table = self.cached({w for missed in misses for w in missed})
            totals = [n + sum(map(table.__getitem__, missed)) for n, missed in zip(totals, misses, strict=True)]
        return totals


#: of this process, by path: outlives a task where workers are used again
_LOOKUPS: dict[str, Lookup | SentencePiece] = {}


def lookup(path: str) -> Lookup | SentencePiece:
    if path not in _LOOKUPS:
        _LOOKUPS[path] = SentencePiece(path) if path.endswith(".model") else Lookup(path)
    return _LOOKUPS[path]


def frequent(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> Tier:
    """Tier one: the commonest pre-tokens of SAMPLE whole texts at most, counted by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = lookup(path).frequent(t for batch in batches for t in batch["t"])
        yield pd.DataFrame({"word": list(table), "n": list(table.values())}).astype({"n": "int64"})

    rows = docs.select(F.col(text).alias("t"), F.xxhash64(key).alias("h")).where("t is not null and h % 16 = 0").limit(SAMPLE)
    return Tier((r["word"], r["n"]) for r in rows.select("t").coalesce(1).mapInPandas(run, "word string, n long").collect())


def count_tokens(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs -> (key, n_bytes, n_tokens, over_limit). path: a tokenizer file that every worker can open."""
    light_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, key, text))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch[text]]
            yield pd.DataFrame({key: batch[key], "n_bytes": batch["n_bytes"], "n_tokens": [n for part in T.runs(texts) for n in lookup(path).count(part, known.value)]})

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, text, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")).mapInPandas(run, f"`{key}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op8(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .store import table

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
