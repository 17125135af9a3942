"""Vectorised word hashing.

A batch of texts becomes one UTF-8 buffer; every word gets a 64-bit hash from prefix sums of
``byte * BASE**position`` (arithmetic modulo 2**64, BASE odd and so invertible), without a Python loop
over words. Equal words have equal hashes wherever they stand. Buffers are cut at word ends into
pieces of about ``PIECE`` bytes, so memory stays flat for very long texts.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64

WHITE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def _lut_lower() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    return lut


def _lut_white() -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[list(WHITE)] = True
    return lut


def _lut_not_alnum() -> np.ndarray:
    """ASCII bytes other than letters and digits; bytes of multi-byte characters belong to words."""
    lut = np.zeros(256, bool)
    lut[:128] = True
    for a, b in ((48, 58), (65, 91), (97, 123)):
        lut[a:b] = False
    return lut


LOWER, SPLIT_WHITE, SPLIT_PUNCT = _lut_lower(), _lut_white(), _lut_not_alnum()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    """BASE**i and its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                powers = np.full(n, _U(base), _U)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()
_VALUE = mix64(np.arange(1, 257, dtype=_U))


def encode(texts) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, each followed by a line feed, and the offsets of the texts; null counts as empty."""
    parts = [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n" if parts else b"", np.uint8), offsets


def _pieces(is_split: np.ndarray):
    """Cuts (from, to) behind separators, about PIECE bytes apart; a longer word stays whole."""
    n, at = len(is_split), 0
    while at < n:
        to = min(n, at + PIECE)
        while to < n and not is_split[to - 1]:
            step = min(n, to + 4096)
            found = np.flatnonzero(is_split[to:step])
            to = to + int(found[0]) + 1 if len(found) else step
        yield at, to
        at = to


def word_hashes(texts, split: np.ndarray = SPLIT_WHITE, lower: bool = True, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets of each text's words); with prefix, of the words' first bytes."""
    buf, offsets = encode(texts)
    if lower:
        buf = LOWER[buf]
    hashes, starts = [], []
    sep = split[buf]
    for at, to in _pieces(sep):
        b, s = buf[at:to], sep[at:to]
        if at and not sep[at - 1]:
            raise AssertionError("a piece starts inside a word")
        edge = np.flatnonzero(np.diff(np.concatenate(([True], s, [True]))))
        start, end = edge[0::2], edge[1::2]
        if not len(start):
            continue
        if prefix:
            end = np.minimum(end, start + prefix)
        up, down = _POWERS.get(len(b))
        total = np.zeros(len(b) + 1, _U)
        np.cumsum(_VALUE[b] * up, out=total[1:])
        hashes.append(mix64((total[end] - total[start]) * down[start] + (end - start).astype(_U)))
        starts.append(start + at)
    if not hashes:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-word shingles in order and each text's offsets; a text of 1..k-1 words has its whole sequence as one."""
    n = np.diff(offsets)
    rolled = np.zeros(max(0, len(hashes) - k + 1), _U)
    for j in range(k):
        rolled += mix64(hashes[j : j + len(rolled)] + _U(j + 1)) * _U(2 * j + 1)
    rolled = mix64(rolled + _U(k))
    owner = np.repeat(np.arange(len(n)), n)
    inside = owner[: len(rolled)] == owner[k - 1 :] if len(rolled) else np.zeros(0, bool)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_offsets = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(out_offsets[-1], _U)
    long_owner = (n >= k)[owner[: len(rolled)]][inside] if len(rolled) else np.zeros(0, bool)
    place = np.ones(len(out), bool)
    for i in np.flatnonzero((n > 0) & (n < k)):
        j = np.arange(int(n[i]), dtype=_U)
        whole = (mix64(hashes[offsets[i] : offsets[i + 1]] + j + _U(1)) * (j * _U(2) + _U(1))).sum(dtype=_U, keepdims=True)
        out[out_offsets[i]] = mix64(whole + _U(int(n[i])))[0]
        place[out_offsets[i]] = False
    out[place] = rolled[inside][long_owner]
    return out, out_offsets


def cuts(texts: list, limit: int) -> list[int]:
    """Where to cut a list so that its parts' texts sum to about ``limit`` characters; a longer text stands alone."""
    size, at = 0, [0]
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if i > at[-1] and size + n > limit:
            at.append(i)
            size = 0
        size += n
    return [*at, len(texts)] if len(texts) else [0]


def chunks(frame, column: str, limit: int = 1 << 18):
    """Slices of a pandas frame by the sizes of its texts."""
    at = cuts(frame[column].tolist(), limit)
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        yield frame.iloc[lo:hi]


def runs(texts: list, limit: int = 1 << 18):
    """Slices of a list by the sizes of its texts."""
    at = cuts(texts, limit)
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        yield texts[lo:hi]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=_U).view(np.int64)
