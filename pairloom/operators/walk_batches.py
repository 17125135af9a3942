"""The rules of ``walks`` on very many molecules at once, as operations on whole arrays.

Alignments come as flat columns, one molecule after another, side 1 before side 2, each side from 5' to 3'. An alignment is a number in a
pool: the given rows first, then the null alignment, then those that fill gaps. ``walks`` tells the same rules one molecule at a time; tests hold both together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace

import numpy as np

from .walks import KINDS, LEFT, POSITIONS, RIGHT, TURNS

#: what the rules look at; numbers and truths with a value in each row, chrom as codes of which UNPLACED is the marker's
CORE = ("dist_to_5", "algn_read_span", "read_len", "pos5", "pos3", "chrom", "minus", "is_mapped", "is_unique")
UNPLACED = 0
TYPES = ("N", "M", "U", "R", "W", "X")
N_, M_, U_, R_, W_, X_ = range(6)


@dataclass
class Pool:
    """CORE and dist_to_3 of given rows, of the null alignment (number ``null``) and of gaps."""

    columns: dict[str, np.ndarray]
    null: int

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def add(self, **columns: np.ndarray) -> np.ndarray:
        """Numbers of new null alignments that differ in ``columns``."""
        start, n = len(self["pos5"]), len(next(iter(columns.values())))
        self.columns = {c: np.concatenate([x, columns[c] if c in columns else np.repeat(x[self.null : self.null + 1], n)]) for c, x in self.columns.items()}
        return np.arange(start, start + n)

    @property
    def clear(self) -> np.ndarray:
        return self["is_mapped"] & self["is_unique"]


def pool(columns: Mapping[str, np.ndarray]) -> Pool:
    null = {"chrom": UNPLACED, "minus": True, "is_mapped": False, "is_unique": False}
    return Pool({c: np.concatenate([x, np.array([null.get(c, 0)], x.dtype)]) for c, x in columns.items()}, len(columns["pos5"]))


@dataclass
class Reads:
    """One side of all molecules: numbers in the pool, molecule by molecule."""

    side: int
    at: np.ndarray
    first: np.ndarray
    n: np.ndarray

    def id(self, molecule: np.ndarray, k: np.ndarray | int) -> np.ndarray:
        """The k-th alignment; beyond the ends the nearest, for places that are computed but not used."""
        return self.at[self.first[molecule] + np.clip(k, 0, self.n[molecule] - 1)]


def _before(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def running(n: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of the groups of n."""
    return np.arange(n.sum()) - np.repeat(_before(n), n)


def prepare(p: Pool, rows: np.ndarray, n: np.ndarray, side: int, max_gap: int | None) -> Reads:
    """walks.prepare: gaps filled, and a null alignment where there is none."""
    molecule, k = np.repeat(np.arange(len(n)), n), running(n)
    dist = p["dist_to_5"][rows]
    hole = np.zeros(len(rows), bool)
    if max_gap is not None and len(rows):
        base = molecule * (1 << 33)
        reach = np.maximum.accumulate(base + dist + p["algn_read_span"][rows]) - base
        covered = np.where(k == 0, 0, np.maximum(np.concatenate([[0], reach[:-1]]), 0))
        wide = (dist - covered > max_gap) & ~((n[molecule] == 1) & ~p["is_mapped"][rows])
        count = np.cumsum(wide) - wide
        earlier = count - count[_before(n)[molecule]]
        hole = wide & (k + earlier < n[molecule])
    full = n + np.bincount(molecule[hole], minlength=len(n))
    out = Reads(side, np.empty(0, np.int64), _before(np.maximum(full, 1)), np.maximum(full, 1))
    out.at = np.full(out.n.sum(), p.null)
    filled = np.cumsum(hole)
    place = out.first[molecule] + k + filled - (np.concatenate([[0], filled])[_before(n)[molecule]] if len(rows) else 0)
    out.at[place] = rows
    if hole.any():
        read_len, start = p["read_len"][rows][hole], covered[hole]
        out.at[place[hole] - 1] = p.add(dist_to_5=start, algn_read_span=dist[hole] - start, read_len=read_len, dist_to_3=read_len - dist[hole])
    return out


@dataclass
class Ends:
    """One end of many pairs."""

    id: np.ndarray
    side: np.ndarray
    idx: np.ndarray
    count: np.ndarray
    type: np.ndarray
    chrom: np.ndarray
    pos5: np.ndarray
    pos3: np.ndarray
    minus: np.ndarray

    def take(self, i: np.ndarray) -> Ends:
        return Ends(*[getattr(self, f.name)[i] for f in fields(Ends)])

    def masked(self, kind: int) -> Ends:
        zero = np.zeros_like(self.pos5)
        return replace(self, type=np.full_like(self.type, kind), chrom=np.full_like(self.chrom, UNPLACED), pos5=zero, pos3=zero, minus=np.ones_like(self.minus))


def where(condition: np.ndarray, x: Ends, y: Ends) -> Ends:
    return Ends(*[np.where(condition, getattr(x, f.name), getattr(y, f.name)) for f in fields(Ends)])


@dataclass
class Pairs:
    """Pairs in the order of molecules; kind is a code: KINDS, then for each distance those of wider pairs."""

    molecule: np.ndarray
    one: Ends
    two: Ends
    index: np.ndarray
    kind: np.ndarray

    def take(self, i: np.ndarray) -> Pairs:
        return Pairs(self.molecule[i], self.one.take(i), self.two.take(i), self.index[i], self.kind[i])


def kind_name(code: int) -> str:
    apart, seen = divmod(code, len(KINDS))
    return f"E{apart}_{KINDS[seen]}" if apart else KINDS[seen]


def together(parts: Sequence[Pairs]) -> Pairs:
    join = lambda f: np.concatenate([f(p) for p in parts])
    ends = lambda e: Ends(*[join(lambda p, f=f: getattr(getattr(p, e), f.name)) for f in fields(Ends)])
    out = Pairs(join(lambda p: p.molecule), ends("one"), ends("two"), join(lambda p: p.index), join(lambda p: p.kind))
    return out.take(np.argsort(out.molecule, kind="stable"))


def _typed(p: Pool, id_: np.ndarray, side: np.ndarray | int, idx: np.ndarray | int, count: np.ndarray | int) -> Ends:
    n = len(id_)
    kind = np.where(p.clear[id_], U_, np.where(p["is_mapped"][id_], M_, N_))
    spread = lambda x: np.broadcast_to(np.asarray(x, np.int64), n)
    return Ends(id_, spread(side), spread(idx), spread(count), kind, p["chrom"][id_], p["pos5"][id_], p["pos3"][id_], p["minus"][id_])


def _ends(p: Pool, reads: Reads, molecule: np.ndarray, k: np.ndarray | int) -> Ends:
    k = np.clip(k, 0, reads.n[molecule] - 1)
    return _typed(p, reads.id(molecule, k), reads.side, k, reads.n[molecule])


def _pairs(molecule: np.ndarray, one: Ends, two: Ends, kind: np.ndarray | int = 0) -> Pairs:
    return Pairs(molecule, one, two, np.ones(len(molecule), np.int64), np.broadcast_to(np.asarray(kind, np.int64), len(molecule)))


def _nothing(p: Pool, molecule: np.ndarray) -> Pairs:
    null = np.full(len(molecule), p.null)
    return _pairs(molecule, *[_typed(p, null, side, 0, 1).masked(X_) for side in (1, 2)])


def rescued(p: Pool, a: Reads, b: Reads, molecule: np.ndarray, max_size: int) -> np.ndarray:
    """walks.rescue for molecules with both sides: whether a single ligation is told."""
    left = a.n[molecule] == 2
    five = np.where(left, a.id(molecule, 0), b.id(molecule, 0))
    three = np.where(left, a.id(molecule, 1), b.id(molecule, 1))
    linear = np.where(left, b.id(molecule, 0), a.id(molecule, 0))
    span = np.where(p["minus"][linear], -1, 1) * (p["pos5"][three] - p["pos5"][linear])
    facing = (p["chrom"][three] == p["chrom"][linear]) & (p["minus"][three] != p["minus"][linear]) & (span > 0)
    fits = facing & (span + p["dist_to_5"][three] + p["dist_to_5"][linear] <= max_size)
    return (a.n[molecule] + b.n[molecule] == 3) & p.clear[linear] & (~(p["is_mapped"][three] & p["is_unique"][five]) | fits)


def _pick(p: Pool, reads: Reads, policy: str) -> np.ndarray:
    """The place that walks._pick picks, in every molecule."""
    last = reads.n - 1
    k = running(reads.n)
    if policy == "5any":
        return np.zeros_like(last)
    if policy == "3any":
        return last
    clear = p.clear[reads.at]
    if policy == "5unique":
        found = np.minimum.reduceat(np.where(clear, k, len(k)), reads.first)
        return np.where(found > last, 0, found)
    found = np.maximum.reduceat(np.where(clear, k, -1), reads.first)
    return np.where(found < 0, last, found)


def _alike(p: Pool, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    cx, cy = p.clear[x], p.clear[y]
    return np.where(cx & cy, (p["chrom"][x] == p["chrom"][y]) & (p["minus"][x] != p["minus"][y]), cx == cy)


def overlap_lengths(p: Pool, a: Reads, b: Reads, molecule: np.ndarray, slack: int) -> np.ndarray:
    """walks.overlap_length of each molecule. Molecules leave a round at their first junction that differs."""
    out = np.zeros(len(molecule), np.int64)
    most = np.minimum(a.n[molecule], b.n[molecule]) - 1
    open_ = np.flatnonzero(most > 0)
    for m in range(1, int(most.max(initial=0)) + 1):
        open_ = open_[most[open_] >= m]
        same = open_
        for j in range(m):
            if not len(same):
                break
            w, i = molecule[same], m - 1 - j
            l5, l3 = (a.id(w, a.n[w] - j - 2), a.id(w, a.n[w] - j - 1))
            r5, r3 = (b.id(w, b.n[w] - i - 2), b.id(w, b.n[w] - i - 1))
            match = _alike(p, l5, r3) & _alike(p, l3, r5)
            match &= (np.abs(p["pos3"][l5] - p["pos5"][r3]) <= slack) & (np.abs(p["pos5"][l3] - p["pos3"][r5]) <= slack)
            same = same[match]
        out[same] = m
        open_ = open_[out[open_] == 0]
    return out


def ends_overlap(p: Pool, x: np.ndarray, y: np.ndarray, max_insert: int, slack: int) -> np.ndarray:
    """walks.ends_overlap."""
    cx, cy = p.clear[x], p.clear[y]
    turned = p["minus"][x]
    plus, minus = np.where(turned, y, x), np.where(turned, x, y)
    outer = p["pos5"][minus] - p["pos5"][plus]
    longest = np.maximum(p["pos3"][plus] - p["pos5"][plus], p["pos5"][minus] - p["pos3"][minus])
    piece = (p["chrom"][x] == p["chrom"][y]) & (p["minus"][x] != p["minus"][y]) & (longest - slack <= outer) & (outer <= max_insert + slack)
    return np.where(cx & cy, piece, ~cx & ~cy)


def _turned(e: Ends, strand: np.ndarray, place: np.ndarray) -> Ends:
    return replace(e, minus=e.minus ^ strand, pos5=np.where(place, e.pos3, e.pos5), pos3=np.where(place, e.pos5, e.pos3))


def reported(pairs: Pairs, position: str, orientation: str) -> Pairs:
    """walks.report: ends turned by what is asked and by where a pair was seen."""
    strand, place = ([TURNS[t].get(k, (False, False)) for k in KINDS] for t in (orientation, POSITIONS[position]))
    s, q = np.array(strand)[pairs.kind], np.array(place)[pairs.kind]
    return replace(pairs, one=_turned(pairs.one, s[:, 0], q[:, 0]), two=_turned(pairs.two, s[:, 1], q[:, 1]))


def walk_pairs(p: Pool, a: Reads, b: Reads | None, molecule: np.ndarray, max_insert: int, position: str = "outer", orientation: str = "pair", slack: int = 3) -> Pairs:
    """walks.walk_pairs of molecules with two alignments at least."""
    na = a.n[molecule]
    if b is None:
        nb = shared = np.zeros(len(molecule), np.int64)
        meet = np.zeros(len(molecule), bool)
    else:
        nb, shared = b.n[molecule], overlap_lengths(p, a, b, molecule, slack)
        meet = (shared == 0) & ends_overlap(p, a.id(molecule, na - 1), b.id(molecule, b.n[molecule] - 1), max_insert, slack)
    common = np.where(shared > 0, shared + 1, meet)
    joints = na + nb - common - 1
    w, k = np.repeat(np.arange(len(molecule)), joints), running(joints)
    seen = np.where(k + 1 < na[w], LEFT, 0) | np.where(k >= (na - common)[w], RIGHT, 0)
    only, from_end = seen == RIGHT, joints[w] - 1 - k
    told = ~only | (meet[w] & (k == na[w] - 1)) | (from_end <= shared[w])
    w, k, seen = w[told], k[told], seen[told]
    which, na, common, meet = molecule[w], na[w], common[w], meet[w]
    left = lambda at: _ends(p, a, which, at)
    right = (lambda at: _ends(p, b, which, b.n[which] - 1 - (at - na + common))) if b is not None else left
    both = lambda at: (at < na) & (at >= na - common)
    views = [(left(at), right(at)) for at in (k, k + 1)]
    out = []
    for (l, r), from_right, other in zip(views, (seen == RIGHT, (seen == RIGHT) | (seen == 0)), ((seen != LEFT | RIGHT) & meet & both(k), (seen == LEFT | RIGHT) | meet & both(k + 1)), strict=True):
        e = where(from_right, r, l)
        out.append(replace(e, pos3=np.where(other, np.where(seen != RIGHT, r.pos5, l.pos5), e.pos3)))
    n = np.bincount(w, minlength=len(molecule))
    return reported(Pairs(which, *out, running(n) + 1, seen), position, orientation)


def expand(pairs: Pairs, depth: int | None) -> Pairs:
    """walks.expand: a pass for every distance, of pairs that have one so far on."""
    n = len(pairs.molecule)
    last = np.searchsorted(pairs.molecule, pairs.molecule, side="right") - 1 - np.arange(n)
    begin, end, kind = [np.arange(n)], [np.arange(n)], [pairs.kind]
    for apart in range(1, int(last.max(initial=0)) + 1):
        if depth is not None and apart > depth:
            break
        i = np.flatnonzero(last >= apart)
        seen = pairs.kind[i] & pairs.kind[i + apart]
        if depth is not None:
            i, seen = i[seen > 0], seen[seen > 0]
        begin, end, kind = [*begin, i], [*end, i + apart], [*kind, seen + apart * len(KINDS)]
    i, j, kind = np.concatenate(begin), np.concatenate(end), np.concatenate(kind)
    by = np.lexsort((j, i))
    i, j = i[by], j[by]
    return Pairs(pairs.molecule[i], pairs.one.take(i), pairs.two.take(j), pairs.index[i], kind[by])


def parse(p: Pool, rows: Sequence[np.ndarray], n: Sequence[np.ndarray], policy: str, max_size: int, max_gap: int | None) -> Pairs:
    """walks.parse_molecule of all molecules; rows and n: each side's alignments and how many a molecule has."""
    empty = np.minimum(*n) == 0
    if policy == "all":
        empty &= n[0] + n[1] < 2
    a, b = (prepare(p, r, c, side, max_gap) for r, c, side in zip(rows, n, (1, 2), strict=True))
    one = ~empty & (a.n == 1) & (b.n == 1)
    nothing, simple, rest = (np.flatnonzero(x) for x in (empty, one, ~empty & ~one))
    out = [_nothing(p, nothing), _pairs(simple, _ends(p, a, simple, 0), _ends(p, b, simple, 0))]
    if policy == "all":
        return together([*out, walk_pairs(p, a, b, rest, max_size)])
    single = rescued(p, a, b, rest, max_size)
    w = rest[single]
    x, y, left = _ends(p, a, w, 0), _ends(p, b, w, 0), a.n[w] == 2
    out.append(_pairs(w, replace(x, type=np.where(left, x.type, R_)), replace(y, type=np.where(left, R_, y.type)), np.where(left, LEFT, RIGHT)))
    w = rest[~single]
    if policy == "mask":
        return together([*out, _pairs(w, _ends(p, a, w, 0).masked(W_), _ends(p, b, w, 0).masked(W_))])
    return together([*out, _pairs(w, *[_ends(p, r, w, _pick(p, r, policy)[w]) for r in (a, b)])])


def parse_all(p: Pool, rows: Sequence[np.ndarray], n: Sequence[np.ndarray], max_gap: int | None, max_insert: int = 500, position: str = "outer", orientation: str = "pair", slack: int = 3, single_end: bool = False, expanded: bool = False, depth: int | None = None) -> Pairs:
    """walks.parse_molecule_all of all molecules."""
    finish = lambda found: expand(found, depth) if expanded else found
    if single_end:
        a = prepare(p, rows[1], n[1], 1, max_gap)
        alone, rest = np.flatnonzero(a.n == 1), np.flatnonzero(a.n > 1)
        other = _typed(p, np.full(len(alone), p.null), 0, 0, 0)
        return together([_pairs(alone, _ends(p, a, alone, 0), other, LEFT), finish(walk_pairs(p, a, None, rest, max_insert, position, orientation, slack))])
    empty = (np.minimum(*n) == 0) & (n[0] + n[1] < 2)
    a, b = (prepare(p, r, c, side, max_gap) for r, c, side in zip(rows, n, (1, 2), strict=True))
    one = ~empty & (a.n == 1) & (b.n == 1)
    nothing, simple, rest = (np.flatnonzero(x) for x in (empty, one, ~empty & ~one))
    plain = reported(_pairs(simple, _ends(p, a, simple, 0), _ends(p, b, simple, 0)), position, orientation)
    return together([_nothing(p, nothing), plain, finish(walk_pairs(p, a, b, rest, max_insert, position, orientation, slack))])
