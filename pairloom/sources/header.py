"""Headers of pair files: small, read from the first lines, kept on the driver beside the lazy table.

A header is an immutable sequence of lines, with views of what they say. Every change gives a new header.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from .. import __version__
from ..schema import FORMAT_LINE, PAIRS

SORTED = "#sorted: chr1-chr2-pos1-pos2"
#: entries that files must agree on to be merged
COMMON = ("## pairs format", "#sorted:", "#shape:", "#genome_assembly:", "#columns:")


class HeaderError(ValueError):
    """A header is missing, malformed, or does not fit another one."""


def _keyed(line: str, key: str) -> bool:
    return line.startswith(f"#{key}:")


@dataclass(frozen=True)
class Header:
    lines: tuple[str, ...] = field(default=())

    # -- reading

    @classmethod
    def parse(cls, lines: Iterable[str]) -> Header:
        """The leading lines that begin with #."""
        out = []
        for line in lines:
            if not line.startswith("#"):
                break
            out.append(line.rstrip("\n"))
        return cls(tuple(out))

    @classmethod
    def standard(cls, chromsizes: Mapping[str, int] | None = None, assembly: str | None = None, columns: Sequence[str] = PAIRS, shape: str = "upper triangle") -> Header:
        lines = [FORMAT_LINE, f"#shape: {shape}", f"#genome_assembly: {assembly or 'unknown'}"]
        lines += [f"#chromsize: {c} {n}" for c, n in (chromsizes or {}).items()]
        return cls((*lines, "#columns: " + " ".join(columns)))

    @property
    def is_empty(self) -> bool:
        return not self.lines or not self.lines[0].startswith("##")

    def values(self, key: str) -> list[str]:
        """What follows ``#key:`` in each line that has it."""
        return [line[len(key) + 2 :].strip() for line in self.lines if _keyed(line, key)]

    @property
    def columns(self) -> list[str]:
        found = self.values("columns")
        return found[0].split() if found else []

    @property
    def chromsizes(self) -> dict[str, int]:
        return {v.split()[0]: int(v.split()[1]) for v in self.values("chromsize")}

    @property
    def samheader(self) -> list[str]:
        return self.values("samheader")

    @property
    def is_sorted(self) -> bool:
        return any(line.startswith("#sorted") for line in self.lines)

    def render(self) -> str:
        return "".join(f"{line}\n" for line in self.lines)

    # -- changing

    def _need(self) -> None:
        if self.is_empty:
            raise HeaderError("not a pairs file, or it has no header")

    def with_columns(self, columns: Sequence[str]) -> Header:
        """The column line replaced, or added at the end."""
        line = "#columns: " + " ".join(columns)
        if self.values("columns"):
            return Header(tuple(line if _keyed(old, "columns") else old for old in self.lines))
        return Header((*self.lines, line))

    def append_columns(self, columns: Sequence[str]) -> Header:
        return self.with_columns([*self.columns, *columns])

    def subset_chroms(self, chroms: Iterable[str]) -> Header:
        keep = set(chroms)
        out = []
        for line in self.lines:
            if _keyed(line, "chromsize") and line.split()[1] not in keep:
                continue
            if _keyed(line, "chromosomes"):
                line = " ".join(["#chromosomes:", *[c for c in line.split()[1:] if c in keep]])
            out.append(line)
        return Header(tuple(out))

    def mark_sorted(self) -> Header:
        self._need()
        lines = [" ".join(["#chromosomes:", *sorted(line.split()[1:])]) if _keyed(line, "chromosomes") else line for line in self.lines]
        return Header(tuple(lines if self.is_sorted else [lines[0], SORTED, *lines[1:]]))

    def with_samheader(self, sam: Sequence[str]) -> Header:
        """The SAM header lines replaced; they stand before the column line."""
        rest = [line for line in self.lines if not _keyed(line, "samheader")]
        last = [line for line in rest if _keyed(line, "columns")]
        return Header((*[line for line in rest if not _keyed(line, "columns")], *[f"#samheader: {s}" for s in sam], *last))

    def add_program(self, name: str, command: str = "", version: str = __version__) -> Header:
        """A @PG record behind every chain of programs; chains of merged files get the branch and place in the id."""
        self._need()
        sam = self.samheader
        chains = program_chains(sam)
        head = [s for s in sam if s.startswith(("@HD", "@SQ", "@RG"))]
        rest = [s for s in sam if not s.startswith(("@HD", "@SQ", "@RG", "@PG"))]
        records = []
        for i, chain in enumerate(chains or [[]], 1):
            ident = f"{name}-{i}.{len(chain) + 1}" if len(chains) > 1 else name
            parent = [("PP", record_id(chain[-1]))] if chain else []
            records += [*chain, "\t".join(["@PG", *[f"{k}:{v}" for k, v in [("ID", ident), ("PN", name), ("CL", command), *parent, ("VN", version)]]])]
        return self.with_samheader([*head, *records, *rest])

    # -- checking

    def fits(self, row: str | Sequence[str]) -> bool:
        """Whether a body line has as many fields as the header has columns."""
        return len(row.split("\t") if isinstance(row, str) else row) == len(self.columns)


def record_fields(record: str) -> dict[str, str]:
    return dict(f.split(":", 1) for f in record.split("\t")[1:] if ":" in f)


def record_id(record: str) -> str:
    return record_fields(record).get("ID", "")


def program_chains(sam: Sequence[str]) -> list[list[str]]:
    """The @PG records as chains from the first program to the last, one per record that no other follows."""
    records = [s for s in sam if s.startswith("@PG")]
    by_id: dict[str, str] = {}
    for r in records:
        if by_id.setdefault(record_id(r), r) != r:
            raise HeaderError(f"two programs have the id {record_id(r)}")
    followed = {record_fields(r).get("PP") for r in records}
    chains = []
    for r in records:
        if record_id(r) in followed:
            continue
        chain, seen = [r], {record_id(r)}
        while (parent := record_fields(chain[0]).get("PP")) is not None:
            if parent not in by_id or parent in seen:
                raise HeaderError(f"the program {record_id(chain[0])} follows {parent}, which is not there")
            seen.add(parent)
            chain.insert(0, by_id[parent])
        chains.append(chain)
    if records and not chains:
        raise HeaderError("programs follow each other in a circle")
    return chains


def merge_chromosomes(*lists: Sequence[str]) -> list[str]:
    """All names, sorted. Lists whose orders contradict each other raise."""
    after: dict[str, set[str]] = {c: set() for names in lists for c in names}
    for names in lists:
        for a, b in zip(names[:-1], names[1:], strict=True):
            if a != b:
                after[a].add(b)
    waits = {c: sum(c in later for later in after.values()) for c in after}
    free = [c for c, n in waits.items() if not n]
    done = 0
    while free:
        done += 1
        for b in after[free.pop()]:
            waits[b] -= 1
            if not waits[b]:
                free.append(b)
    if done < len(after):
        raise HeaderError("chromosomes come in contradicting orders")
    return sorted(after)


def _merge_sam(headers: Sequence[Sequence[str]], force: bool) -> list[str]:
    first = {s for h in headers for s in h if s.startswith("@HD")}
    if len(first) > 1 and not force:
        raise HeaderError("the @HD lines differ")
    sequences = [[s for s in h if s.startswith("@SQ")] for h in headers]
    if any(set(s) != set(sequences[0]) for s in sequences) and not force:
        raise HeaderError("the @SQ lines differ")
    programs = []
    for i, h in enumerate(headers, 1):
        for s in h:
            if s.startswith("@PG"):
                programs.append("\t".join(f"{f}-{i}" if f.startswith(("ID:", "PP:")) else f for f in s.split("\t")))
    rest = [s for h in headers for s in dict.fromkeys(h) if not s.startswith(("@HD", "@SQ", "@PG"))]
    return [*sorted(first)[:1], *sequences[0], *programs, *rest]


def merge_headers(headers: Sequence[Header], force: bool = False) -> Header:
    """One header of several: common entries must agree, chromosomes unite, programs get the file's number."""
    if not headers:
        raise HeaderError("nothing to merge")
    plain = [[line for line in h.lines if not _keyed(line, "samheader")] for h in headers]
    out: list[str] = []
    for key in COMMON:
        found = [[line for line in p if line.startswith(key)] for p in plain]
        if any(f != found[0] for f in found):
            raise HeaderError(f"the files do not agree on {key}")
        out += found[0]
    sizes: dict[str, int] = {}
    for h in headers:
        for c, n in h.chromsizes.items():
            if sizes.setdefault(c, n) != n and not force:
                raise HeaderError(f"the files do not agree on the size of {c}")
    names = merge_chromosomes(*[list(h.chromsizes) for h in headers])
    if any(h.values("chromosomes") for h in headers):
        out.append(" ".join(["#chromosomes:", *names]))
    out += [f"#chromsize: {c} {sizes[c]}" for c in names]
    other = sorted({line for p in plain for line in p if not line.startswith((*COMMON, "#chromosomes", "#chromsize"))})
    columns = [line for line in out if _keyed(line, "columns")]
    merged = Header((*[line for line in out if not _keyed(line, "columns")], *other, *columns))
    return merged.with_samheader(_merge_sam([h.samheader for h in headers], force))


def same_columns(headers: Sequence[Header]) -> bool:
    return all(h.columns == headers[0].columns for h in headers)


def transfer(body: Header, donor: Header) -> Header:
    """The donor's header for another file's rows; the numbers of columns must agree."""
    if body.columns and donor.columns and len(body.columns) != len(donor.columns):
        raise HeaderError("the numbers of columns differ")
    return donor
