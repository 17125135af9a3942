"""Haplotype phasing from alternative hits, inside generated code.

Chromosomes carry a haplotype suffix. Per mapped side: a primary hit that scores above the second one has
the phase of its suffix; a tie of three hits is multi-mapped; else a first alternative hit on the homologue means unresolved
(``.``); anything else is multi-mapped (``!``), and the side loses its place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PAIRSAM, UNMAPPED_CHROM, UNMAPPED_POS, UNMAPPED_STRAND

NEEDS = {"XB": ("XB", "AS", "XS"), "XA": ("XA", "NM", "AS", "XS")}


def chrom_phase(chrom: Column, suffixes: Sequence[str]) -> tuple[Column, Column]:
    """(0, 1 or !; name without the suffix)."""
    a, b = suffixes
    if not a or not b:
        raise ValueError("suffixes must not be empty")
    base = lambda s: F.substring(chrom, F.lit(1), F.length(chrom) - len(s))
    phase = F.when(chrom.endswith(a), F.lit("0")).when(chrom.endswith(b), F.lit("1")).otherwise(F.lit("!"))
    return phase, F.when(chrom.endswith(a), base(a)).when(chrom.endswith(b), base(b)).otherwise(chrom)


def _side(i: int, mode: str, suffixes: Sequence[str]) -> tuple[Column, Column, list[Column]]:
    """(phase, base chromosome or !, three scores) of one side."""
    number = lambda c: c.cast("long")
    tag = F.col(f"{mode}{i}")
    score, second = number(F.col(f"AS{i}")), number(F.col(f"XS{i}"))
    hits = F.filter(F.split(F.coalesce(tag, F.lit("")), ";"), lambda h: F.length(F.trim(h)) > 0)
    first, other = F.split(F.get(hits, F.lit(0)), ","), F.split(F.get(hits, F.lit(1)), ",")
    phase, base = chrom_phase(F.col(f"chrom{i}"), suffixes)
    alt_phase, alt_base = chrom_phase(F.get(first, F.lit(0)), suffixes)
    homologue = (base == alt_base) & (((phase == "0") & (alt_phase == "1")) | ((phase == "1") & (alt_phase == "0")))
    clear, n = score > second, F.size(hits)
    if mode == "XB":
        own = number(F.get(other, F.lit(4)))
        tie = (n >= 2) & (own == second) & (second == score)
        scores = [score, second, F.when(~clear & (n >= 2), own).otherwise(-1)]
    else:
        nm, alt, third = number(F.col(f"NM{i}")), number(F.get(first, F.lit(3))), number(F.get(other, F.lit(3)))
        tie = (n >= 2) & (third == alt) & (alt == nm)
        scores = [nm, F.when(n >= 1, alt).otherwise(-1), F.when(~clear & (n >= 2), third).otherwise(-1)]
    unresolved = ~clear & ~F.coalesce(tie, F.lit(False)) & (n >= 1) & homologue
    out = F.when(clear, phase).when(unresolved, F.lit(".")).otherwise(F.lit("!"))
    return out, F.when(clear | unresolved, base).otherwise(F.lit(UNMAPPED_CHROM)), scores


def phase(df: DataFrame, suffixes: Sequence[str], mode: str = "XB", report_scores: bool = False, clean: bool = False) -> DataFrame:
    """df + phase1, phase2 (and S1_1 .. S3_2 or M1_1 .. M3_2); ``clean`` drops all columns but the standard and the new ones."""
    if mode not in NEEDS:
        raise ValueError("mode must be XB or XA")
    missing = [f"{t}{i}" for t in NEEDS[mode] for i in (1, 2) if f"{t}{i}" not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    changes, fresh = {}, []
    letters = []
    for i in (1, 2):
        mapped = F.col(f"chrom{i}") != UNMAPPED_CHROM
        ph, base, scores = _side(i, mode, suffixes)
        lost = mapped & (base == UNMAPPED_CHROM)
        changes[f"phase{i}"] = F.when(mapped, ph).otherwise(F.lit("!"))
        changes[f"chrom{i}"] = F.when(mapped, base).otherwise(F.col(f"chrom{i}"))
        changes[f"pos{i}"] = F.when(lost, F.lit(UNMAPPED_POS)).otherwise(F.col(f"pos{i}"))
        changes[f"strand{i}"] = F.when(lost, F.lit(UNMAPPED_STRAND)).otherwise(F.col(f"strand{i}"))
        letters.append(F.when(lost, F.lit("M")).otherwise(F.substring("pair_type", i, 1)))
        fresh.append(f"phase{i}")
        if report_scores:
            for k, s in enumerate(scores, 1):
                name = f"{'S' if mode == 'XB' else 'M'}{k}_{i}"
                changes[name] = F.when(mapped, s).otherwise(-1).cast("long")
                fresh.append(name)
    changes["pair_type"] = F.concat(*letters)
    names = [c for c in df.columns if not clean or c in PAIRSAM] + [c for c in fresh if c not in df.columns]
    if report_scores:
        order = ["phase1", "phase2", *[f"{'S' if mode == 'XB' else 'M'}{k}_{i}" for k in (1, 2, 3) for i in (1, 2)]]
        names = [c for c in names if c not in order] + order
    return df.withColumns(changes).select(*names)
