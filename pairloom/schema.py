"""Names, types and sentinels of pair tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: fixed values of the format
UNMAPPED_CHROM, UNMAPPED_POS, UNMAPPED_STRAND = "!", 0, "-"
UNANNOTATED_FRAGMENT = -1
SAM_SEP = "\x19"
NEXT_SAM = "NEXT_SAM"
RECORD_SEP = SAM_SEP + NEXT_SAM + SAM_SEP
FORMAT_LINE = "## pairs format v1.0.0"

PAIRS = ["readID", "chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2", "pair_type"]
PAIRSAM = [*PAIRS, "sam1", "sam2"]

#: columns that are whole numbers wherever they occur; each but the first two families is suffixed 1 or 2
_LONG = ["pos", "pos5", "pos3", "rfrag", "rfrag_start", "rfrag_end"]
_INT = ["mapq", "read_len", "matched_bp", "algn_ref_span", "algn_read_span", "dist_to_5", "dist_to_3", "read_side", "algn_idx", "same_side_algn_count"]
_STRING = ["chrom", "strand", "sam", "cigar", "seq", "mismatches", "phase"]


def column_type(name: str) -> T.DataType:
    """Type of a column by its name; unknown names (SAM tags among them) are text."""
    base = name[:-1] if name[-1:] in "12" else name
    if name == "walk_pair_index" or base in _INT:
        return T.IntegerType()
    return T.LongType() if base in _LONG else T.StringType()


def sides(columns: list[str]) -> list[tuple[str, str]]:
    """The column pairs X1, X2 of a table."""
    return [(c, c[:-1] + "2") for c in columns if c.endswith("1") and c[:-1] + "2" in columns]
