"""Statistics of pair tables as a long table (filter, key, value), and what is derived from it.

All counts come from grouped sums that Spark combines before the shuffle; what reaches the driver (reports, summaries)
is a table whose size depends on the number of chromosomes and distance bins, not on the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.conditions import compile_condition
from ..schema import UNMAPPED_CHROM
from .rows import tile

STRANDS = ("++", "+-", "-+", "--")
CIS_KB = (1, 2, 4, 10, 20, 40)
NO_FILTER = "no_filter"
REL_THRESHOLD = 0.05


def distance_edges(per_decade: int = 8, decades: int = 9) -> list[int]:
    """0 and the rounded powers of ten, ``per_decade`` to a decade."""
    return sorted({0, *(round(10 ** (k / per_decade)) for k in range(decades * per_decade + 1))})


def with_bin(df: DataFrame, value: Column, edges: list[int], name: str = "min_dist") -> DataFrame:
    """df + the last edge <= value, null below the first one and for nulls. A binary search a row, in compiled code."""
    inner = [float(e) for e in edges]
    split = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol="value_", outputCol="bin_", handleInvalid="keep")
    binned = split.transform(df.withColumn("value_", value.cast("double")))
    edge = F.get(F.array(*[F.lit(e).cast("long") for e in edges]), F.col("bin_").cast("int") - 1)
    return binned.withColumn(name, F.when(F.col("value_").isNotNull(), edge)).drop("value_", "bin_")


def tagged(df: DataFrame, filters: Mapping[str, str] | None = None) -> DataFrame:
    """df, each row once per filter that it meets, in a column ``filter``; ``no_filter`` is always there."""
    tags = [F.lit(NO_FILTER)]
    for name, condition in (filters or {}).items():
        tags.append(F.when(compile_condition(condition, df.columns), F.lit(name)))
    return df.withColumn("filter", F.explode(F.filter(F.array(*tags), lambda t: t.isNotNull())))


def _with_flags(df: DataFrame) -> DataFrame:
    a, b = F.col("chrom1") != UNMAPPED_CHROM, F.col("chrom2") != UNMAPPED_CHROM
    dup = F.col("duplicate").cast("boolean") if "duplicate" in df.columns else F.col("pair_type") == "DD"
    df = df.withColumns({"mapped_": a & b, "unmapped_": ~a & ~b, "dup_": dup})
    nodup = F.col("mapped_") & ~F.col("dup_")
    return df.withColumns({"nodup_": nodup, "cis_": nodup & (F.col("chrom1") == F.col("chrom2")), "dist_": F.abs(F.col("pos2") - F.col("pos1"))})


def totals(df: DataFrame, filters: Mapping[str, str] | None = None) -> DataFrame:
    """(filter, total, total_unmapped, total_single_sided_mapped, total_mapped, total_dups, total_nodups, cis, trans, cis_1kb+ ...)."""
    n = lambda c: F.count_if(c).cast("long")
    t = _with_flags(tagged(df, filters))
    return t.groupBy("filter").agg(
        F.count("*").alias("total"),
        n(F.col("unmapped_")).alias("total_unmapped"),
        n(~F.col("unmapped_") & ~F.col("mapped_")).alias("total_single_sided_mapped"),
        n(F.col("mapped_")).alias("total_mapped"),
        n(F.col("mapped_") & F.col("dup_")).alias("total_dups"),
        n(F.col("nodup_")).alias("total_nodups"),
        n(F.col("cis_")).alias("cis"),
        n(F.col("nodup_") & ~F.col("cis_")).alias("trans"),
        *[n(F.col("cis_") & (F.col("dist_") >= kb * 1000)).alias(f"cis_{kb}kb+") for kb in CIS_KB],
    )


def pair_types(df: DataFrame, filters: Mapping[str, str] | None = None) -> DataFrame:
    return tagged(df, filters).groupBy("filter", "pair_type").agg(F.count("*").alias("n"))


def chrom_freq(df: DataFrame, filters: Mapping[str, str] | None = None) -> DataFrame:
    return _with_flags(tagged(df, filters)).where("nodup_").groupBy("filter", "chrom1", "chrom2").agg(F.count("*").alias("n"))


def dist_freq(df: DataFrame, filters: Mapping[str, str] | None = None, edges: list[int] | None = None) -> DataFrame:
    """(filter, min_dist, max_dist, strands, n) for every bin and strand pair, zeros included; the last bin has no max_dist."""
    edges = edges or distance_edges()
    spark = df.sparkSession
    counts = with_bin(_with_flags(tagged(df, filters)).where("cis_"), F.col("dist_"), edges).groupBy("filter", "min_dist", F.concat("strand1", "strand2").alias("strands")).agg(F.count("*").alias("n"))
    names = [NO_FILTER, *(filters or {})]
    frame = [(f, lo, hi, s) for f in names for lo, hi in zip(edges, [*edges[1:], None], strict=True) for s in STRANDS]
    frame = spark.createDataFrame(frame, "filter string, min_dist long, max_dist long, strands string")
    return frame.join(counts, ["filter", "min_dist", "strands"], "left").select("filter", "min_dist", "max_dist", "strands", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _fraction(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def summary(totals_table: DataFrame) -> DataFrame:
    """filter, frac_cis, frac_cis_1kb+ ..., frac_dups, complexity_naive."""
    cis = ["cis", *[f"cis_{kb}kb+" for kb in CIS_KB]]
    return totals_table.select(
        "filter",
        *[_fraction(f"`{c}`", "total_nodups").alias(f"frac_{c}") for c in cis],
        _fraction("total_dups", "total_mapped").alias("frac_dups"),
        complexity(F.col("total_mapped"), F.col("total_dups")).alias("complexity_naive"),
    )


def complexity(n: Column, dups: Column, optical: Column | None = None, steps: int = 80) -> Column:
    """Size X of a library of which n reads hold ``dups`` duplicates: u = X / n * (1 - exp(-n / X)), u the unique share.

    Solved for y = n / X in (0, 1 / u] by bisection inside the row. 0 where n is 0 or all reads are
    duplicates; null where there is no duplicate (the estimate is unbounded).
    """
    if optical is not None:
        n, dups = n - optical, dups - optical
    n, dups = n.cast("double"), dups.cast("double")
    u = F.try_divide(n - dups, n)
    start = F.struct(F.lit(0.0).alias("lo"), F.try_divide(F.lit(1.0), u).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        high = (1 - F.exp(-mid)) < u * mid
        return F.struct(F.when(high, s["lo"]).otherwise(mid).alias("lo"), F.when(high, mid).otherwise(s["hi"]).alias("hi"))

    y = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["hi"]
    return F.when((n == 0) | (u == 0), F.lit(0.0)).when(dups > 0, F.try_divide(n, y))


def library_complexity(n: int, dups: int, optical: int = 0) -> float | None:
    """The same for numbers on the driver."""
    n, dups = n - optical, dups - optical
    if n == 0 or n == dups:
        return 0.0
    if dups <= 0:
        return None
    u = (n - dups) / n
    lo, hi = 0.0, 1 / u
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if 1 - math.exp(-mid) < u * mid else (mid, hi)
    return n / hi


def convergence(hist: Iterable[tuple[int, int | None, str, int]], cis: int, total_mapped: int, total_nodups: int, threshold: float = REL_THRESHOLD) -> dict:
    """Where the four strand pairs' counts by distance become alike.

    hist: rows (min_dist, max_dist, strands, n) of one filter. The result has the upper edge of the last bin in which a strand
    pair deviates from the mean of the four by more than the threshold, that strand pair, and counts and shares of cis pairs
    below and above. The last bin has no upper edge; its distance is the largest 64-bit number.
    """
    rows = list(hist)
    lows = sorted({r[0] for r in rows})
    high = {r[0]: r[1] for r in rows}
    n = {s: [0] * len(lows) for s in STRANDS}
    at = {lo: i for i, lo in enumerate(lows)}
    for lo, _, s, count in rows:
        if s in n:
            n[s][at[lo]] += count
    mean = [sum(n[s][i] for s in STRANDS) / 4 for i in range(len(lows))]
    last = {s: max((i for i, m in enumerate(mean) if m > 0 and abs(n[s][i] - m) / m > threshold), default=0) for s in STRANDS}
    index, strands, dist = 0, "??", 0
    for s in ("++", "--", "-+", "+-"):
        if last[s] > index:
            index, strands = last[s], s
            dist = high[lows[index]] if high[lows[index]] is not None else 2**63 - 1
    below = {s: sum(n[s][: index + 1]) for s in STRANDS}
    above = sum(sum(n[s][index + 1 :]) for s in STRANDS)
    out: dict = {
        "convergence_dist": dist,
        "strands_w_max_convergence_dist": strands,
        "convergence_rel_diff_threshold": threshold,
        "n_cis_pairs_below_convergence_dist": below,
        "n_cis_pairs_below_convergence_dist_all_strands": sum(below.values()),
        "n_cis_pairs_above_convergence_dist_all_strands": above,
    }
    for key, norm in (("cis", cis), ("total_mapped", total_mapped), ("total_nodups", total_nodups)):
        share = {s: v / norm if norm else 0.0 for s, v in below.items()}
        out[f"frac_{key}_in_cis_below_convergence_dist"] = share
        out[f"frac_{key}_in_cis_below_convergence_dist_all_strands"] = sum(share.values())
        out[f"frac_{key}_in_cis_above_convergence_dist_all_strands"] = above / norm if norm else 0.0
    return out


def bytile_duplicates(dups: DataFrame, pattern: str | None = None) -> DataFrame:
    """dups(readID, parent_readID) -> (tile, parent_tile, dup_count), the two tiles in order of name."""
    a, b = tile(F.col("readID"), pattern), tile(F.col("parent_readID"), pattern)
    return dups.select(F.least(a, b).alias("tile"), F.greatest(a, b).alias("parent_tile")).groupBy("tile", "parent_tile").agg(F.count("*").alias("dup_count"))


def optical_from_tiles(bytile: DataFrame) -> DataFrame:
    """(n_tile_pairs, dups_by_tile_median): the median count, taken for all tile pairs; other duplicates are optical."""
    return bytile.agg(F.count("*").alias("n_tile_pairs"), F.round(F.median("dup_count") * F.count("*")).cast("long").alias("dups_by_tile_median"))


def long_table(df: DataFrame, filters: Mapping[str, str] | None = None, edges: list[int] | None = None) -> DataFrame:
    """(filter, key, value): all counters under their slash-separated keys; edges: of the distance bins, where they are not the usual ones."""
    t = totals(df, filters)
    names = [c for c in t.columns if c != "filter"]
    flat = t.select("filter", F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").alias("value")) for c in names])).alias("x")).select("filter", "x.*")
    types = pair_types(df, filters).select("filter", F.concat(F.lit("pair_types/"), "pair_type").alias("key"), F.col("n").alias("value"))
    chroms = chrom_freq(df, filters).select("filter", F.concat_ws("/", F.lit("chrom_freq"), "chrom1", "chrom2").alias("key"), F.col("n").alias("value"))
    span = F.when(F.col("max_dist").isNull(), F.concat(F.col("min_dist").cast("string"), F.lit("+"))).otherwise(F.concat_ws("-", F.col("min_dist").cast("string"), F.col("max_dist").cast("string")))
    dist = dist_freq(df, filters, edges).select("filter", F.concat_ws("/", F.lit("dist_freq"), span, "strands").alias("key"), F.col("n").alias("value"))
    return flat.unionByName(types).unionByName(chroms).unionByName(dist)


def merge(tables: Iterable[DataFrame]) -> DataFrame:
    """Key-wise sums of long tables."""
    tables = list(tables)
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    return both.groupBy("filter", "key").agg(F.sum("value").alias("value"))


def merge_chromsizes(tables: Iterable[Mapping[str, int]]) -> dict[str, int]:
    """The sizes that all statistics agree on; those that record none agree with any."""
    told = [dict(t) for t in tables if t]
    if any(t != told[0] for t in told[1:]):
        raise ValueError("statistics with different chromosome sizes can't be merged")
    return told[0] if told else {}


def nested(long: DataFrame, name: str = NO_FILTER, bytile: DataFrame | None = None, chromsizes: Mapping[str, int] | None = None) -> dict:
    """One filter's long table as a nested dict, with its summary; runs on the driver over a small table.

    With duplicates by tile the summary tells a complexity without optical ones besides: those beyond the median count, taken for all tile pairs.
    """
    out: dict = {}
    for row in long.where(F.col("filter") == name).orderBy("key").collect():
        at = out
        *path, leaf = row["key"].split("/")
        for p in path:
            at = at.setdefault(p, {})
        at[leaf] = row["value"]
    hist = []
    for span, by_strand in out.get("dist_freq", {}).items():
        lo, hi = (int(span[:-1]), None) if span.endswith("+") else map(int, span.split("-"))
        hist += [(lo, hi, s, n) for s, n in by_strand.items()]
    nodups, mapped = out.get("total_nodups", 0), out.get("total_mapped", 0)
    s = out["summary"] = {f"frac_{c}": out.get(c, 0) / nodups if nodups else 0 for c in ["cis", *[f"cis_{kb}kb+" for kb in CIS_KB]]}
    s["dist_freq_convergence"] = convergence(hist, out.get("cis", 0), mapped, nodups)
    s["frac_dups"] = out.get("total_dups", 0) / mapped if mapped else 0
    dups = out.get("total_dups", 0)
    s["complexity_naive"] = library_complexity(mapped, dups)
    tiles = optical_from_tiles(bytile).first() if bytile is not None else None
    if tiles is not None and tiles["n_tile_pairs"]:
        out["dups_by_tile_median"] = tiles["dups_by_tile_median"]
        s["complexity_dups_by_tile_median"] = library_complexity(mapped, dups, dups - tiles["dups_by_tile_median"])
    if chromsizes:
        out["chromsizes"] = dict(chromsizes)
    return out


def flatten(tree: Mapping, prefix: str = "") -> list[tuple[str, object]]:
    """Nested dict -> (slash-separated key, value)."""
    out: list[tuple[str, object]] = []
    for k, v in tree.items():
        path = f"{prefix}/{k}" if prefix else str(k)
        out += flatten(v, path) if isinstance(v, Mapping) else [(path, v)]
    return out


def lookup(tree: Mapping, key: str):
    """The value under a slash-separated key."""
    at = tree
    for part in key.split("/"):
        if not isinstance(at, Mapping) or part not in at:
            raise KeyError(key)
        at = at[part]
    return at


def swap_levels(tree: Mapping[str, Mapping]) -> dict:
    """{a: {b: v}} -> {b: {a: v}}."""
    out: dict = {}
    for a, inner in tree.items():
        for b, v in inner.items():
            out.setdefault(b, {})[a] = v
    return out


def as_table(spark: SparkSession, tree: Mapping) -> DataFrame:
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in flatten(tree)], "key string, value string")
