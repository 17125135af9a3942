"""Contact frequency against distance, and contact counts between regions."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import assign_regions
from .stats import STRANDS, with_bin

OPEN = 2**63 - 1


def geometric_edges(start: int = 1, end: int = 10**9, per_decade: int = 8) -> list[int]:
    """Rounded edges of a constant ratio from start to end, each once."""
    n = round(math.log10(end / start) * per_decade)
    ratio = (end / start) ** (1 / n)
    return sorted({round(start * ratio**k) for k in range(n)} | {end})


def _regions(df: DataFrame, regions: DataFrame | None, chromsizes: Mapping[str, int] | None) -> tuple[DataFrame, DataFrame]:
    """(pairs with start1, end1, start2, end2, the regions): regions, whole chromosomes of known size, or any chromosome with end -1.

    -1 as start stands for no region.
    """
    spark = df.sparkSession
    if regions is not None:
        view = regions.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
        out = assign_regions(df, view)
        for i in (1, 2):
            out = out.withColumns({f"start{i}": F.coalesce(f"region_start{i}", F.lit(-1)), f"end{i}": F.coalesce(f"region_end{i}", F.lit(-1))})
        return out, view
    if chromsizes is not None:
        view = spark.createDataFrame([(c, 0, s) for c, s in chromsizes.items()], "chrom string, start long, end long")
        sizes, out = F.broadcast(view.where("end > 0")), df  # one row per chromosome
        for i in (1, 2):
            side = sizes.select(F.col("chrom").alias("c_"), F.col("start").alias("s_"), F.col("end").alias("e_"))
            out = out.join(side, F.col(f"chrom{i}") == F.col("c_"), "left")
            out = out.withColumns({f"start{i}": F.coalesce("s_", F.lit(-1)), f"end{i}": F.coalesce("e_", F.lit(-1))}).drop("c_", "s_", "e_")
        return out, view
    fixed = {f"{k}{i}": F.lit(v).cast("long") for i in (1, 2) for k, v in (("start", 0), ("end", -1))}
    chroms = df.select(F.col("chrom1").alias("chrom")).union(df.select("chrom2")).distinct()
    return df.withColumns(fixed), chroms.select("chrom", F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"))


def area(min_dist: Column, max_dist: Column, length: Column) -> Column:
    """Base pairs squared of a region's contacts at distances between the bounds."""
    part = lambda d: F.pow(F.greatest(length - d, F.lit(0)).cast("double"), F.lit(2.0))
    return (part(min_dist) - part(max_dist)) / 2


def area_between(min_dist: Column, max_dist: Column, start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """The same between two regions of a chromosome, by inclusion and exclusion of spans from the first region's ends to the second's."""
    whole = lambda a, b: area(min_dist, max_dist, F.greatest(b - a, F.lit(0)))
    return whole(start1, end2) - whole(start1, start2) - whole(end1, end2) + whole(end1, start2)


CIS = ["chrom1", "start1", "end1", "chrom2", "start2", "end2", "strand1", "strand2", "min_dist", "max_dist"]
TRANS = CIS[:8]
#: pairs of regions whose contacts are told with zeros filled in
REGION_PAIRS = 4_000_000


def _with_strands(df: DataFrame) -> DataFrame:
    each = F.array(*[F.struct(F.lit(s[0]).alias("strand1"), F.lit(s[1]).alias("strand2")) for s in STRANDS])
    return df.withColumn("s_", F.explode(each)).select(*df.columns, "s_.*")


def _bins(edges: list[int]) -> dict[int, int]:
    """Lower to upper edge of every bin, from 0 to OPEN."""
    lows = [0, *edges] if edges[0] != 0 else list(edges)
    return dict(zip(lows, [*lows[1:], OPEN], strict=True))


def skeleton(df: DataFrame, view: DataFrame, edges: list[int]) -> DataFrame:
    """Every region with every strand pair and distance bin, listed region by region."""
    bins = F.array(*[F.struct(F.lit(lo).cast("long").alias("min_dist"), F.lit(hi).cast("long").alias("max_dist")) for lo, hi in _bins(edges).items()])
    both = _with_strands(view.select(*[F.col(c).alias(f"{c}{i}") for i in (1, 2) for c in ("chrom", "start", "end")]))
    return both.withColumn("b_", F.explode(bins)).select(*both.columns, "b_.*")


def cis_scaling(df: DataFrame, regions: DataFrame | None = None, chromsizes: Mapping[str, int] | None = None, edges: list[int] | None = None) -> DataFrame:
    """Counts of pairs inside a region by region, strand pair and distance bin, zeros included, with the bins' areas.

    Distances below the first edge or from the last one on are not counted; their bins are there, with 0. The zeros are
    counted along with the pairs, in one shuffle.
    """
    edges = edges or geometric_edges()
    pairs, view = _regions(df, regions, chromsizes)
    inside = (F.col("start1") >= 0) & (F.col("start2") >= 0) & (F.col("chrom1") == F.col("chrom2")) & (F.col("start1") == F.col("start2")) & (F.col("end1") == F.col("end2")) if regions is not None or chromsizes is not None else F.col("chrom1") == F.col("chrom2")
    dist = F.abs(F.col("pos1") - F.col("pos2"))
    counted = with_bin(pairs.where(inside & (dist >= max(1, edges[0])) & (dist < edges[-1])), dist, edges).select(*TRANS, "min_dist", F.lit(1).alias("n"))
    zeros = skeleton(df, view, edges).select(*TRANS, "min_dist", F.lit(0).alias("n"))
    total = counted.unionByName(zeros).groupBy(*TRANS, "min_dist").agg(F.sum("n").alias("n_pairs")).where("min_dist is not null")
    upper = F.create_map(*[F.lit(v).cast("long") for bounds in _bins(edges).items() for v in bounds])  # looked up a row of the result
    total = total.withColumn("max_dist", F.element_at(upper, F.col("min_dist")))
    return total.select(*CIS, "n_pairs", area(F.col("min_dist"), F.col("max_dist"), F.col("end1") - F.col("start1")).alias("n_bp2"))


def trans_levels(df: DataFrame, regions: DataFrame | None = None, chromsizes: Mapping[str, int] | None = None) -> DataFrame:
    """Counts of all pairs not inside one region, by both regions and strand pair, zeros included, with the areas.

    The result has a row for every two regions; views with more than ``REGION_PAIRS`` of them are refused.
    """
    pairs, view = _regions(df, regions, chromsizes)
    n = view.count()
    if n * n > REGION_PAIRS:
        raise ValueError(f"{n} regions make more than {REGION_PAIRS} pairs of regions")
    same = (F.col("chrom1") == F.col("chrom2")) & (F.col("start1") == F.col("start2")) & (F.col("end1") == F.col("end2"))
    counted = pairs.where((F.col("start1") >= 0) & (F.col("start2") >= 0) & ~same).select(*TRANS, F.lit(1).alias("n"))
    names = ("chrom", "start", "end")
    all_ = view.agg(F.collect_list(F.struct(*names)).alias("all"))  # as many as checked
    two = all_.select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y"))
    two = two.select(*[F.col(f"{v}.{c}").alias(f"{c}{i}") for i, v in ((1, "x"), (2, "y")) for c in names]).where(~same)
    zeros = _with_strands(two).select(*TRANS, F.lit(0).alias("n"))
    total = counted.unionByName(zeros).groupBy(*TRANS).agg(F.sum("n").alias("n_pairs"))
    return total.select(*TRANS, "n_pairs", ((F.col("end1") - F.col("start1")) * (F.col("end2") - F.col("start2"))).cast("double").alias("n_bp2"))


def scaling_table(df: DataFrame, **options) -> DataFrame:
    """Both tables in one, as they are written to a file."""
    edges = options.pop("edges", None)
    return cis_scaling(df, edges=edges, **options).unionByName(trans_levels(df, **options), allowMissingColumns=True)


def frequencies(cis: DataFrame) -> DataFrame:
    """(min_dist, max_dist, n_pairs, n_bp2, frequency) over all regions and strand pairs."""
    out = cis.groupBy("min_dist", "max_dist").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("n_bp2").alias("n_bp2"))
    return out.withColumn("frequency", F.try_divide(F.col("n_pairs").cast("double"), F.col("n_bp2")))


def normalise_window(freq: DataFrame, window: tuple[float, float], log_input: bool = False) -> DataFrame:
    """Frequencies over (or, for logarithms, less) their mean over the bins from the first edge >= window[0] to the first >= window[1]."""
    lo, hi = freq.agg(F.min(F.when(F.col("min_dist") >= window[0], F.col("min_dist"))), F.min(F.when(F.col("min_dist") >= window[1], F.col("min_dist")))).first()
    if lo is None:
        raise ValueError("the window lies beyond the last bin")
    inside = (F.col("min_dist") >= lo) & (F.lit(True) if hi is None else F.col("min_dist") <= hi)
    mean = freq.where(inside).agg(F.mean("frequency")).first()[0]
    return freq.withColumn("normalised", F.col("frequency") - mean if log_input else F.col("frequency") / mean)


def normalise_unity(freq: DataFrame, bounds: tuple[float, float] | None = (1e4, 1e9)) -> DataFrame:
    """Frequencies with a unit sum of frequency times bin length over bins whose geometric middle lies inside the bounds."""
    middle = F.sqrt(F.col("min_dist").cast("double") * F.col("max_dist").cast("double"))
    use = F.col("frequency").isNotNull() & ~F.isnan("frequency")
    if bounds is not None:
        use = use & (middle > bounds[0]) & (middle < bounds[1])
    total = freq.agg(F.sum(F.when(use, F.col("frequency") * (F.col("max_dist") - F.col("min_dist"))))).first()[0]
    return freq.withColumn("normalised", F.try_divide(F.col("frequency"), F.lit(total)))
