"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

Targets: source i of weight w_i and size s_i gets min(cap_i, L * w_i) words, cap_i = epochs * s_i, with
the one level L at which the targets sum to the wanted total. That is what clamping the sources above
their cap and handing the excess to the others by weight, again and again, ends in; here L comes from
one ordered pass over the sources by cap / weight.

Sampling: every document of a source is taken floor(target / size) times, and the rest of the target is
filled by whole documents in the order of a seeded hash of id and text. The order is cut by bucketed sums: hash buckets
of up to ``BUCKET`` documents are added up per source, all buckets below the one where the rest is
reached are taken, and only that one bucket is put in order and filled document by document; one exchange of two of its documents then brings the sum
as near to the target as it can. Buckets are found ``STEP`` bits of the hash at a time, inside the bucket of the step before, so a task sees
2**STEP sums of a source at most, whatever its size. No source is
ever sorted or gathered as a whole, so a source with a third of all rows costs no more than others.

Defined cases: a null text has size 0; very long texts are counted whole; a null source is a source of its own and comes last; rows that
repeat id and text in a source share one decision, rows that repeat the id alone don't; sources that reach their caps at one level keep code point order; a source or table without words has target 0; columns
other than the three named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

WORD = r"[^\x20\x09-\x0D]+"
BUCKET = 256
STEP = 12
SMALL_SIDE = 100_000


def word_count(text) -> F.Column:
    """Words as JVM regular expressions count them; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """sizes(source, source_size) -> + target.

    Weights repeat over the sources in code point order, null last. The table has one row per source,
    which one task can order; documents never pass through that window.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "rank")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = sizes.withColumn("rank", F.row_number().over(order) - 1)
    t = t.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("ratio", F.col("cap") / F.col("w"))
    t = t.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    # the level holds from the first source, by ratio, whose cap it doesn't reach
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
    return t.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """docs(doc_id, text, source, ...) -> (doc_id, source, size, source_size, target, repetitions, taken)."""
    slim = cut(docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("u")))
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    per_source = targets(sums, weights, share, epochs).join(sums.drop("source_size").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    per_source = per_source.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    bits = F.greatest(F.ceil(F.log2(F.col("n") / BUCKET)), F.lit(0)).cast("int")
    per_source = cut(per_source.withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")).withColumn("bits", bits))
    few = per_source.count() <= SMALL_SIDE
    side = lambda t: F.broadcast(t) if few else t  # noqa: E731  one row per source, its number checked

    rows = slim.join(side(per_source.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    first = lambda k: F.when(F.col(k) > 0, F.expr(f"shiftrightunsigned(u, 64 - {k})")).otherwise(0)
    # one bucket per source is neither taken nor left as a whole
    last = per_source.where("rest > 0").select(F.col("source").alias("s"), F.lit(0).cast("long").alias("cut"), F.lit(0).alias("known"), F.col("rest").alias("gap"))
    for step in range(max(1, -(-(per_source.agg(F.max("bits")).first()[0] or 0) // STEP))):
        inside = rows.join(side(last), F.col("source").eqNullSafe(F.col("s"))).where(first("known") == F.col("cut"))
        inside = inside.withColumn("next", F.least("bits", F.lit(STEP * (step + 1)))).withColumn("bucket", first("next"))
        filled = inside.groupBy("source", "bucket").agg(F.sum("size").alias("sum"), F.first("gap").alias("gap"), F.first("next").alias("next"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        filled = filled.withColumn("below", F.coalesce(F.sum("sum").over(run), F.lit(0))).where("below < gap and below + sum >= gap")
        last = cut(filled.select(F.col("source").alias("s"), F.col("bucket").alias("cut"), F.col("next").alias("known"), (F.col("gap") - F.col("below")).alias("gap")))
    rows = rows.join(side(last), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("bucket", first("bits"))

    entries = rows.where("bucket = cut and size > 0").groupBy("source", "u", "doc_id", "gap").agg(F.sum("size").alias("w"))
    chosen = entries.groupBy("source").agg(F.first("gap").alias("gap"), F.array_sort(F.collect_list(F.struct("u", "doc_id", "w"))).alias("list"))
    step = F.aggregate(
        "list",
        F.struct(F.col("gap").alias("gap"), F.array().cast("array<bigint>").alias("ids")),
        lambda acc, x: F.when(x["w"] <= acc["gap"], F.struct((acc["gap"] - x["w"]).alias("gap"), F.concat(acc["ids"], F.array(x["u"])).alias("ids"))).otherwise(acc),
    )
    chosen = chosen.withColumn("fill", step)
    # one exchange (or addition) that brings the sum nearest to the target; u = null stands for no document
    taken = F.concat(F.array(F.struct(F.lit(None).cast("long").alias("u"), F.lit(0).cast("long").alias("w"))), F.transform(F.filter("list", lambda x: F.array_contains("fill.ids", x["u"])), lambda x: F.struct(x["u"].alias("u"), x["w"].alias("w"))))
    left = F.filter("list", lambda x: ~F.array_contains("fill.ids", x["u"]))
    trade = F.flatten(F.transform(left, lambda y: F.transform(taken, lambda x: F.struct(F.abs(F.col("fill.gap") - y["w"] + x["w"]).alias("off"), y["u"].alias("add"), x["u"].alias("drop")))))
    chosen = chosen.withColumn("best", F.array_min(trade))
    better = F.col("best.off") < F.col("fill.gap")
    kept = F.filter("fill.ids", lambda u: ~F.coalesce(u == F.col("best.drop"), F.lit(False)))
    ids = F.when(better, F.concat(kept, F.array("best.add"))).otherwise(F.col("fill.ids"))
    chosen = chosen.select(F.col("source").alias("s"), F.explode(ids).alias("v"))
    rows = rows.join(chosen, F.col("source").eqNullSafe(F.col("s")) & (F.col("u") == F.col("v")) & (F.col("bucket") == F.col("cut")), "left")
    extra = (F.col("rest") > 0) & F.coalesce(F.col("bucket") < F.col("cut"), F.lit(True)) | F.col("v").isNotNull()
    rows = rows.withColumn("repetitions", (F.col("whole") + F.when(extra, 1).otherwise(0)).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "repetitions", (F.col("size") * F.col("repetitions")).alias("taken"))


def op1(spark, sf_dir: str) -> DataFrame:
    from .store import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
