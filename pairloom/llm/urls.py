"""URL filters: listed rules first, then a path-template tree of smoothed labelled purity.

Tree, per host: every path segment is typed (numbers ``{n}``, hexadecimal ``{x}``, long or mixed slugs
``{s}``, each with its file extension; other segments stay as they are). Level by level, the literal
children of a node become one ``*`` if there are more than ``max_children`` of them, and children whose share
of bad labels does not differ from the node's (a z-test on proportions) merge into ``*`` as well;
unlabelled children stay apart, as nothing says what they are like. Segments below ``depth`` form one
``**``. A node's purity is (bad + strength * purity of the node above) / (labelled + strength), so a branch with few labels leans on its host and one with many
stands for itself; above the host stands ``prior``. Templates with a purity of at
least ``reject`` are rejected, whatever their number of pages.

Labels are those of pages, not of hosts: the rule that fits (block: bad, allow: good); else what the page holds. A link to a host that a rule blocks as a whole, or text that is
junk (few distinct words, or a symbol for every fifth word), makes a page bad, other text of 20 words or more good; pages with less text or none have no
label. All counts are taken over distinct (host, typed path), summed before their shuffle, so a host with a
third of all pages is a few rows from every task.

Defined cases: a url that is null or has no ``://`` has an empty host and path, matches no rule, and
belongs to the empty template; very long urls and pages are read whole; a page without html, or a table without that column, has the labels of rules alone; repeated rows
count and are judged row by row, null ids too; of rules that fit equally long the later one in code point order of host and path wins; an empty table
gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

#: fixed values: (host, path) -> verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SMALL_SIDE = 200_000
#: fewest words of a page that its text labels
LEAST_WORDS = 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; then up to ``?`` or ``#``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0], r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def typed_path(path: Column, depth: int = 8) -> Column:
    segments = F.filter(F.split(path, "/"), lambda s: s != "")

    def kind(s: Column) -> Column:
        stem, ext = F.regexp_extract(s, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(s, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 2)
        kinds = F.when(stem.rlike("^[0-9]+$"), F.lit("{n}")).when(stem.rlike("^[0-9a-fA-F-]{8,}$") & stem.rlike("[0-9]"), F.lit("{x}"))
        kinds = kinds.when((F.length(stem) > 24) | (stem.rlike("[0-9]") & (F.length(stem) > 3)), F.lit("{s}"))
        return F.when(kinds.isNull(), s).otherwise(F.concat(kinds, ext))

    typed = F.transform(F.slice(segments, 1, depth), kind)
    return F.when(F.size(segments) > depth, F.concat(typed, F.array(F.lit("**")))).otherwise(typed)


def templates(paths: DataFrame, max_children: int = 20, z: float = 1.96) -> DataFrame:
    """paths(host, typed, n, bad, lab) -> + template: array of segments after both kinds of merging."""
    deepest = paths.agg(F.max(F.size("typed"))).first()[0] or 0
    tree = paths.withColumn("template", F.array().cast("array<string>"))
    for level in range(deepest):
        tree = tree.withColumn("child", F.get("typed", F.lit(level)))
        literal = F.col("child").isNotNull() & ~F.col("child").startswith("{") & (F.col("child") != "**")
        children = tree.where(literal).groupBy("host", "template", "child").agg(F.sum("bad").alias("b"), F.sum("lab").alias("l"))
        nodes = children.groupBy("host", "template").agg(F.count("*").alias("width"), F.sum("b").alias("nb"), F.sum("l").alias("nl"), F.sum(F.when(F.col("l") > 0, 1).otherwise(0)).alias("told"))
        both = children.join(nodes, ["host", "template"])
        p = F.try_divide("nb", "nl")
        spread = F.sqrt(F.try_divide(p * (1 - p), F.col("l")))
        similar = (F.col("told") > 1) & (F.abs(F.try_divide("b", "l") - p) <= F.lit(z) * spread)
        merged = both.select("host", "template", "child", ((F.col("width") > max_children) | F.coalesce(similar, F.lit(False))).alias("merge"))
        tree = tree.join(merged, ["host", "template", "child"], "left")
        seg = F.when(F.col("merge"), F.lit("*")).otherwise(F.col("child"))
        tree = tree.withColumn("template", F.when(F.col("child").isNull(), F.col("template")).otherwise(F.concat("template", F.array(seg)))).drop("child", "merge")
        tree = cut(tree)
    return tree


def page_label(html: Column, rules=RULES) -> Column:
    """True: bad, false: good, null: can't be told. Patterns are simple ones, as they pass over every page."""
    text = F.regexp_replace(html, r"(?s)<(?:[sS](?:[cC][rR][iI][pP][tT]|[tT][yY][lL][eE])\b.*?</[sS](?:[cC][rR][iI][pP][tT]|[tT][yY][lL][eE])|[^>]*>)", " ")
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    few = F.size(F.array_distinct(words)) < n * F.when(n <= 3000, 0.3).otherwise(0.1)
    symbols = F.regexp_count(text, F.lit(r"[#$%*|{}\[\]\\^~=+@_`]")) > 0.2 * n
    label = F.when(n >= LEAST_WORDS, few | symbols)
    blocked = "|".join(re.escape(h) for h, p, v in rules if v == "block" and p == "/")
    if blocked:  # fit the host of a link or one above it
        link = rf"(?i)href\s*=\s*[\"']?[a-z][a-z0-9+.-]*://([^/?#\"'>\x20]*\.)?({blocked})([/?#\"'>\x20]|$)"
        label = F.when(html.contains("://") & html.rlike(link), True).otherwise(label)
    return label


def purities(tree: DataFrame, prior: float, strength: float) -> DataFrame:
    """tree(host, template, bad, lab) -> (host, template, purity)."""
    leaf = tree.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("lab").alias("lab"))
    above = leaf.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("template")))).withColumn("node", F.expr("slice(template, 1, i)"))
    nodes = above.groupBy("host", "node").agg(F.sum("bad").alias("b"), F.sum("lab").alias("l"))
    path = above.select("host", "template", "i", "node").join(nodes, ["host", "node"]).groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("i", "b", "l"))).alias("path"))  # depth + 2 nodes at most
    fold = F.aggregate("path", F.lit(float(prior)), lambda p, x: (x["b"] + strength * p) / (x["l"] + strength))
    return path.select("host", "template", fold.alias("purity"))


def judge(pages: DataFrame, rules=RULES, prior: float = 0.2, strength: float = 2.0, reject: float = 0.5, max_children: int = 20, depth: int = 8, html: str = "html", key: str = "page_id") -> DataFrame:
    """pages(page_id, url, html, ...) -> (page_id, host, path, rule, verdict, template, purity)."""
    host, path = host_and_path(F.col("url"))
    content = page_label(F.col(html), rules) if html in pages.columns else F.lit(None).cast("boolean")
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"), content.alias("content"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "listed": verdict, "typed": typed_path(F.col("path"), depth)})
    bad = F.coalesce(F.col("listed") == "block", F.col("content"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    paths = cut(rows.groupBy("host", "typed").agg(F.count("*").alias("n"), count(bad).alias("bad"), count(bad.isNotNull()).alias("lab")))
    tree = templates(paths, max_children)
    scored = cut(tree.select("host", "typed", "template").join(purities(tree, prior, strength), ["host", "template"]))
    side = F.broadcast(scored) if scored.count() <= SMALL_SIDE else scored
    rows = rows.drop("content").join(side, ["host", "typed"], "left")
    own = F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("listed", own).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")


def op9(spark, sf_dir: str) -> DataFrame:
    from .store import table

    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
