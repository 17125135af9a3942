"""Secret scans: base patterns plus corpus-wide ownership frequency, with built-in functions only.

Spans come from the pieces between matches: ``split`` gives the texts between the matches that
``regexp_extract_all`` gives, and running lengths of both give start and end in code points.

Ownership: every candidate value is hashed; per hash the corpus gives the number of owners, of
repositories and of occurrences, by grouped counts in three steps (hash, owner, repository; hash, owner;
hash), each combined before its shuffle, so a value that is copied a billion times costs a row per task.
A value held by at most ``max_owners`` owners and ``max_repos`` repositories looks like a live credential
of that owner; one that many owners hold is a copied example. Candidates are the base matches and,
besides, generic tokens: runs of ``[A-Za-z0-9+/_-]``, 20 or longer, that hold a digit and a letter, do
not lie in a base match, and mix many characters. Live-looking generic ones are added as spans of kind
``owned``; base spans stay whatever their frequency.

Work grows with a text's length and matches, not with their square: running sums go by chunks, overlaps are found by a sweep.

Defined cases: a null text counts as empty and has no spans; very long texts are scanned whole; spans that start together stand in the order of the kinds; an empty
table gives an empty result; a null owner or repository counts as one
owner or repository of its own; rows that repeat a doc_id are scanned each on its own; other columns pass
through ``scan`` untouched unless they bear the names it adds, which then replace them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

#: fixed values: the base patterns, the group that is measured, and its least length
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]+)"
KINDS = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 1, 18), ("hex", HEX, 1, 16))
#: runs of the class that are long enough to matter; for hex and access a run that is too short can hold no longer match
SCAN = {"assign": ASSIGN, "access": r"(AKIA[A-Z0-9]{14,})", "hex": r"([0-9a-f]{16,})"}
GENERIC = r"([A-Za-z0-9+/_-]{20,})"
OWNED = 3


#: elements that a running sum takes at a time: work is that of n * CHUNK / 2 + (n / CHUNK) ** 2 / 2 steps for n elements
CHUNK = 256
#: code points of a block that texts are cut from
BLOCK = 4096


def _name() -> str:
    return f"x{uuid.uuid4().hex}"  # columns of docs may bear any name


def _running(array: str, op, zero: int) -> Column:
    """Of a column of whole numbers, before each element: ``op`` over all earlier ones. The column must not be an expression, as it is read again and again."""

    def scan(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(values, first, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    neutral = F.lit(zero).cast("long")
    chunks = F.transform(F.sequence(F.lit(0), F.expr(f"(size({array}) - 1) div {CHUNK}").cast("int")), lambda c: F.slice(F.col(array), c * CHUNK + 1, CHUNK))
    starts = scan(F.transform(chunks, lambda c: F.aggregate(c, neutral, lambda a, b: op(a, b))), neutral)
    each = F.flatten(F.transform(F.arrays_zip(chunks.alias("c"), starts.alias("s")), lambda z: scan(z["c"], z["s"])))
    return F.when(F.size(array) > 0, each).otherwise(F.array().cast("array<bigint>"))


SPAN = "array<struct<start:bigint,ord:int,end:bigint,value:string>>"


def _spans(docs: DataFrame, text: str, kinds: list[tuple]) -> DataFrame:
    """docs + one column per kind (column, cheap test, pattern, ord, group, least): its matches whose group is long enough, by start."""
    found, sizes, starts = ([_name() for _ in kinds] for _ in range(3))
    zipped = {}
    for z, (_, test, pattern, _, group, _) in zip(found, kinds, strict=True):
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(matches)).alias("p"), matches.alias("m"), value.alias("v"))
        zipped[z] = F.when(F.col(text).rlike(test), parts).otherwise(F.array().cast("array<struct<p:string,m:string,v:string>>"))
    docs = docs.withColumns(zipped)
    docs = docs.withColumns({n: F.transform(z, lambda x: (F.length(x["p"]) + F.length(x["m"])).cast("long")) for n, z in zip(sizes, found, strict=True)})
    docs = docs.withColumns({at: _running(n, lambda a, b: a + b, 0) for at, n in zip(starts, sizes, strict=True)})
    out = {}
    for z, at, (column, _, _, order, _, least) in zip(found, starts, kinds, strict=True):
        long_enough = F.filter(F.arrays_zip(F.col(z).alias("z"), F.col(at).alias("at")), lambda x: F.length(x["z"]["v"]) >= least)  # noqa: B023
        start = lambda x: x["at"] + F.length(x["z"]["p"])
        out[column] = F.transform(long_enough, lambda x: F.struct(start(x).alias("start"), F.lit(order).alias("ord"), (start(x) + F.length(x["z"]["m"])).alias("end"), x["z"]["v"].alias("value"))).cast(SPAN)  # noqa: B023
    return docs.withColumns(out).drop(*found, *sizes, *starts)


def _apart(docs: DataFrame, one: str, other: str) -> DataFrame:
    """docs with those of the spans in ``one`` that no span in ``other`` overlaps: a sweep over all by start, from either end."""
    order, ends, starts, most, least = (_name() for _ in range(5))
    far = 1 << 62
    mark = lambda c, own: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["ord"].alias("ord"), s["value"].alias("value")))
    both = (F.size(one) > 0) & (F.size(other) > 0)
    docs = docs.withColumn(order, F.array_sort(F.when(both, F.concat(mark(one, True), mark(other, False)))))
    docs = docs.withColumns({ends: F.transform(order, lambda s: F.when(s["own"], 0).otherwise(s["end"])), starts: F.transform(F.reverse(order), lambda s: F.when(s["own"], far).otherwise(s["start"]))})
    docs = docs.withColumns({most: _running(ends, F.greatest, 0), least: F.reverse(_running(starts, F.least, far))})
    free = F.filter(F.arrays_zip(F.col(order).alias("s"), F.col(most).alias("most"), F.col(least).alias("least")), lambda x: x["s"]["own"] & (x["most"] <= x["s"]["start"]) & (x["least"] >= x["s"]["end"]))
    kept = F.transform(free, lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["ord"].alias("ord"), x["s"]["end"].alias("end"), x["s"]["value"].alias("value"))).cast(SPAN)
    return docs.withColumn(one, F.when(both, kept).otherwise(F.col(one))).drop(order, ends, starts, most, least)


def _digest(spans: Column, names: tuple[str, ...]) -> Column:
    kind = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kind, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """docs + base and generic (arrays of start, ord, end, value); owner and repo are what the counts go by."""
    t, base = _name(), [_name() for _ in KINDS]
    tests = {"assign": "[:=]", "access": "AKIA", "hex": "[0-9a-f]{16}"}
    kinds = [(c, tests[name], SCAN[name], i, group, least) for i, (c, (name, _, group, least)) in enumerate(zip(base, KINDS, strict=True))]
    out = _spans(docs.withColumn(t, F.coalesce(F.col(text), F.lit(""))), t, [*kinds, ("generic", GENERIC, GENERIC, OWNED, 1, 20)])
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= 10)
    out = out.withColumns({"base": F.concat(*base), "generic": F.filter("generic", lambda g: mixed(g["value"]))}).drop(t, *base)
    return _apart(out, "generic", "base")


def ownership(candidates: DataFrame) -> DataFrame:
    """candidates(hash, owner, repo) -> (hash, n_owners, n_repos, n_found)."""
    by_repo = candidates.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repos"), F.sum("n").alias("n_found"))


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repo: str | None = None, max_owners: int = 1, max_repos: int = 5) -> tuple[DataFrame, DataFrame]:
    """(docs' key with base and generic spans, one row per candidate with its counts and whether it looks live).

    The key need not be unique; rows of one key are told apart by row_hash.
    """
    scanned = scan(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(owner).alias("owner"), F.col(repo or key).alias("repo")), "text")
    scanned = cut(scanned.select("key", "owner", "repo", F.xxhash64("text", "owner").alias("row_hash"), "base", "generic"))
    each = scanned.select("key", "row_hash", "owner", "repo", F.explode(F.concat("base", "generic")).alias("s"))
    each = each.select("key", "row_hash", "owner", "repo", "s.start", "s.ord", "s.end", F.sha2("s.value", 256).alias("hash"))
    counts = ownership(each)
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    return scanned, each.join(counts, "hash").withColumn("live", live)


def spans(docs: DataFrame, **options) -> DataFrame:
    """(key, row_hash, base, all): the base spans, and those with the live-looking generic ones added."""
    scanned, each = findings(docs, **options)
    added = each.where("live").where(F.col("ord") == OWNED).select("key", "row_hash", "start", "ord", "end").distinct()
    added = added.groupBy("key", "row_hash").agg(F.collect_list(F.struct("start", "ord", "end")).alias("added"))
    strip = lambda column: F.transform(column, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end")))
    plain = scanned.where(F.size("generic") == 0).withColumn("added", F.lit(None).cast("array<struct<start:bigint,ord:int,end:bigint>>"))
    rest = scanned.where(F.size("generic") > 0).alias("l").join(added.alias("r"), F.col("l.key").eqNullSafe(F.col("r.key")) & (F.col("l.row_hash") == F.col("r.row_hash")), "left").select("l.*", "r.added")
    out = plain.unionByName(rest)
    none = F.array().cast("array<struct<start:bigint,ord:int,end:bigint>>")
    return out.select("key", "row_hash", strip(F.col("base")).alias("base"), F.concat(strip(F.col("base")), F.coalesce("added", none)).alias("all"))


def redact(docs: DataFrame, mask: str = "[SECRET]", **options) -> DataFrame:
    """docs with every span of ``spans`` replaced in its text; n_chars follows if there is one. All rows stay."""
    key, row, spans_, ends, at, blocks = (_name() for _ in range(6))
    found = spans(docs, **options).where(F.size("all") > 0).dropDuplicates(["key", "row_hash"]).select(F.col("key").alias(key), F.col("row_hash").alias(row), F.array_sort("all").alias(spans_))
    on = F.col("d.doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("d.text", "d.source") == F.col(row))
    rows = docs.alias("d").join(found, on, "left")
    # before each span: the furthest end so far; the text in blocks, as places far inside a long text are slow to reach
    rows = rows.withColumns({ends: F.transform(spans_, lambda s: s["end"]), blocks: F.when(F.col(spans_).isNotNull(), F.regexp_extract_all("d.text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))})
    rows = rows.withColumn(at, _running(ends, F.greatest, 0))

    def cut_out(start: Column, end: Column) -> Column:
        def part(b: Column) -> Column:
            lo, hi = F.greatest(start - b * BLOCK, F.lit(0)), F.least(end - b * BLOCK, F.lit(BLOCK))
            return F.substring(F.get(F.col(blocks), b.cast("int")), (lo + 1).cast("int"), (hi - lo).cast("int"))

        first, last = F.floor(start / BLOCK), F.floor((end - 1) / BLOCK)
        return F.when(end > start, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise("")

    kept = F.transform(F.arrays_zip(F.col(spans_).alias("s"), F.col(at).alias("at")), lambda x: F.when(x["s"]["start"] >= x["at"], F.concat(cut_out(x["at"], x["s"]["start"]), F.lit(mask))).otherwise(""))
    rest = cut_out(F.array_max(ends), F.length("d.text").cast("long"))
    text = F.when(F.col(spans_).isNull(), F.col("d.text")).otherwise(F.concat(F.array_join(kept, ""), rest))
    new = {"text": text, "n_chars": F.when(F.col(spans_).isNull(), F.col("d.n_chars")).otherwise(F.length(text).cast("long")) if "n_chars" in docs.columns else None}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"d.`{c}`") for c in docs.columns])


NAMES = ("assign", "access", "hex", "owned")


def op2(spark, sf_dir: str) -> DataFrame:
    from .store import table

    out = spans(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda s: s["ord"] == i)).cast("long")
    return out.select(F.col("key").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_digest(F.col("base"), NAMES), 256).alias("base_sha256"), _digest(F.col("all"), NAMES).alias("spans"))


def _oracle() -> str:
    """The same spans in DuckDB: running sums of the lengths of pieces and matches; owned spans by window-free counts."""

    def kind(i: int, name: str, pattern: str, group: int, least: int) -> str:
        p = pattern.replace("'", "''")
        return f"""SELECT doc_id, source, {i} AS ord, '{name}' AS kind, s AS start, s + length(m) AS stop, v AS value FROM (
  SELECT doc_id, source, m, v, CAST(coalesce(list_sum([length(x) FOR x IN p[1:j]]), 0) + coalesce(list_sum([length(x) FOR x IN ms[1:j-1]]), 0) AS BIGINT) AS s FROM (
    SELECT doc_id, source, p, ms, j, ms[j] AS m, vs[j] AS v FROM (
      SELECT doc_id, source, string_split_regex(t, '{p}') AS p, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {group}) AS vs, unnest(range(1, len(regexp_extract_all(t, '{p}', 0)) + 1)) AS j FROM d)))
  WHERE length(v) >= {least}"""

    base = " UNION ALL ".join(kind(i, n, p, g, least) for i, (n, p, g, least) in enumerate(KINDS))
    return f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
base AS ({base}),
gen AS (SELECT * FROM ({kind(OWNED, "owned", GENERIC, 1, 20)}) g WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 10
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = g.doc_id AND b.start < g.stop AND g.start < b.stop)),
live AS (SELECT value FROM (SELECT * FROM base UNION ALL SELECT * FROM gen) GROUP BY value HAVING count(DISTINCT coalesce(source, '')) <= 1 AND count(DISTINCT doc_id) <= 5),
alls AS (SELECT doc_id, ord, kind, start, stop FROM base UNION ALL SELECT doc_id, ord, kind, start, stop FROM gen WHERE value IN (SELECT value FROM live)),
b AS (SELECT doc_id, count(*) FILTER (ord = 0) AS a, count(*) FILTER (ord = 1) AS k, count(*) FILTER (ord = 2) AS h, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS s FROM base GROUP BY doc_id),
x AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS s FROM alls GROUP BY doc_id)
SELECT d.doc_id, coalesce(b.a, 0) AS n_assign, coalesce(b.k, 0) AS n_access, coalesce(b.h, 0) AS n_hex, sha256(coalesce(b.s, '')) AS base_sha256, coalesce(x.s, '') AS spans
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN x USING (doc_id)"""


ORACLE = _oracle()
