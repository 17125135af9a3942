"""SQL counterparts of the queries on chimeric molecules.

They state the rules over whole lists of alignments: a window gives the gaps, all pairs of junctions of both reads give the shared
ones, and a numbered list of stops gives the ligations.
"""

from __future__ import annotations

#: one alignment a lineitem row, as ``extra._walks`` makes them
RECORDS = """SELECT concat('r', l_orderkey) AS readID, CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 2 END AS side, l_returnflag = 'R' AS minus, l_linenumber * 7 % 13 <> l_partkey % 13 AS mapped,
  concat('chr', l_suppkey % 2 + 1) AS rname, l_partkey % 400 + 1 AS pos, CAST(floor(l_quantity) AS BIGINT) AS mapq, CAST(floor((l_linenumber - 1) / 2) AS BIGINT) * 20 AS part,
  l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey AS n FROM lineitem"""


def alignments(min_mapq: int) -> str:
    """rec, al: typed alignments with the distance to the read's 5' end (d5), the start on the query (qs) and the span."""
    return f"""rec AS ({RECORDS}),
al AS (SELECT *, mapped AND mapq >= {min_mapq} AS uniq, CASE WHEN mapped THEN 20 ELSE 0 END AS span, CASE WHEN mapped THEN part ELSE 0 END AS qs,
  CASE WHEN NOT mapped THEN 0 WHEN minus THEN 60 - part ELSE part END AS d5,
  CASE WHEN mapped AND mapq >= {min_mapq} THEN rname ELSE '!' END AS chrom,
  CASE WHEN NOT (mapped AND mapq >= {min_mapq}) THEN 0 WHEN minus THEN pos + 19 ELSE pos END AS p5, CASE WHEN NOT (mapped AND mapq >= {min_mapq}) THEN 0 WHEN minus THEN pos ELSE pos + 19 END AS p3,
  CASE WHEN mapped AND mapq >= {min_mapq} AND NOT minus THEN '+' ELSE '-' END AS strand FROM rec)"""


#: sides in order with null alignments in gaps of over 20 bases; a step for each alignment and each null one, as many as alignments
_PREPARED = """o AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY readID, side) AS c, greatest(0, coalesce(max(d5 + span) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS reach
  FROM al WINDOW w AS (PARTITION BY readID, side ORDER BY d5, qs, n)),
wide AS (SELECT *, (c > 1 OR mapped) AND d5 - reach > 20 AS hole FROM o),
steps AS (SELECT *, coalesce(sum(1 + CAST(hole AS INTEGER)) OVER (PARTITION BY readID, side ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS step FROM wide),
sg AS (SELECT readID, side, 2 * r AS r, chrom, p5, p3, strand, mapped, uniq, d5 FROM steps
  UNION ALL SELECT readID, side, 2 * r - 1, '!', 0, 0, '-', false, false, reach FROM steps WHERE hole AND step < c
  UNION ALL SELECT readID, s, 0, '!', 0, 0, '-', false, false, 0 FROM (SELECT DISTINCT readID FROM al), (VALUES (1), (2)) v(s) WHERE (readID, s) NOT IN (SELECT (readID, side) FROM al)),
seg AS (SELECT *, CASE WHEN uniq THEN 'U' WHEN mapped THEN 'M' ELSE 'N' END AS t, row_number() OVER (PARTITION BY readID, side ORDER BY r) - 1 AS i, count(*) OVER (PARTITION BY readID, side) AS cnt FROM sg),
n0 AS (SELECT readID, count(*) FILTER (side = 1) AS n1, count(*) FILTER (side = 2) AS n2 FROM al GROUP BY readID),
mol AS (SELECT readID, list({chrom: chrom, p5: p5, p3: p3, strand: strand, mapped: mapped, uniq: uniq, d5: d5, t: t, i: i, cnt: cnt} ORDER BY r) FILTER (side = 1) AS a,
  list({chrom: chrom, p5: p5, p3: p3, strand: strand, mapped: mapped, uniq: uniq, d5: d5, t: t, i: i, cnt: cnt} ORDER BY r) FILTER (side = 2) AS b FROM seg GROUP BY readID),
base AS (SELECT *, len(a) AS na, len(b) AS nb, least(n1, n2) = 0 AS lacks, n1 + n2 AS n0 FROM mol JOIN n0 USING (readID))"""

_NONE = "{chrom: '!', p5: 0, p3: 0, strand: '-', mapped: false, uniq: false, d5: 0, t: 'X', i: 0, cnt: 1}"
_alike = lambda x, y: f"(CASE WHEN NOT {x}.uniq OR NOT {y}.uniq THEN {x}.uniq = {y}.uniq ELSE {x}.chrom = {y}.chrom AND {x}.strand <> {y}.strand END)"


def _walks(max_insert: int, place: dict, strand: dict, which: str) -> str:
    """ends: the ligations of the molecules in ``which``: readID, idx, kind, seen, one, two."""
    turn = lambda table, end: f"kind IN ({', '.join(repr(k) for k, v in table.items() if v[end]) or 'NULL'})"
    end = lambda i, name: f"""{{chrom: {name}.chrom, p5: CASE WHEN {turn(place, i)} THEN coalesce(far{i}, {name}.p3) ELSE {name}.p5 END, strand: CASE WHEN {turn(strand, i)} THEN CASE {name}.strand WHEN '+' THEN '-' ELSE '+' END ELSE {name}.strand END,
    mapped: {name}.mapped, uniq: {name}.uniq, t: {name}.t}}"""  # noqa: E731
    return f"""chim AS (SELECT * FROM base WHERE {which}),
cross_ AS (SELECT readID, na, nb, a[-x - 2] AS l5, a[-x - 1] AS l3, b[-y - 2] AS r5, b[-y - 1] AS r3, x + y + 1 AS m FROM (SELECT *, unnest(range(0, nb - 1)) AS y FROM (SELECT *, unnest(range(0, na - 1)) AS x FROM chim))),
common AS (SELECT readID, min(m) AS shared FROM (SELECT readID, m FROM cross_ WHERE m < least(na, nb) GROUP BY readID, m
  HAVING count(*) = m AND bool_and({_alike('l5', 'r3')} AND {_alike('l3', 'r5')} AND abs(l5.p3 - r3.p5) <= 3 AND abs(l3.p5 - r5.p3) <= 3)) GROUP BY readID),
met AS (SELECT c.*, coalesce(shared, 0) AS k, shared IS NULL AND CASE WHEN NOT a[-1].uniq OR NOT b[-1].uniq THEN NOT a[-1].uniq AND NOT b[-1].uniq ELSE a[-1].chrom = b[-1].chrom AND a[-1].strand <> b[-1].strand
  AND (CASE WHEN a[-1].strand = '+' THEN b[-1].p5 - a[-1].p5 ELSE a[-1].p5 - b[-1].p5 END) BETWEEN
    (CASE WHEN a[-1].strand = '+' THEN greatest(a[-1].p3 - a[-1].p5, b[-1].p5 - b[-1].p3) ELSE greatest(b[-1].p3 - b[-1].p5, a[-1].p5 - a[-1].p3) END) - 3 AND {max_insert} + 3 END AS meet FROM chim c LEFT JOIN common USING (readID)),
walk AS (SELECT *, CASE WHEN k > 0 THEN k + 1 WHEN meet THEN 1 ELSE 0 END AS o FROM met),
joint AS (SELECT *, t < na AS in1, t > na - o AS in2 FROM (SELECT *, unnest(range(1, na + nb - o)) AS t FROM walk)),
named AS (SELECT *, CASE WHEN in1 AND in2 THEN 'R1&2' WHEN in1 THEN 'R1' WHEN in2 THEN 'R2' ELSE 'R1-2' END AS kind, CAST(in1 AS INTEGER) + 2 * CAST(in2 AS INTEGER) AS seen,
  sum(CAST(in2 AND NOT in1 AS INTEGER)) OVER (PARTITION BY readID ORDER BY t) AS q, sum(CAST(in2 AND NOT in1 AS INTEGER)) OVER (PARTITION BY readID) AS r FROM joint),
told AS (SELECT *, row_number() OVER (PARTITION BY readID ORDER BY t) AS idx, nb + na - o - t + 1 AS u FROM named WHERE kind <> 'R2' OR CASE WHEN meet THEN q = 1 OR q = r ELSE q > r - k - 1 END),
raw AS (SELECT readID, idx, kind, seen, CASE WHEN kind = 'R2' THEN b[u] ELSE a[t] END AS one, CASE WHEN in1 THEN a[t + 1] ELSE b[u - 1] END AS two,
  CASE WHEN meet AND kind = 'R2' AND t = na THEN a[na].p5 END AS far0, CASE WHEN kind = 'R1&2' OR meet AND kind = 'R1' AND t + 1 = na THEN b[u - 1].p5 END AS far1 FROM told),
ends AS (SELECT readID, idx, kind, seen, {end(0, 'one')} AS one, {end(1, 'two')} AS two FROM raw)"""


def _rows(source: str, flip: bool, extra: str = "") -> str:
    """Pairs with their sides in order if ``flip``: by place if both have one, else the better mapped one second."""
    rank = lambda x: f"CAST(right({x}.chrom, 1) AS INTEGER)"
    wrong = "CASE WHEN one.chrom <> '!' AND two.chrom <> '!' THEN (" + rank("one") + ", one.p5) > (" + rank("two") + ", two.p5) ELSE (CAST(one.mapped AS INTEGER), CAST(one.uniq AS INTEGER)) > (CAST(two.mapped AS INTEGER), CAST(two.uniq AS INTEGER)) END"
    turned = f"SELECT readID, idx, kind, CASE WHEN w THEN two ELSE one END AS x, CASE WHEN w THEN one ELSE two END AS y FROM (SELECT *, {wrong if flip else 'false'} AS w FROM ({source}))"
    return f"""SELECT readID, x.chrom AS chrom1, x.p5 AS pos1, y.chrom AS chrom2, y.p5 AS pos2, x.strand AS strand1, y.strand AS strand2, x.t || y.t AS pair_type{extra} FROM ({turned})"""


INDEX = ", CAST(idx AS INTEGER) AS walk_pair_index, kind AS walk_pair_type"
OUTER = {"R1": (False, True), "R1&2": (False, True), "R2": (True, False)}
JUNCTION = {"R1": (True, False), "R1&2": (True, False), "R2": (False, True), "R1-2": (True, True)}

#: three alignments that tell of one ligation: 1 or 2, the side of the chimeric read
_RESCUE = """resc AS (SELECT *, CASE WHEN na = 2 AND nb = 1 THEN 1 WHEN na = 1 AND nb = 2 THEN 2 END AS ch FROM base),
fit AS (SELECT *, CASE WHEN ch = 1 THEN a[1] ELSE b[1] END AS five, CASE WHEN ch = 1 THEN a[2] ELSE b[2] END AS three, CASE WHEN ch = 1 THEN b[1] ELSE a[1] END AS lin FROM resc),
chosen AS (SELECT *, CASE WHEN ch IS NOT NULL AND lin.uniq AND (NOT three.mapped OR NOT five.uniq OR three.chrom = lin.chrom AND three.strand <> lin.strand
  AND (CASE lin.strand WHEN '+' THEN 1 ELSE -1 END) * (three.p5 - lin.p5) > 0 AND (CASE lin.strand WHEN '+' THEN 1 ELSE -1 END) * (three.p5 - lin.p5) + three.d5 + lin.d5 <= 750) THEN ch END AS linear FROM fit)"""


def _retyped(x: str, t: str, masked: bool = False) -> str:
    place = "chrom: '!', p5: 0, p3: 0, strand: '-'" if masked else f"chrom: {x}.chrom, p5: {x}.p5, p3: {x}.p3, strand: {x}.strand"
    return f"{{{place}, mapped: {x}.mapped, uniq: {x}.uniq, d5: {x}.d5, t: '{t}', i: {x}.i, cnt: {x}.cnt}}"


def _pick(side: str, policy: str) -> str:
    first = f"{side}[1]" if policy[0] == "5" else f"{side}[-1]"
    clear = f"list_filter({side}, lambda s: s.uniq)"
    return f"coalesce({clear}[{1 if policy[0] == '5' else -1}], {first})" if policy.endswith("unique") else first


def policy(name: str, extra: str = INDEX) -> str:
    """Counterpart of ``parse`` under a walk policy: alignments from MAPQ 10 on, gaps over 20, molecules up to 750."""
    head = f"WITH {alignments(10)}, {_PREPARED}"
    empty = f"SELECT readID, 1 AS idx, 'R1-2' AS kind, {_NONE} AS one, {_NONE} AS two FROM base WHERE "
    if name == "all":
        small = lambda x: f"{{chrom: {x}.chrom, p5: {x}.p5, strand: {x}.strand, mapped: {x}.mapped, uniq: {x}.uniq, t: {x}.t}}"
        single = f"SELECT readID, 1 AS idx, 'R1-2' AS kind, {small('a[1]')} AS one, {small('b[1]')} AS two FROM base WHERE NOT (lacks AND n0 < 2) AND na = 1 AND nb = 1"
        none = empty.replace(_NONE, small(_NONE)) + "lacks AND n0 < 2"
        return f"{head}, {_walks(750, OUTER, OUTER, 'NOT (lacks AND n0 < 2) AND na + nb > 2')} {_rows(f'SELECT readID, idx, kind, one, two FROM ends UNION ALL {single} UNION ALL {none}', True, extra)}"
    one, two = ((_retyped("a[1]", "W", True), _retyped("b[1]", "W", True)) if name == "mask" else (_pick("a", name), _pick("b", name)))
    rest = f"""SELECT readID, 1 AS idx, CASE WHEN na + nb > 2 AND linear IS NOT NULL THEN 'R' || linear ELSE 'R1-2' END AS kind,
  CASE WHEN na + nb = 2 THEN a[1] WHEN linear = 1 THEN a[1] WHEN linear = 2 THEN {_retyped('a[1]', 'R')} ELSE {one} END AS one,
  CASE WHEN na + nb = 2 THEN b[1] WHEN linear = 2 THEN b[1] WHEN linear = 1 THEN {_retyped('b[1]', 'R')} ELSE {two} END AS two FROM chosen WHERE NOT lacks"""
    return f"{head}, {_RESCUE} {_rows(f'{rest} UNION ALL {empty} lacks', True, extra)}"


def every(place: dict, strand: dict, depth: int | None = None) -> str:
    """Counterpart of ``parse2`` without flipping, inserts up to 500; with a depth, wider pairs inside one read as well."""
    small = lambda x: f"{{chrom: {x}.chrom, p5: {x}.p5, strand: {x}.strand, mapped: {x}.mapped, uniq: {x}.uniq, t: {x}.t}}"
    turned = lambda x, i: f"""{{chrom: {x}.chrom, p5: {x}.{'p3' if place.get('R1-2', (0, 0))[i] else 'p5'}, strand: {f"CASE {x}.strand WHEN '+' THEN '-' ELSE '+' END" if strand.get('R1-2', (0, 0))[i] else f'{x}.strand'}, mapped: {x}.mapped, uniq: {x}.uniq, t: {x}.t}}"""
    single = f"SELECT readID, 1 AS idx, 'R1-2' AS kind, {turned('a[1]', 0)} AS one, {turned('b[1]', 1)} AS two FROM base WHERE NOT (lacks AND n0 < 2) AND na = 1 AND nb = 1"
    none = f"SELECT readID, 1 AS idx, 'R1-2' AS kind, {small(_NONE)} AS one, {small(_NONE)} AS two FROM base WHERE lacks AND n0 < 2"
    wider = ""
    if depth is not None:
        wider = f""" UNION ALL SELECT p.readID, p.idx, concat('E', q.idx - p.idx, '_', CASE p.seen & q.seen WHEN 1 THEN 'R1' WHEN 2 THEN 'R2' ELSE 'R1&2' END), p.one, q.two FROM ends p JOIN ends q ON p.readID = q.readID AND q.idx > p.idx AND q.idx <= p.idx + {depth} AND (p.seen & q.seen) > 0"""
    source = f"SELECT readID, idx, kind, one, two FROM ends{wider} UNION ALL {single} UNION ALL {none}"
    return f"WITH {alignments(10)}, {_PREPARED}, {_walks(500, place, strand, 'NOT (lacks AND n0 < 2) AND na + nb > 2')} {_rows(source, False, INDEX)}"


GAPS = policy("5any", ", " + ", ".join(f"{v}.{f} AS {c}{i}" for c, f in (("algn_idx", "i"), ("same_side_algn_count", "cnt"), ("dist_to_5", "d5")) for i, v in ((1, "x"), (2, "y"))))
LINES = f"""WITH {alignments(1)}, cells AS (SELECT readID, side, string_agg(concat_ws(chr(9), chrom, p5, strand, mapq,
  CASE WHEN mapped THEN concat(CASE WHEN part > 0 THEN part || 'S' ELSE '' END, '20M', CASE WHEN part < 60 THEN (60 - part) || 'S' ELSE '' END) ELSE '*' END, d5, d5 + span, span), chr(9) ORDER BY d5, qs, n) AS s FROM al GROUP BY readID, side)
SELECT m.readID, CAST(v.s AS INTEGER) AS side, concat(m.readID, chr(9), v.s, chr(9), coalesce(c.s, '')) AS line FROM (SELECT DISTINCT readID FROM al) m CROSS JOIN (VALUES (1), (2)) v(s) LEFT JOIN cells c ON c.readID = m.readID AND c.side = v.s"""
