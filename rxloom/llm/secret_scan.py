"""Secrets in texts: fixed patterns, and high-entropy strings by a sliding window.

Everything here is DataFrame functions. Candidate strings are runs of key-like
characters outside the spans of the fixed patterns; a window of ``WINDOW`` characters
slides over each. The counts of its characters are kept in packed fields: of the
character that enters one is raised, of the one that leaves one is lowered, and the sum
that the Shannon entropy needs changes by what these two counts say. What a character
class demands differs: hex digits can't reach the entropy that mixed alphabets do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"  # of a run, the leftmost AKIA has the most characters after it: the same spans as AKIA[A-Z0-9]+ of 16 or more
HEX = r"[0-9a-f]{32,}"  # whole runs, as those of [0-9a-f]+ with 32 or more
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a character that a window must reach, by class of the whole candidate, first match wins; None: never.
CLASSES = [("^[0-9]+$", None), ("^[0-9a-f]+$|^[0-9A-F]+$", 3.1), ("^[a-z]+$|^[A-Z]?[a-z]+$|^[A-Z]+$", 4.15), ("", 3.85)]
#: Candidates that are known to be harmless: UUIDs, and words or numbers with separators between (the pattern is of what they don't have).
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
NO_WORDS = r"[A-Za-z][0-9]|[0-9][A-Za-z]|[A-Za-z]{25,}|[0-9]{13,}"
#: Between separators, what has one of these in it is no part of a candidate.
PLACEHOLDERS = ["EXAMPLE", "example", "xxxx", "XXXX"]
KINDS = ["assign", "access", "hex", "entropy"]
_SCALE = 1_000_000
#: Characters of a candidate that are scanned at a time, and matches or spans that are handled together.
PIECE, TOGETHER = 4096, 64
#: Spans that are laid against candidates together, and such as are cut out of a text together.
MASKS, REDACTED = 256, 512
#: Counts are fields of five bits, twelve in a number; the alphabet of candidates lies between + and z.
_FIELD, _FIELDS, _FIRST = 5, 12, ord("+")
_NUMBERS = -(-(ord("z") - _FIRST + 1) // _FIELDS)


def _gain(n: int) -> int:
    """What the n-th equal character adds to the window's sum of count * log2(count), in millionths."""
    f = lambda k: round(_SCALE * k * math.log2(k)) if k > 1 else 0
    return f(n) - f(n - 1)


GAINS = [_gain(n) for n in range(1, WINDOW + 1)]


def ceiling(bits: float) -> int:
    """The largest sum of a window whose entropy reaches ``bits``: entropy = log2(WINDOW) - sum / WINDOW."""
    return math.floor(_SCALE * WINDOW * (math.log2(WINDOW) - bits))


def placeholder(words: list[str]) -> str:
    return f"[A-Za-z0-9]*({'|'.join(words)})[A-Za-z0-9]*"


_SPANS = "array<struct<s:int,k:int,e:int,g:string>>"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _firsts(rows: Column, size: int = TOGETHER) -> Column:
    """Numbers of the blocks of ``size`` that hold the rows of an array."""
    return F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))


def _slice(rows: Column, block: Column, size: int = TOGETHER) -> Column:
    return F.slice(rows, block * size + 1, F.lit(size))


def _found(text: Column, pattern: str, group: int, order: int) -> Column:
    """array<struct<s, k, e, g>>: every match by start (code points), with ``group``.

    The pieces between matches and the matches themselves alternate, so running
    sums of their lengths are the positions: first within blocks of matches,
    then over blocks, since an array that grows is copied at each step. Only the
    blocks' offsets grow so over the whole text.
    """
    pieces, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.arrays_zip(pieces.alias("p"), whole.alias("w"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def span(s: Column, e: Column, g: Column) -> Column:
        return F.struct(s.alias("s"), F.lit(order).alias("k"), e.alias("e"), g.alias("g"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["p"])
        e = s + F.coalesce(F.length(x["w"]), F.lit(0))
        return F.struct(e.alias("at"), F.when(x["w"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span(s, e, x["g"])))).alias("out"))

    def placed(blocks: Column) -> Column:
        zero = F.array(F.lit(0))
        offsets = F.aggregate(blocks, zero, lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
        moved = lambda b, by: F.transform(b["out"], lambda x: span(x["s"] + by, x["e"] + by, x["g"]))
        return _let(offsets, lambda at: F.flatten(F.transform(blocks, lambda b, i: moved(b, F.get(at, i)))))

    blocks = _let(rows, lambda r: F.transform(_firsts(r), lambda b: F.aggregate(_slice(r, b), start, step)))
    return _let(blocks, placed)


def _blocks(masks: Column) -> Column:
    """Blocks of spans: m, with their least start (lo) and largest end (hi)."""
    block = lambda m: F.struct(F.array_min(F.transform(m, lambda x: x["s"])).alias("lo"), F.array_max(F.transform(m, lambda x: x["e"])).alias("hi"), m.alias("m"))
    return _let(masks, lambda r: F.transform(_firsts(r, MASKS), lambda b: _let(_slice(r, b, MASKS), block)))


def _pieces(x: Column, masks: Column) -> Column:
    """array<struct<s, w>>: what ``masks`` (blocks of spans by start) leave of the run ``x``, WINDOW characters at least."""
    overlaps = lambda lo, hi: (lo < x["e"]) & (x["s"] < hi)
    near = F.flatten(F.transform(F.filter(masks, lambda b: overlaps(b["lo"], b["hi"])), lambda b: b["m"]))
    touching = F.filter(near, lambda m: overlaps(m["s"], m["e"]))
    start = F.struct(x["s"].alias("at"), F.array().cast("array<struct<s:int,w:string>>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        piece = F.struct(acc["at"].alias("s"), F.substring(x["g"], acc["at"] - x["s"] + 1, s - acc["at"]).alias("w"))
        return F.when(s - acc["at"] >= WINDOW, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"])

    step = lambda acc, m: F.struct(F.greatest(acc["at"], m["e"]).alias("at"), add(acc, m["s"]).alias("out"))
    return F.aggregate(touching, start, step, lambda acc: add(acc, x["e"]))


def _hot(w: Column, limit: Column) -> Column:
    """struct<a, b>: from the first window of ``w`` under ``limit`` to the end of the last; null if there is none.

    Long strings are scanned in pieces that overlap by all but one character of a window.
    """
    gains, none = F.array(*[F.lit(x) for x in GAINS]), F.lit(None).cast("int")
    number = lambda c: F.call_function("div", c, F.lit(_FIELDS)).cast("int")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c % _FIELDS * _FIELD)
    count = lambda n, c: F.call_function("shiftright", F.element_at(n, number(c) + 1), c % _FIELDS * _FIELD).bitwiseAND(31).cast("int")

    def step(acc: Column, x: Column) -> Column:
        enters, leaves = x["i"], x["o"]
        less = F.when(leaves.isNull(), 0).otherwise(F.element_at(gains, count(acc["n"], leaves)))
        more = F.element_at(gains, count(acc["n"], enters) + F.when(enters == leaves, 0).otherwise(1))
        n = F.transform(acc["n"], lambda v, k: v + F.when(k == number(enters), bit(enters)).otherwise(0) - F.when(k == number(leaves), bit(leaves)).otherwise(0))

        def settled(total: Column) -> Column:
            hit = (x["at"] >= WINDOW) & (total <= limit)
            return F.struct(n.alias("n"), total.alias("sum"), F.when(hit, F.coalesce(acc["a"], x["at"] - WINDOW)).otherwise(acc["a"]).alias("a"), F.when(hit, x["at"]).otherwise(acc["b"]).alias("b"))

        return _let(acc["sum"] - less + more, settled)

    def scan(part: Column) -> Column:
        codes = F.transform(F.regexp_extract_all(part, F.lit("."), F.lit(0)), lambda c: F.ascii(c) - _FIRST)
        rows = _let(codes, lambda cs: F.transform(cs, lambda c, i: F.struct(c.alias("i"), F.get(cs, i - WINDOW).alias("o"), (i + 1).alias("at"))))
        zero = F.struct(F.array_repeat(F.lit(0).cast("long"), _NUMBERS).alias("n"), F.lit(0).alias("sum"), none.alias("a"), none.alias("b"))
        return F.aggregate(rows, zero, step)

    def parts(ps: Column) -> Column:
        whole = lambda p, k: F.concat(p, F.substring(F.coalesce(F.get(ps, k + 1), F.lit("")), 1, WINDOW - 1))
        moved = lambda h, k: F.struct((h["a"] + k * PIECE).alias("a"), (h["b"] + k * PIECE).alias("b"))
        return F.transform(ps, lambda p, k: _let(scan(whole(p, k)), lambda h: moved(h, k)))

    hits = _let(F.regexp_extract_all(w, F.lit(f".{{1,{PIECE}}}"), F.lit(0)), parts)
    ends = _let(hits, lambda h: F.struct(F.array_min(F.transform(h, lambda x: x["a"])).alias("a"), F.array_max(F.transform(h, lambda x: x["b"])).alias("b")))
    return F.when(limit.isNotNull(), _let(ends, lambda x: F.when(x["a"].isNotNull(), x)))


def _limit(w: Column) -> Column:
    out = F.lit(None).cast("int")
    for pattern, bits in reversed(CLASSES):
        out = F.when(w.rlike(pattern), F.lit(None if bits is None else ceiling(bits)).cast("int")).otherwise(out)
    return out


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: list[str] = [UUID], placeholders: list[str] = PLACEHOLDERS) -> DataFrame:  # noqa: B006
    """One row per row of ``docs``: id, text, base and added, arrays of struct<s, k, e> by start, then kind.

    ``k`` is the place in ``KINDS``; positions are code points, ends exclusive.
    Null and empty texts have empty arrays. What base spans and placeholders
    leave of a run of key-like characters is a candidate of its own; candidates
    of words and numbers, and such as match ``allow``, are not reported.
    Repeated rows and null ids stay as they are; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    none, low, t = F.array().cast(_SPANS), F.lower("t"), F.col("t")
    word = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    held = F.lit(False)
    for p in placeholders:
        held = held | t.contains(p)
    rows = rows.select(
        "id", "text",
        F.when(word, _found(t, ASSIGN, 2, 0)).otherwise(none).alias("m0"),
        F.when(t.contains("AKIA"), _found(t, ACCESS, 0, 1)).otherwise(none).alias("m1"),
        F.when(t.rlike(HEX), _found(t, HEX, 0, 2)).otherwise(none).alias("m2"),
        F.when(t.rlike(CANDIDATE), _found(t, CANDIDATE, 0, 3)).otherwise(none).alias("m3"),
        # from the start of letters and digits only: trying the rest again would take quadratic time
        F.when(held, _found(t, "(?<![A-Za-z0-9])" + placeholder(placeholders), 0, 3)).otherwise(none).alias("m4"),
    )
    slim = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    base = F.array_sort(slim(F.concat(F.filter("m0", lambda x: F.length(x["g"]) >= 8), F.col("m1"), F.col("m2"))))
    rows = rows.select("id", "text", base.alias("base"), "m3", "m4")

    def wanted(x: Column) -> Column:
        out = x["w"].rlike(NO_WORDS)
        for p in allow:
            out = out & ~x["w"].rlike(p)
        return out

    def scanned(masks: Column) -> Column:
        pieces = F.filter(F.flatten(F.transform("m3", lambda x: _pieces(x, masks))), wanted)
        return F.transform(pieces, lambda x: F.struct(x["s"].alias("s"), _let(_limit(x["w"]), lambda limit: _hot(x["w"], limit)).alias("h")))

    hot = _let(_blocks(F.array_sort(F.concat(F.col("base"), slim(F.col("m4"))))), scanned)
    hot = F.filter(hot, lambda x: x["h"].isNotNull())
    added = F.transform(hot, lambda x: F.struct((x["s"] + x["h"]["a"]).alias("s"), F.lit(3).alias("k"), (x["s"] + x["h"]["b"]).alias("e")))
    nothing = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return rows.select("id", "text", "base", F.when(F.size("m3") > 0, added).otherwise(nothing).alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"], x["e"])), ",")


def op3_secret_scan(spark, sf_dir) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of all of ``documents``."""
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by its first kind in brackets.

    Spans are by start. They are taken in blocks: the text of a block is cut out
    once, its pieces from that, and all pieces are joined at the end.
    """
    kinds, size = F.array(*[F.lit(k) for k in KINDS]), REDACTED
    left = "array<struct<at:int,s:int,k:int>>"

    def step(acc: Column, x: Column) -> Column:
        piece = F.struct(acc["at"].alias("at"), x["s"].alias("s"), x["k"].alias("k"))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(piece))).alias("out"))

    def block(part: Column, begin: Column) -> Column:
        """The pieces of a block whose earlier spans end at ``begin``, each with its mark."""
        found = F.aggregate(part, F.struct(begin.alias("at"), F.array().cast(left).alias("out")), step)

        def cut(acc: Column) -> Column:
            own = F.substring(text, begin + 1, acc["at"] - begin)
            piece = lambda t, x: F.concat(F.substring(t, x["at"] - begin + 1, x["s"] - x["at"]), F.lit("["), F.element_at(kinds, x["k"] + 1), F.lit("]"))
            return _let(own, lambda t: F.array_join(F.transform(acc["out"], lambda x: piece(t, x)), ""))

        return _let(found, cut)

    def pieces(parts: Column) -> Column:
        most = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), F.array_max(F.transform(p, lambda x: x["e"]))))))
        joined = lambda at: F.concat(F.array_join(F.transform(parts, lambda p, i: block(p, F.get(at, i))), ""), F.substring(text, F.element_at(at, -1) + 1, F.length(text)))
        return _let(most, joined)

    return _let(F.transform(_firsts(spans, size), lambda b: _slice(spans, b, size)), pieces)


def redact_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced by their kind, and ``n_chars`` follows."""
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*rest).alias("row"), "text")
    found = secret_spans(packed, "row", "text").select(F.col("id").alias("row"), "text", F.array_sort(F.concat("base", "added")).alias("spans"))
    found = found.select("row", F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text")).alias("text"))
    kind = dict(docs.dtypes).get("n_chars")
    pick = lambda c: F.col("text") if c == "text" else F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
    return found.select(*[pick(c) for c in docs.columns])


def _sql_found(name: str, pattern: str, group: int) -> str:
    q = pattern.replace("'", "''")
    return f"""{name} AS (SELECT doc_id, rid, unnest(range(1, len(w) + 1)) AS i, w, p, g FROM (SELECT doc_id, rid,
      regexp_extract_all(t, '{q}') AS w, string_split_regex(t, '{q}') AS p, regexp_extract_all(t, '{q}', {group}) AS g FROM d WHERE regexp_matches(t, '{q}'))),
    {name}_s AS (SELECT doc_id, rid, w[i] AS w, g[i] AS g, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s FROM {name})"""


def _sql_limit() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(w, '{p}') THEN {'NULL' if b is None else ceiling(b)}" for p, b in CLASSES) + " END"


#: Counts every window afresh, without the running sums.
OP3_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
{_sql_found("a", ASSIGN, 2)},
{_sql_found("k", ACCESS, 0)},
{_sql_found("h", HEX, 0)},
{_sql_found("c", CANDIDATE, 0)},
{_sql_found("x", placeholder(PLACEHOLDERS), 0)},
base AS (
  SELECT rid, s, 0 AS o, s + length(w) AS e FROM a_s WHERE length(g) >= 8
  UNION ALL SELECT rid, s, 1, s + length(w) FROM k_s
  UNION ALL SELECT rid, s, 2, s + length(w) FROM h_s),
masks AS (SELECT rid, s, e FROM base UNION ALL SELECT rid, s, s + length(w) FROM x_s),
touched AS (SELECT c.rid, c.s, c.w, m.s AS ms, m.e AS me FROM c_s c JOIN masks m ON m.rid = c.rid AND m.s < c.s + length(c.w) AND c.s < m.e),
chars AS (SELECT rid, s, w, unnest(range(s, s + length(w))) AS p FROM (SELECT DISTINCT rid, s, w FROM touched)),
free AS (SELECT *, p - row_number() OVER (PARTITION BY rid, s ORDER BY p) AS island FROM chars h WHERE NOT EXISTS (SELECT 1 FROM touched t WHERE t.rid = h.rid AND t.s = h.s AND t.ms <= h.p AND h.p < t.me)),
pieces AS (
  SELECT rid, min(p) AS s, substring(any_value(w), min(p) - any_value(s) + 1, count(*)) AS w FROM free GROUP BY rid, free.s, island HAVING count(*) >= {WINDOW}
  UNION ALL SELECT rid, s, w FROM c_s WHERE (rid, s) NOT IN (SELECT rid, s FROM touched)),
fresh AS (SELECT rid, s, w, {_sql_limit()} AS lim FROM pieces WHERE regexp_matches(w, '{NO_WORDS}') AND NOT regexp_matches(w, '{UUID}')),
win AS (SELECT rid, s, lim, i, substring(w, i, {WINDOW}) AS x FROM (SELECT *, unnest(range(1, length(w) - {WINDOW} + 2)) AS i FROM fresh WHERE lim IS NOT NULL)),
hot AS (SELECT rid, s, i FROM win WHERE list_sum(list_transform(list_distinct(string_split(x, '')),
  lambda c: [{", ".join(str(sum(GAINS[:n])) for n in range(1, WINDOW + 1))}][length(x) - length(replace(x, c, ''))])) <= lim),
alls AS (SELECT *, 'base' AS f FROM base UNION ALL SELECT rid, s + min(i) - 1, 3, s + max(i) - 1 + {WINDOW}, 'added' FROM hot GROUP BY rid, s),
told AS (SELECT rid, s, o, f, [{", ".join(f"'{k}'" for k in KINDS)}][o + 1] || ':' || s || ':' || e AS x FROM alls)
SELECT d.doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
  sha256(coalesce(string_agg(x, ',' ORDER BY s, o) FILTER (f = 'base'), '')) AS base_sha256,
  coalesce(string_agg(x, ',' ORDER BY s, o), '') AS spans
FROM d LEFT JOIN told USING (rid) GROUP BY d.rid, d.doc_id
"""
