"""Secret scans in DataFrame functions alone.

Base spans: assignments of a value to a name such as password or token, access key ids, and long hexadecimal runs.
The method adds spans of high entropy: over each candidate, a run of 20 or more characters that keys are written in, a
window of 20 slides, and the Shannon entropy in it is kept up to date by counts that go along from window to window: a
character that leaves or enters changes its own count by one, and the sum of c log2 c by an amount that depends on that
count alone. The sum is kept in whole units of 2^-40 bits, so it can't drift. The threshold depends on the class of
characters. A candidate is split into characters once, so the work grows with its length. What reaches from the first to the last window over the threshold is the span, unless the candidate is
on the allow-list or within a base span.

Positions count code points; a span's end is exclusive. Matches are found by regexp_extract_all and the text between
them by split, with the same pattern, so that lengths add up to positions. They are added up in blocks of about the square
root of their number, as each step of a fold copies what it has so far.

Defined results: a null text counts as empty and has no spans; a null id stays null; equal rows each give a row; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import read_table, texts_of

NAMES = "password|passwd|secret|token|api_?key"
ASSIGN = rf"""(?i:({NAMES}))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: The characters of a candidate.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Words and paths of words have none of these: digits, capitals within a word.
MIXED = r"[0-9]|[a-z][A-Z]|[A-Z]{2}[a-z]"
#: Runs that are known to be harmless: stand-ins, counting sequences, numbers, UUIDs.
ALLOWED = r"(?i:example|sample|placeholder|changeme|x{6}|0123456|1234567|abcdefg)|^[0-9]+$|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
HEX_CLASS = r"^[0-9a-fA-F]+$"
KINDS = ["assign", "access", "hex", "entropy"]
MIN_VALUE = 6
WINDOW = 20
#: Bits; no window of 20 has exactly these.
HEX_BITS, OTHER_BITS = 3.05, 3.85

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """The matches of pattern, each with the text before it and one of its groups."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))


def _walk(found: Column, kind: int, keep, extra=None) -> Column:
    """The spans of those matches for which keep(value) holds."""
    kind_of = "start:int,kind:int,end:int" + (",value:string" if extra else "")
    none = F.array().cast(f"array<struct<{kind_of}>>")

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        fields = [start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), *([x["value"].alias("value")] if extra else [])]
        more = F.when(keep(x["value"]), F.array(F.struct(*fields))).otherwise(none)
        return F.struct(end.alias("at"), F.concat(done["spans"], more).alias("spans"))

    def block(matches: Column) -> Column:
        return F.aggregate(matches, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)

    def moved(span: Column, by: Column) -> Column:
        return F.struct((span["start"] + by).alias("start"), span["kind"].alias("kind"), (span["end"] + by).alias("end"), *([span["value"].alias("value")] if extra else []))

    def joined(matches: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(matches))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(matches) / size).cast("int") - 1), lambda b: block(F.slice(matches, b * size + 1, size)))

        def placed(blocks: Column) -> Column:
            before = lambda b: F.aggregate(F.slice(blocks, F.lit(1), b), F.lit(0), lambda total, x: total + x["at"])
            return F.flatten(F.transform(blocks, lambda x, b: _let(before(b), lambda by: F.transform(x["spans"], lambda span: moved(span, by)))))

        return F.when(F.size(matches) > 0, _let(blocks, placed)).otherwise(none)

    return _let(F.filter(found, lambda x: x["match"].isNotNull()), joined)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _if_any(text: Column, hint: str, spans: Column, kind: str = _SPANS) -> Column:
    """spans where the text has what hint looks for, else none: most texts need no more than that look."""
    return F.when(text.rlike(hint), spans).otherwise(F.array().cast(kind))


UNIT = 2.0**40


def _growth(count: Column) -> Column:
    """By how much c log2 c grows as c comes to be count, in units."""
    table = F.array(*(F.lit(round(UNIT * (c * math.log2(c) - ((c - 1) * math.log2(c - 1) if c > 1 else 0.0)))).cast("long") for c in range(1, WINDOW + 1)))
    return F.element_at(table, count)


def _changed(counts: Column, at: Column, by: int) -> Column:
    """counts with the one at a place changed."""
    return F.concat(F.slice(counts, F.lit(1), at - 1), F.array(F.element_at(counts, at) + by), F.slice(counts, at + 1, F.lit(len(ALPHABET))))


def _hot(candidate: Column) -> Column:
    """(first, last): where the first window over the threshold begins in a candidate and the last one ends; first is -1 if there is none."""
    symbols = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    bits = F.when(candidate.rlike(HEX_CLASS), HEX_BITS).otherwise(OTHER_BITS)
    none = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("total"), F.lit(0).alias("i"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def scan(x: Column) -> Column:
        # The sum that a window of this class may have at most.
        most = F.floor((F.lit(math.log2(WINDOW)) - x["bits"]) * WINDOW * UNIT)

        def step(done: Column, entering: Column) -> Column:
            i = done["i"]
            # The one that leaves goes first; before the window is full, none does.
            leaving = F.when(i >= WINDOW, F.element_at(x["symbols"], F.greatest(i - WINDOW, F.lit(0)) + 1))
            left = F.when(leaving.isNull(), done["counts"]).otherwise(_changed(done["counts"], leaving, -1))
            less = F.when(leaving.isNull(), F.lit(0).cast("long")).otherwise(_growth(F.element_at(done["counts"], leaving)))

            def entered(counts: Column) -> Column:
                total = done["total"] - less + _growth(F.element_at(counts, entering) + 1)
                hot = (i >= WINDOW - 1) & (total <= most)
                return F.struct(
                    _changed(counts, entering, 1).alias("counts"), total.alias("total"), (i + 1).alias("i"),
                    F.when(hot & (done["first"] < 0), i - WINDOW + 1).otherwise(done["first"]).alias("first"), F.when(hot, i + 1).otherwise(done["last"]).alias("last"),
                )

            return _let(left, entered)

        return F.aggregate(x["symbols"], none, step, lambda done: F.struct(done["first"].alias("first"), done["last"].alias("last")))

    return _let(F.struct(symbols.alias("symbols"), bits.alias("bits")), scan)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, entropy): arrays of (start, kind, end), sorted; kind counts in KINDS."""
    docs = texts_of(df, id_col, text_col)
    text = F.col("text")
    anything = F.lit(True)
    assign = _if_any(text, f"(?i:{NAMES})", _walk(_found(text, ASSIGN, 2), 0, lambda value: F.length(value) >= MIN_VALUE))
    access = _if_any(text, "AKIA", _walk(_found(text, ACCESS), 1, lambda _: anything))
    hexes = _if_any(text, HEX, _walk(_found(text, HEX), 2, lambda _: anything))
    # Struct fields are compared in their order: by start, then by kind.
    found = docs.select("doc_id", F.array_sort(F.concat(assign, access, hexes)).alias("base"), _if_any(text, CANDIDATE, _walk(_found(text, CANDIDATE), 3, lambda value: value.rlike(MIXED) & ~value.rlike(ALLOWED), extra=True), "array<struct<start:int,kind:int,end:int,value:string>>").alias("candidates"))
    hot = F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), _hot(c["value"]).alias("hot")))
    hot = F.transform(F.filter(hot, lambda c: c["hot"]["first"] >= 0), lambda c: F.struct((c["start"] + c["hot"]["first"]).alias("start"), F.lit(3).alias("kind"), (c["start"] + c["hot"]["last"]).alias("end")))
    entropy = F.filter(hot, lambda c: ~F.exists("base", lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"])))
    return found.select("doc_id", "base", F.when(F.size("candidates") > 0, entropy).otherwise(F.array().cast(_SPANS)).alias("entropy"))


def report(scanned: DataFrame) -> DataFrame:
    """Numbers, digest and text of the spans that scan() has found."""
    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return scanned.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.size("entropy").cast("long").alias("n_entropy"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "entropy"))).alias("spans"),
    )


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every whole text of documents."""
    return report(scan(read_table(spark, sf_dir, "documents")))


def _sql_spans(pattern: str, kind: int, group: int, keep: str) -> str:
    """DuckDB: spans of one kind from the texts between matches and the matches."""
    quoted = pattern.replace("'", "''")
    return f"""(
        SELECT doc_id, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
               'k': {kind}, 'e': list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))), 'v': v[i]}}), lambda z: {keep}) AS l
        FROM (SELECT doc_id, string_split_regex(t, '{quoted}') AS g, regexp_extract_all(t, '{quoted}', 0) AS m, regexp_extract_all(t, '{quoted}', {group}) AS v FROM d))"""


def _sql() -> str:
    allowed = ALLOWED.replace("'", "''")
    base = {0: _sql_spans(ASSIGN, 0, 2, f"length(z.v) >= {MIN_VALUE}"), 1: _sql_spans(ACCESS, 1, 0, "true"), 2: _sql_spans(HEX, 2, 0, "true")}
    other = _sql_spans(CANDIDATE, 3, 0, f"regexp_matches(z.v, '{MIXED}') AND NOT regexp_matches(z.v, '{allowed}')")
    name = "['assign', 'access', 'hex', 'entropy'][z.k + 1]"
    join = f"coalesce(array_to_string(list_transform(list_sort(%s), lambda z: {name} || ':' || z.s::BIGINT || ':' || z.e::BIGINT), ','), '')"
    plain = "list_transform(%s, lambda z: {'s': z.s::BIGINT, 'k': z.k, 'e': z.e::BIGINT})"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, list_concat(list_concat({plain % "a0.l"}, {plain % "a1.l"}), {plain % "a2.l"}) AS base, len(a0.l) AS n_assign, len(a1.l) AS n_access, len(a2.l) AS n_hex, c.l AS cand
      FROM {base[0]} a0 JOIN {base[1]} a1 USING (doc_id) JOIN {base[2]} a2 USING (doc_id) JOIN {other} c USING (doc_id)),
w AS (SELECT *, list_transform(cand, lambda c: {{'s': c.s::BIGINT, 'hot': list_filter(range(0, length(c.v) - {WINDOW} + 1),
        lambda i: list_aggregate(string_split(substr(c.v, i + 1, {WINDOW}), ''), 'entropy') >= CASE WHEN regexp_matches(c.v, '{HEX_CLASS}') THEN {HEX_BITS} ELSE {OTHER_BITS} END)}}) AS h FROM b),
e AS (SELECT *, list_filter(list_transform(list_filter(h, lambda x: len(x.hot) > 0), lambda x: {{'s': x.s + x.hot[1], 'k': 3, 'e': x.s + x.hot[-1] + {WINDOW}}}),
        lambda x: len(list_filter(base, lambda y: y.s <= x.s AND y.e >= x.e)) = 0) AS entropy FROM w)
SELECT doc_id, n_assign::BIGINT AS n_assign, n_access::BIGINT AS n_access, n_hex::BIGINT AS n_hex, len(entropy)::BIGINT AS n_entropy, sha256({join % "base"}) AS base_sha256,
       {join % "list_concat(base, list_transform(entropy, lambda z: {'s': z.s, 'k': z.k, 'e': z.e}))"} AS spans
FROM e
"""


OP1_SQL = _sql()
