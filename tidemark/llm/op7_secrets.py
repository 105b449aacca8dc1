"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Everything is a Spark SQL expression over one row, so the scan is one map stage with no shuffle and no Python.

Method. A candidate is a maximal run of 20 or more letters, digits and `+/_-` that holds a digit and a letter. Its
character class (hexadecimal, lower-case or upper-case with digits, mixed) sets the least entropy that counts. A window of
20 characters slides along the candidate; symbol counts, five bits each and twelve to a number, change by one character in and one out, and the
sum of c*log2(c) changes by the difference at those two counts, so the entropy log2(20) - sum/20 costs the same at each step. Sums are whole
numbers of 1e-9 bits, so they don't drift.
The span runs from the first window at or over the threshold to the last. Candidates that fit an allow-list pattern
(identifiers by form, dates, words joined by dashes) and those that overlap a pattern's span add nothing.

Time grows with a text's length, whatever is in it: patterns take what they match without going back, and positions are running sums, made
in steps over arrays that reach sixteen times as far each (n log n).

Cases. A null text is an empty one and has no spans. Empty and very long texts, repeated rows and ids, and null ids are
rows like others: one row comes out for each row that goes in. Positions are code points, ends exclusive. Only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Least entropy in bits of a window, by character class.
THRESHOLDS = {"hex": 3.0, "case": 3.4, "mixed": 3.7}
#: Candidates that fit one of these add nothing. Groups that repeat are possessive: such a loop takes no stack.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]{1,14}+(?:[-_/][A-Za-z]{1,14}+)*+(?:[-_/][0-9]{1,8}+)*+$",
    r"^[0-9]{4}[-/_][0-9]{2}[-/_][0-9]{2}[0-9A-Za-z+/_-]{0,12}$",
)
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_UNIT = 10**9
#: Running results are made in steps that reach _RADIX times as far each; this is enough for arrays of 2**28 items.
_RADIX, _STEPS = 16, 7
_BLOCK = 4096
_NONE = "cast(array() AS array<struct<s:int,e:int,v:string>>)"


def _quoted(text: str) -> str:
    """A raw Spark SQL literal of a pattern."""
    assert "'" not in text or '"' not in text.replace("\\\"", "")
    return "r'" + text + "'" if "'" not in text else 'r"' + text + '"'


#: As ASSIGN, with quotes that a raw SQL literal can hold.
_ASSIGN_SQL = ASSIGN.replace("\"'", r"\x22'").replace('"', r"\x22")


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with a value that is made once under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(numbers: str, join: str, none: str) -> str:
    """SQL for the array of running results of an array. Each step joins _RADIX results that lie side by side; join has {x} for them, none stands for those before the first."""
    for k in range(_STEPS):
        n = _RADIX**k
        before = ", ".join(f"coalesce(get(a, i - {j * n}), {none})" for j in range(1, _RADIX))
        joined = join.format(x=before if "," in join else before.replace(", coalesce", " + coalesce"))
        numbers = _let(numbers, "a", f"CASE WHEN size(a) > {n} THEN transform(a, (v, i) -> {joined}) ELSE a END")
    return numbers


def _spans(text: str, pattern: str, keep: str = "true", value: str = "0") -> str:
    """SQL for array<struct<s,e,v>>: code point spans of a pattern's matches, leftmost and non-overlapping, and a group of each.

    Splitting by the pattern gives the gaps, extracting gives the matches; running sums of lengths give positions.
    """
    p = _quoted(pattern)
    made = f"""transform(m.x, (x, i) -> named_struct('s', m.e[i] - char_length(x), 'e', m.e[i], 'v', m.v[i]))"""
    ends = _running(f"transform(m.x, (x, i) -> char_length(x) + char_length(m.g[i]))", "v + {x}", "0")
    found = f"regexp_extract_all({text}, {p}, 0)"
    group = found if value == "0" else f"regexp_extract_all({text}, {p}, {value})"
    both = _let(f"named_struct('x', {found}, 'g', split({text}, {p}, -1), 'v', {group})", "m", f"named_struct('x', m.x, 'v', m.v, 'e', {ends})")
    return f"(CASE WHEN {text} RLIKE {p} THEN filter({_let(both, 'm', made)}, m -> {keep}) ELSE {_NONE} END)"


def _tagged(spans: str, order: int) -> str:
    return f"transform({spans}, m -> named_struct('s', m.s, 'k', {order}, 'e', m.e))"


def _window_span(c: str) -> str:
    """SQL for struct<first,last>: where the first and the last window of candidate c at or over its class's entropy lie, -1 for none."""
    most = {k: math.floor((math.log2(WINDOW) - t) * WINDOW * _UNIT) for k, t in THRESHOLDS.items()}
    at_most = f"(CASE WHEN {c} RLIKE '^[0-9a-fA-F]+$' THEN {most['hex']}L WHEN {c} RLIKE '[a-z]' AND {c} RLIKE '[A-Z]' THEN {most['mixed']}L ELSE {most['case']}L END)"
    f = "array(" + ", ".join(f"{round(n * math.log2(n) * _UNIT) if n else 0}L" for n in range(WINDOW + 1)) + ")"
    count = lambda x: f"cast(shiftright(a.n[{x} div 12], 5 * ({x} % 12)) & 31 AS int)"
    one = lambda x: f"shiftleft(1L, 5 * ({x} % 12))"
    moved = f"""a.sum + (CASE WHEN x.p = x.q THEN 0L ELSE {f}[{count('x.p')} + 1] - {f}[{count('x.p')}]
        + (CASE WHEN x.q < 0 THEN 0L ELSE {f}[{count('x.q')} - 1] - {f}[{count('x.q')}] END) END)"""
    counts = f"""CASE WHEN x.p = x.q THEN a.n ELSE transform(a.n, (v, k) -> v + (CASE WHEN k = x.p div 12 THEN {one('x.p')} ELSE 0L END)
        - (CASE WHEN x.q >= 0 AND k = x.q div 12 THEN {one('x.q')} ELSE 0L END)) END"""
    hot = f"i >= {WINDOW - 1} AND sum <= b"
    step = f"""named_struct('n', {counts}, 'sum', sum, 'first', CASE WHEN a.first < 0 AND {hot} THEN i - {WINDOW - 1} ELSE a.first END, 'last', CASE WHEN {hot} THEN i + 1 ELSE a.last END)"""
    slide = f"""aggregate(sequence(0, size(t) - 1), named_struct('n', array_repeat(0L, {-(-len(_SYMBOLS) // 12)}), 'sum', 0L, 'first', -1, 'last', -1),
        (a, i) -> {_let(f"named_struct('p', t[i], 'q', CASE WHEN i >= {WINDOW} THEN t[i - {WINDOW}] ELSE -1 END)", 'x', _let(moved, 'sum', step))},
        a -> named_struct('first', a.first, 'last', a.last))"""
    return _let(at_most, "b", _let(f"transform(split({c}, ''), y -> instr('{_SYMBOLS}', y) - 1)", "t", slide))


def _clear(candidates: str, base: str) -> str:
    """SQL for the candidates that overlap no base span. Both are put in one order; running extremes tell how far the base spans before reach and where the next begins."""
    far = 2**31 - 1
    mixed = f"""array_sort(concat(transform({candidates}, c -> named_struct('s', c.s, 'base', 0, 'e', c.e, 'v', c.v)), transform({base}, c -> named_struct('s', c.s, 'base', 1, 'e', c.e, 'v', ''))))"""
    reach = _running("transform(o, c -> CASE WHEN c.base = 1 THEN c.e ELSE -1 END)", "greatest(v, {x})", "-1")
    ahead = f"reverse({_running(f'transform(reverse(o), c -> CASE WHEN c.base = 1 THEN c.s ELSE {far} END)', 'least(v, {x})', str(far))})"
    free = _let(reach, "r", _let(ahead, "n", "filter(transform(o, (c, i) -> CASE WHEN c.base = 0 AND r[i] <= c.s AND n[i] >= c.e THEN named_struct('s', c.s, 'e', c.e, 'v', c.v) END), c -> c IS NOT NULL)"))
    return f"(CASE WHEN size({base}) = 0 THEN {candidates} ELSE {_let(mixed, 'o', free)} END)"


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """df with a column of all spans, array<struct<s,k,e>> by start and then kind; k counts KINDS from 0."""
    t = f"coalesce(`{text}`, '')"
    base = f"""concat({_tagged(_spans(t, _ASSIGN_SQL, "char_length(m.v) >= 8", "2"), 0)},
        CASE WHEN contains({t}, 'AKIA') THEN {_tagged(_spans(t, ACCESS), 1)} ELSE cast(array() AS array<struct<s:int,k:int,e:int>>) END,
        {_tagged(_spans(t, HEX), 2)})"""
    allow = " OR ".join(f"m.v RLIKE {_quoted(p)}" for p in ALLOW)
    candidates = _spans(t, CANDIDATE, f"m.v RLIKE '[0-9]' AND m.v RLIKE '[A-Za-z]' AND NOT ({allow})")
    hot = f"filter(transform({_let(candidates, 'q', _clear('q', '`__tm_base`'))}, c -> named_struct('c', c, 'w', {_window_span('c.v')})), x -> x.w.first >= 0)"
    added = f"transform({hot}, x -> named_struct('s', x.c.s + x.w.first, 'k', 3, 'e', x.c.s + x.w.last))"
    return (
        df.withColumn("__tm_base", F.expr(base))
        .withColumn(out, F.expr(f"array_sort(concat(`__tm_base`, {added}))"))
        .drop("__tm_base")
    )


def spans_text(spans: str, most: int = 3) -> str:
    """SQL for `kind:start:end` of spans up to a kind, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform(filter({spans}, x -> x.k <= {most}), x -> concat(array({names})[x.k], ':', x.s, ':', x.e)), ',')"


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every span of its text replaced by a mark; overlapping spans are replaced as one. A null text stays null."""
    reach = _running("transform(`__tm_spans`, x -> x.e)", "greatest(v, {x})", "-1")
    heads = "filter(transform(`__tm_spans`, (x, i) -> CASE WHEN i = 0 OR x.s > r[i - 1] THEN named_struct('i', i, 's', x.s) END), x -> x IS NOT NULL)"
    merged = _let(reach, "r", _let(heads, "h", "transform(h, (x, i) -> named_struct('s', x.s, 'e', r[(CASE WHEN i + 1 < size(h) THEN h[i + 1].i ELSE size(r) END) - 1]))"))
    # the text in blocks, as finding a place in a string takes as long as the way there
    part = f"substring(b[j], greatest(x.a - j * {_BLOCK}, 0) + 1, least(x.z - j * {_BLOCK}, {_BLOCK}) - greatest(x.a - j * {_BLOCK}, 0))"
    piece = f"CASE WHEN x.z > x.a THEN array_join(transform(sequence(x.a div {_BLOCK}, (x.z - 1) div {_BLOCK}), j -> {part}), '') ELSE '' END"
    gaps = f"""transform(sequence(0, size(`__tm_cut`)), i -> named_struct('a', cast(CASE WHEN i = 0 THEN 0 ELSE `__tm_cut`[i - 1].e END AS int),
        'z', cast(CASE WHEN i < size(`__tm_cut`) THEN `__tm_cut`[i].s ELSE char_length(`{text}`) END AS int)))"""
    pieces = _let(f"regexp_extract_all(`{text}`, '(?s).{{1,{_BLOCK}}}', 0)", "b", f"array_join(transform({gaps}, x -> {piece}), '{mark}')")
    return (
        find_secrets(df, text, "__tm_spans")
        .withColumn("__tm_cut", F.expr(merged))
        .withColumn(text, F.expr(f"CASE WHEN size(`__tm_cut`) = 0 THEN `{text}` ELSE {pieces} END"))
        .drop("__tm_spans", "__tm_cut")
    )


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """One row per document with its counts, a digest of the pattern spans and all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda k: F.expr(f"cast(size(filter(secrets, x -> x.k = {k})) AS bigint)")
    return find_secrets(docs).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.expr(f"sha2({spans_text('secrets', 2)}, 256)").alias("base_sha256"),
        F.expr(spans_text("secrets")).alias("spans"),
    )


def _either_case(words: str) -> str:
    """A pattern with each letter in either case, of ASCII alone: a flag would let letters of other alphabets fold into these."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def _oracle() -> str:
    """The same in DuckDB SQL: matches have places by adding up gaps and matches in turn, and every window is counted anew."""
    assign = ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", _either_case("password|passwd|secret|token|api_?key"))
    quoted = lambda p: "'" + p.replace("'", "''") + "'"

    def found(name: str, pattern: str, group: int, keep: str) -> str:
        p = quoted(pattern)
        parts = f"unnest(string_split_regex(t, {p})) AS g, unnest(regexp_extract_all(t, {p}, 0)) AS x, unnest(regexp_extract_all(t, {p}, {group})) AS v, unnest(range(len(regexp_extract_all(t, {p}, 0)) + 1)) AS i"
        ends = "sum(length(g) + length(x)) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING)"
        return f"{name} AS (SELECT r, x, e - length(x) AS s, e FROM (SELECT r, x, v, CAST({ends} AS BIGINT) AS e FROM (SELECT r, {parts} FROM d)) WHERE x IS NOT NULL AND {keep})"

    allow = " OR ".join(f"regexp_matches(x, {quoted(p.replace('+)', ')').replace('}+', '}').replace(')*+', ')*'))})" for p in ALLOW)
    most = {k: math.floor((math.log2(WINDOW) - t) * WINDOW * _UNIT) for k, t in THRESHOLDS.items()}
    cost = "[" + ", ".join(str(round(n * math.log2(n) * _UNIT) if n else 0) for n in range(WINDOW + 1)) + "]"
    total = f"list_sum(list_transform(list_distinct(w), lambda c: {cost}[len(list_filter(w, lambda y: y = c)) + 1]))"
    at_most = f"CASE WHEN regexp_full_match(x, '[0-9a-fA-F]+') THEN {most['hex']} WHEN regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]') THEN {most['mixed']} ELSE {most['case']} END"
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    told = lambda cond: f"coalesce(string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER ({cond}), '')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{found('a0', assign, 2, 'length(v) >= 8')}, {found('a1', 'AKIA[A-Z0-9]+', 0, 'length(x) >= 16')}, {found('a2', '[0-9a-f]+', 0, 'length(x) >= 32')},
base AS MATERIALIZED (SELECT r, 0 AS k, s, e FROM a0 UNION ALL SELECT r, 1, s, e FROM a1 UNION ALL SELECT r, 2, s, e FROM a2),
{found('a3', CANDIDATE, 0, f"regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]') AND NOT ({allow})")},
free AS (SELECT * FROM a3 c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = c.r AND b.s < c.e AND c.s < b.e)),
windows AS (SELECT r, s, e, x, p, str_split(substring(x, p + 1, {WINDOW}), '') AS w FROM (SELECT *, unnest(range(length(x) - {WINDOW - 1})) AS p FROM free)),
hot AS (SELECT r, s + min(p) AS s, s + max(p) + {WINDOW} AS e FROM windows WHERE {total} <= {at_most} GROUP BY r, windows.s, windows.e, x),
spans AS (SELECT * FROM base UNION ALL SELECT r, 3, s, e FROM hot)
SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, sha256({told('k < 3')}) AS base_sha256, {told('k IS NOT NULL')} AS spans
FROM d LEFT JOIN spans USING (r) GROUP BY r, doc_id
"""


ORACLE = _oracle()
