"""URL filters: stated rules first, then a path-template tree per host judged by smoothed purity.

Method. Path segments make a tree under each host, of any depth. Segments that are numbers, hexadecimal or very long become
wildcards by their form; under a parent with more than CHILDREN children, those with under 1/CHILDREN of its pages become one wildcard by their
numbers. Pages that a rule fits are the labelled ones. Level by level, siblings whose share of blocked pages does
not differ from their parent's by more than Z standard errors, unlabelled ones too, merge into one branch. A branch's purity is its share of blocked
pages, smoothed with STRENGTH pages of its parent's purity, and the host's with those of PRIOR. A branch is followed further as long as it has labelled pages of
both verdicts and paths that go on: in others nothing below could differ. A template whose purity
reaches REJECT blocks the pages that no rule fits; others are allowed.

Scale. Only the url is read. Pages are counted by host and template with partial sums, and the tree is built over those counts,
level by level, written to the shared folder; there are as many levels as mixed branches are deep. Pages meet their template's verdict in a join that may be split where one host is hot.
No page text, Python or window is involved.

Cases. A null url, or one without `://`, has an empty host and path, and no rule fits it unless its parts allow that. Ties between
rules of the same length go to the first in text order. Repeated rows and null ids come out as they went in. An empty table gives no
rows. Other columns aren't read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textvec import checkpointed

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
CHILDREN = 20
Z = 1.96
STRENGTH = 4.0
PRIOR = 0.25
REJECT = 0.5
#: Levels that the SQL writes out; the operator has no such bound.
LEVELS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def split_url(url: str) -> tuple[str, str]:
    """SQL for host and path."""
    u = f"coalesce({url}, '')"
    rest = f"(CASE WHEN instr({u}, '://') > 0 THEN substring({u}, instr({u}, '://') + 3) ELSE '' END)"
    return f"translate(regexp_extract({rest}, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}')", f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"


def match_rule(rules, host: str = "host", path: str = "path") -> tuple[str, str]:
    """SQL for the longest rule that fits and for its verdict, null without one."""
    fits, words = [], []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0])):
        at, _, rest = rule.partition("/")
        test = f"({host} = {_text(at)} OR endswith({host}, {_text('.' + at)})) AND startswith({path}, {_text('/' + rest)})"
        fits.append(f"WHEN {test} THEN {_text(rule)}")
        words.append(f"WHEN {test} THEN {_text(verdict)}")
    case = lambda x: f"CASE {' '.join(x)} END" if x else "cast(NULL AS string)"
    return case(fits), case(words)


def _forms(path: str) -> str:
    """SQL for the forms of a path's segments, joined as they were."""
    form = """CASE WHEN s RLIKE '^[0-9]+([.][A-Za-z0-9]+)?$' THEN '{number}' WHEN s RLIKE '^[0-9a-fA-F-]{8,}$' AND s RLIKE '[0-9]' THEN '{hex}' WHEN char_length(s) > 40 THEN '{long}' ELSE s END"""
    return f"array_join(transform(slice(split({path}, '/'), 2, size(split({path}, '/'))), s -> {form}), '/')"


def parse(pages: DataFrame, page_id: str, url: str, rules) -> DataFrame:
    """(page_id, host, path, rule, ruled, form): ruled is the rule's verdict, form the path with segments of some forms as wildcards."""
    host, path = split_url("`__u`")
    rule, ruled = match_rule(rules)
    out = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("__u")).select("page_id", F.expr(host).alias("host"), F.expr(path).alias("path"))
    return out.withColumns({"rule": F.expr(rule), "ruled": F.expr(ruled), "form": F.expr(_forms("path"))})


def _branches(live: DataFrame) -> DataFrame:
    """(host, branch, own, next, purity): for each child at a level the branch that it belongs to, and its purity."""
    above = ["host", "branch"]
    child = live.groupBy(*above, "purity", "own").agg(F.sum("n").alias("cn"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    family = child.groupBy(*above).agg(F.count("*").alias("kinds"), F.sum("cn").alias("pn"), F.sum("l").alias("pl"), F.sum("b").alias("pb"))
    child = checkpointed(child.join(family, above).withColumn("g", F.expr(f"CASE WHEN kinds > {CHILDREN} AND cn * {CHILDREN} < pn THEN '{{any}}' ELSE own END")))
    kind = child.groupBy(*above, "purity", "g", "pl", "pb").agg(F.sum("l").alias("l"), F.sum("b").alias("b"))
    q = "((pb + 0.5D) / (pl + 1D))"
    alike = f"(CASE WHEN l = 0 THEN true ELSE abs(cast(b AS double) / l - cast(pb AS double) / pl) <= {Z}D * sqrt({q} * (1D - {q}) / l) END)"
    kind = kind.withColumn("m", F.expr(f"CASE WHEN {alike} THEN '*' ELSE concat('=', g) END"))
    merged = kind.groupBy(*above, "purity", "m").agg(F.sum("l").alias("bl"), F.sum("b").alias("bb")).withColumn("next", F.expr(f"(bb + {STRENGTH}D * purity) / (bl + {STRENGTH}D)"))
    known = kind.select(*above, "g", "m").join(merged.select(*above, "m", "next"), [*above, "m"])
    return child.select(*above, "own", "g").join(known, [*above, "g"]).select(*above, "own", F.concat("branch", F.lit("/"), "m").alias("deeper"), F.col("next").alias("deeper_purity"))


def templates(parsed: DataFrame) -> DataFrame:
    """(host, form, purity): every path form that occurs, with its template's purity in the tree."""
    leaves = parsed.groupBy("host", "form").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    leaves = checkpointed(leaves.withColumn("deep", F.expr("CASE WHEN form = '' THEN 0 ELSE size(split(form, '/')) END")))
    hosts = leaves.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("blocked").alias("hb")).select("host", F.expr(f"(hb + {STRENGTH}D * {PRIOR}D) / (hl + {STRENGTH}D)").alias("purity"))
    live = leaves.join(hosts, "host").withColumn("branch", F.lit(""))
    done, level = [], 0
    while True:
        mixed = live.groupBy("host", "branch").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.max("deep").alias("d")).filter(f"b > 0 AND b < l AND d > {level}").select("host", "branch", F.lit(True).alias("goes_on"))
        state = checkpointed(live.join(mixed, ["host", "branch"], "left"))
        done.append(state.filter("goes_on IS NULL").select("host", "form", "purity"))
        open_ = state.filter("goes_on").drop("goes_on").withColumn("own", F.expr(f"coalesce(get(split(form, '/'), {level}), '')"))
        if open_.isEmpty():
            return reduce(DataFrame.union, done)
        branches = _branches(open_)
        live = open_.join(branches, ["host", "branch", "own"]).drop("branch", "purity", "own").withColumnsRenamed({"deeper": "branch", "deeper_purity": "purity"})
        level += 1


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, purity) of every page."""
    parsed = parse(pages, page_id, url, rules)
    tree = checkpointed(templates(parsed))
    verdict = F.expr(f"coalesce(ruled, CASE WHEN purity >= {REJECT}D THEN 'block' ELSE 'allow' END)")
    return parsed.join(tree, ["host", "form"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "purity")


def op6_urls(spark, sf_dir: str) -> DataFrame:
    """Every page with its verdict."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("purity")


def _oracle() -> str:
    """The same in DuckDB SQL."""
    rest = "(CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END)"
    fits, words = [], []
    for verdict, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        at, _, tail = rule.partition("/")
        test = f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{tail}')"
        fits.append(f"WHEN {test} THEN '{rule}'")
        words.append(f"WHEN {test} THEN '{verdict}'")

    form = """CASE WHEN regexp_matches(s, '^[0-9]+([.][A-Za-z0-9]+)?$') THEN '{number}' WHEN regexp_matches(s, '^[0-9a-fA-F-]{8,}$') AND regexp_matches(s, '[0-9]') THEN '{hex}' WHEN length(s) > 40 THEN '{long}' ELSE s END"""
    q = "((pb + 0.5::DOUBLE) / (pl + 1::DOUBLE))"

    def level(i: int) -> str:
        return f"""
b{i} AS MATERIALIZED (SELECT host, branch, sum(labelled)::BIGINT AS l, sum(blocked)::BIGINT AS b, max(deep) AS d FROM y{i} WHERE live GROUP BY ALL),
o{i} AS MATERIALIZED (SELECT y.*, coalesce(str_split(form, '/')[{i + 1}], '') AS own FROM y{i} y JOIN b{i} x USING (host, branch) WHERE y.live AND x.b > 0 AND x.b < x.l AND x.d > {i}),
c{i} AS MATERIALIZED (SELECT host, branch, purity, own, sum(n)::BIGINT AS cn, sum(labelled)::BIGINT AS l, sum(blocked)::BIGINT AS b FROM o{i} GROUP BY ALL),
f{i} AS MATERIALIZED (SELECT host, branch, count(*) AS kinds, sum(cn)::BIGINT AS pn, sum(l)::BIGINT AS pl, sum(b)::BIGINT AS pb FROM c{i} GROUP BY ALL),
g{i} AS MATERIALIZED (SELECT c.*, pl, pb, CASE WHEN kinds > {CHILDREN} AND cn * {CHILDREN} < pn THEN '{{any}}' ELSE own END AS g FROM c{i} c JOIN f{i} USING (host, branch)),
k{i} AS MATERIALIZED (SELECT *, CASE WHEN l = 0 THEN '*' WHEN abs(b::DOUBLE / l - pb::DOUBLE / pl) <= {Z}::DOUBLE * sqrt({q} * (1::DOUBLE - {q}) / l) THEN '*' ELSE concat('=', g) END AS m
    FROM (SELECT host, branch, purity, g, pl, pb, sum(l)::BIGINT AS l, sum(b)::BIGINT AS b FROM g{i} GROUP BY ALL)),
m{i} AS MATERIALIZED (SELECT host, branch, m, (sum(b)::BIGINT + {STRENGTH}::DOUBLE * purity) / (sum(l)::BIGINT + {STRENGTH}::DOUBLE) AS next FROM k{i} GROUP BY host, branch, purity, m),
y{i + 1} AS MATERIALIZED (SELECT o.host, concat(o.branch, '/', k.m) AS branch, o.form, o.deep, o.n, o.labelled, o.blocked, m.next AS purity, true AS live
    FROM o{i} o JOIN g{i} g ON g.host = o.host AND g.branch = o.branch AND g.own = o.own JOIN k{i} k ON k.host = o.host AND k.branch = o.branch AND k.g = g.g JOIN m{i} m ON m.host = o.host AND m.branch = o.branch AND m.m = k.m
    UNION ALL SELECT y.* REPLACE (false AS live) FROM y{i} y LEFT JOIN b{i} x ON x.host = y.host AND x.branch = y.branch AND y.live WHERE NOT y.live OR NOT (x.b > 0 AND x.b < x.l AND x.d > {i}))"""

    return f"""
WITH a AS (SELECT page_id, translate(regexp_extract({rest}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path FROM pages),
parsed AS MATERIALIZED (SELECT *, CASE {' '.join(fits)} END AS rule, CASE {' '.join(words)} END AS ruled, coalesce(array_to_string(list_transform(str_split(path, '/')[2:], lambda s: {form}), '/'), '') AS form FROM a),
leaf AS MATERIALIZED (SELECT host, form, CASE WHEN form = '' THEN 0 ELSE len(str_split(form, '/')) END AS deep, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS blocked FROM parsed GROUP BY host, form),
h AS (SELECT host, (sum(blocked)::BIGINT + {STRENGTH * PRIOR}::DOUBLE) / (sum(labelled)::BIGINT + {STRENGTH}::DOUBLE) AS purity FROM leaf GROUP BY host),
y0 AS MATERIALIZED (SELECT leaf.host, '' AS branch, form, deep, n, labelled, blocked, purity, true AS live FROM leaf JOIN h USING (host)),{','.join(level(i) for i in range(LEVELS))}
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= {REJECT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict FROM parsed LEFT JOIN y{LEVELS} USING (host, form)
"""


ORACLE = _oracle()
