import math
import random
import re
from collections import defaultdict

import duckdb

from tidemark.llm import op6_urls as o

rng = random.Random(12)
SCHEMA = "page_id bigint, url string, html string, host string, s1 string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path, rules):
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0])):
        at, _, rest = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + rest):
            return rule, verdict
    return None, None


def form(s):
    if re.search(r"^[0-9]+([.][A-Za-z0-9]+)?$", s):
        return "{number}"
    if re.search(r"^[0-9a-fA-F-]{8,}$", s) and re.search("[0-9]", s):
        return "{hex}"
    return "{long}" if len(s) > 40 else s


def brute(rows, rules):
    pages = []
    for i, url in rows:
        host, path = parts(url)
        rule, verdict = ruled(host, path, rules)
        shape = "/".join(form(x) for x in path.split("/")[1:])
        pages.append([i, host, path, rule, verdict, shape.split("/") if shape else []])
    lab = lambda own: (sum(p[4] is not None for p in own), sum(p[4] == "block" for p in own))
    hosts = defaultdict(list)
    for p in pages:
        hosts[p[1]].append(p)
    groups, purity = {}, {}

    def split(key, own, level, value):
        pl, pb = lab(own)
        if not 0 < pb < pl or max(len(p[5]) for p in own) <= level:
            groups[key], purity[key] = own, value
            return
        child = defaultdict(list)
        for p in own:
            child[p[5][level] if len(p[5]) > level else ""].append(p)
        kinds = defaultdict(list)
        for c, mine in child.items():
            kinds["{any}" if len(child) > o.CHILDREN and len(mine) * o.CHILDREN < len(own) else c] += mine
        branch = defaultdict(list)
        for c, mine in kinds.items():
            n, b = lab(mine)
            q = (pb + 0.5) / (pl + 1)
            alike = n == 0 or abs(b / n - pb / pl) <= o.Z * math.sqrt(q * (1 - q) / n)
            branch["*" if alike else "=" + c] += mine
        for m, mine in branch.items():
            n, b = lab(mine)
            split((*key, m), mine, level + 1, (b + o.STRENGTH * value) / (n + o.STRENGTH))

    for h, own in hosts.items():
        n, b = lab(own)
        split((h,), own, 0, (b + o.STRENGTH * o.PRIOR) / (n + o.STRENGTH))
    out = []
    for k, own in groups.items():
        out += [(str(p[0]), p[1], p[2], p[3], p[4] or ("block" if purity[k] >= o.REJECT else "allow")) for p in own]
    return sorted(out, key=str)


def urls(n):
    out = []
    for i in range(n):
        host = rng.choice(["a.example.org", "example.org", "b.example.com", "C.Example.COM", "d.net", "d.net", "d.net", "x.com"])
        seg = rng.choice(["en", "es", "fr", "de", str(i), f"u{rng.randint(0, 60)}", "deadbeef01"])
        out.append((i, f"http{rng.choice(['', 's'])}://{host}/{seg}/{rng.choice([str(rng.randint(1, 99)), 'p' + str(rng.randint(0, 40)), 'deep/' + str(i), ''])}{rng.choice(['', '?q=/x', '#y', '.html'])}"))
    return out


CASES = [(9000, None), (9001, ""), (9002, "no scheme/x"), (9003, "http://"), (9004, "http://HOST?x"), (9005, "x://É.org/a"), (9006, "http://example.org"), (9007, "http://org/a"), (9008, "http://notorg/a"), (9008, "http://notorg/a"), (None, "http://d.net/en/1"), (9009, "http://h.org/" + "s" * 5000 + "/x"), (9010, "a://b://c/d"), (9011, "http://u@h.com:80/de/1")]


def test_against_brute_force_and_sql(spark, write):
    rows = urls(900) + CASES
    d = write(pages=([(i, u, "h", "x", "y") for i, u in rows], SCHEMA))
    got = sorted(((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in o.op6_urls(spark, d).collect()), key=str)
    assert got == brute(rows, o.RULES)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT page_id, url, html FROM '{d}/pages.parquet/*.parquet'")
    assert sorted(((str(r[0]), *r[1:]) for r in con.execute(o.ORACLE).fetchall()), key=str) == got
    assert {v for *_, r, v in got if r is None} == {"allow", "block"}


def test_rules_that_differ_at_the_sixth_segment(spark, write):
    rows = [(i, f"http://d.io/a/b/c/d/e/{'good' if i % 2 else 'bad'}/{'x' if i < 60 else 'y/z' * (i % 3)}/{i}") for i in range(120)]
    rules = [("allow", "d.io/a/b/c/d/e/good/x"), ("block", "d.io/a/b/c/d/e/bad/x")]
    pages = spark.read.parquet(write(pages=([(i, u, "h", "x", "y") for i, u in rows], SCHEMA)) + "/pages.parquet")
    got = sorted(((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in o.judge(pages, rules=rules).drop("purity").collect()), key=str)
    assert got == brute(rows, rules)
    assert all(v == ("allow" if "/good/" in path else "block") for _, _, path, _, v in got)


def test_other_rules_empty_and_native(spark, write):
    d = write(pages=([(1, "http://q.io/a'b/1")], "page_id bigint, url string"))
    pages = spark.read.parquet(f"{d}/pages.parquet")
    assert o.judge(pages, rules=[("block", "io/a'b/")]).first().verdict == "block"
    assert o.judge(pages, rules=[]).first().verdict == "allow"
    plan = o.op6_urls(spark, d)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert o.op6_urls(spark, write(pages=([], "page_id bigint, url string"))).count() == 0
