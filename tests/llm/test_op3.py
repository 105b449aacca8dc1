import random
import re
from itertools import combinations

from tidemark.llm import op3_decontaminate as o

rng = random.Random(8)
WORDS = [f"w{i}" for i in range(60)]
SCHEMA = "item_id bigint, text string"


def words(t):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())


def brute(rows, items):
    """Every alignment of every document and item."""
    out = set()
    for d, t in rows:
        for i, b in items:
            x, y = words(t), words(b)
            need = min(13, len(y))
            if len(y) < o.LEAST:
                continue
            for s in range(-len(y), len(x)):
                same = [0 <= s + j < len(x) and x[s + j] == y[j] for j in range(len(y))]
                inside = [0 <= s + j < len(x) for j in range(len(y))]
                if any(all(inside[k : k + need]) and sum(same[k : k + need]) >= need - o.allowed(need) for k in range(len(y) - need + 1)):
                    out.add((str(d), i))
    return out


def test_masks_hit_every_allowed_stretch():
    for n in range(5, 14):
        for gone in combinations(range(n), o.allowed(n)):
            assert any(not {x + p for p in m} & set(gone) for m in o.masks() for x in range(n - m[-1]))


def test_against_brute_force(spark, docs, write):
    items = [(i, " ".join(rng.choices(WORDS, k=rng.choice([2, 3, 4, 5, 7, 8, 9, 13, 20, 40])))) for i in range(30)] + [(30, None), (31, ""), (32, "Ünï çödé wörds hére now"), (33, "Ünï çödé wörds hére now")]
    rows = []
    for d in range(150):
        w = rng.choices(WORDS, k=rng.randint(0, 60))
        own = words(rng.choice(items)[1])
        if own and d % 2:
            a = rng.randint(0, max(0, len(own) - 14))
            own = own[a : a + rng.randint(5, 20)]
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            w += own + rng.choices(WORDS, k=rng.randint(0, 10))
        rows.append((d, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "x ÜNÏ, çödé... wörds hére now!"), (502, "x ÜNÏ, çödé... wörds hére now!"), (None, items[5][1])]
    d = docs(rows, benchmark=(items, SCHEMA))
    want = brute(rows, items)
    got = o.op3_decontaminate(spark, d).collect()
    assert {(str(r.doc_id), r.item_id) for r in got} == want and len(want) > 20
    assert sum(r.doc_id == 502 for r in got) == 4
    df, b = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    o.BLOCK_WORDS, was = 50, o.BLOCK_WORDS
    try:
        assert {(str(r.doc_id), r.item_id) for r in o.overlaps(df, b).collect()} == want
        kept = o.decontaminate(df, b)
        assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if str(i) not in {x for x, _ in want})
    finally:
        o.BLOCK_WORDS = was


def test_short_items_long_texts_and_other_ids(spark, docs):
    common = " ".join(["the same line again"] * 30)
    rows = [(1, "x alpha beta gamma y"), (2, "alpha beta y gamma"), (3, " ".join(rng.choices(WORDS, k=200_000)) + " one two three four five six"), (4, common), (5, None)]
    items = [(1.5, "Alpha, beta gamma!"), (2.5, "one two three four five six"), *[(10.0 + i, common) for i in range(40)], (None, "alpha beta gamma")]
    d = docs(rows, benchmark=(items, "item_id double, text string"))
    got = {(r.doc_id, r.item_id) for r in o.op3_decontaminate(spark, d).collect()}
    assert got == {(1, 1.5), (1, None), (3, 2.5), *((4, 10.0 + i) for i in range(40))}


def test_words_made_to_collide(spark, docs):
    turns = [bin(i).count("1") & 1 for i in range(2048)]
    one, two = ("".join("ab"[t ^ s] for t in turns) for s in (0, 1))
    rest = "b c d e f"
    d = docs([(1, f"{two} {rest}"), (2, f"{one} {rest}")], benchmark=([(1, f"{one} {rest}")], SCHEMA))
    assert [r.doc_id for r in o.op3_decontaminate(spark, d).collect()] == [2]


def test_empty(spark, docs):
    for rows, items in (([], [(1, "a b c d e f")]), ([(1, "a b c d e f")], [])):
        d = docs(rows, benchmark=(items, SCHEMA))
        assert o.op3_decontaminate(spark, d).count() == 0
        df = spark.read.parquet(f"{d}/documents.parquet")
        assert o.decontaminate(df, spark.read.parquet(f"{d}/benchmark.parquet")).count() == len(rows)
