import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import op9_substrings as op9
from tidemark.llm.op9_substrings import ORACLE, op9_substrings, remove_repeats, subtree

rng = random.Random(11)


def brute(rows, window):
    own = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in own for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, own, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows(vocabulary, n):
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [rng.choices(words, k=rng.choice([34, 35, 36, 50, 120])) for _ in range(12)]
    out = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, 10)
            w += rng.choices(words, k=rng.randint(0, 40)) + p[a:]
        out.append((i, " ".join(w)))
    return out


def told(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


CASES = [(900, None), (901, ""), (902, "x " * 34), (903, "y " * 36), (904, "a b c " * 40), (905, "é z " * 35), (906, "é z " * 35), (None, "q " + "r s t u v " * 30), (907, "same " + " ".join(map(str, range(80)))), (907, "same " + " ".join(map(str, range(80)))), (908, " ".join(map(str, range(60000)))), (909, "end " + " ".join(map(str, range(30000, 30040))))]


@pytest.mark.parametrize("vocabulary", [3, 500])
def test_against_brute_force(spark, docs, vocabulary):
    data = rows(vocabulary, 120) + CASES
    d = docs(data)
    assert told(op9_substrings(spark, d)) == brute(data, 35)
    df = spark.read.parquet(f"{d}/documents.parquet")
    for group, held in ((16384, 1 << 25), (2, 3000), (0, 1 << 25), (16384, 100)):
        assert told(remove_repeats(df, window=12, gram=4, group=group, held=held)) == brute(data, 12)
    assert told(remove_repeats(df, window=35, group=3)) == brute(data, 35)


def test_bitmaps_that_are_full(spark, docs, monkeypatch):
    data = rows(40, 60) + CASES
    df = spark.read.parquet(f"{docs(data)}/documents.parquet")
    monkeypatch.setattr(op9, "REPEATED_BITS", 6)
    monkeypatch.setattr(op9, "LENGTHENED_BITS", 7)
    assert told(remove_repeats(df, window=12, gram=4, group=4)) == brute(data, 12)


def test_words_made_to_collide(spark, docs):
    """Words, and windows of words, whose sums with powers modulo 2**64 are equal."""
    turns = [bin(i).count("1") & 1 for i in range(2048)]
    one, two = ("".join("ab"[t ^ s] for t in turns) for s in (0, 1))
    rest = " ".join(f"w{i}" for i in range(34))
    data = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, " ".join("xy"[t] for t in turns)), (4, " ".join("yx"[t] for t in turns))]
    got = told(op9_substrings(spark, docs(data)))
    assert got == brute(data, 35) and [r[2] for r in got[:2]] == [0, 0]


def test_subtree_against_counts():
    for depth in (1, 2, 3, 8, 12, 35):
        sizes = np.array([rng.choice([0, 1, 5, 40, 90]) for _ in range(30)])
        words = [rng.choice(["a", "b", "longer"]) if rng.random() < 0.97 else f"w{rng.randrange(50)}" for _ in range(int(sizes.sum()))]
        at = np.concatenate(([0], np.cumsum(sizes)))
        held = [tuple(words[i : i + depth]) if i + depth <= z else None for a, z in zip(at[:-1], at[1:], strict=True) for i in range(a, z)]
        seen = Counter(h for h in held if h)
        assert subtree(pa.array(words, pa.large_binary()), sizes, depth).tolist() == [h is not None and seen[h] > 1 for h in held]


def test_the_sql_says_the_same(docs):
    data = rows(3, 30) + [c for c in CASES if c[0] not in (908, 909)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{docs(data)}/documents.parquet/*.parquet'")
    assert sorted((str(r[0]), *r[1:]) for r in con.execute(ORACLE).fetchall()) == brute(data, 35)


def test_text_and_empty(spark, docs):
    df = spark.read.parquet(docs([(1, "a b c d e f"), (2, "x c d e  y")]) + "/documents.parquet")
    got = {r.doc_id: r.kept_text for r in remove_repeats(df, window=3, gram=2, keep_text=True).collect()}
    assert got == {1: "a b f", 2: "x y"}
    assert op9_substrings(spark, docs([])).count() == 0
