import random
from collections import defaultdict

import numpy as np
import xxhash

from tidemark.llm.op2_simhash import covering, fingerprint, forest, link, op2_simhash

rng = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(rows):
    fps = [brute_fp(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((d, format(fps[i], "016x"), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows) if d is not None)


def test_covering_holds_every_guaranteed_match():
    for size in (1, 2, 3, 4, 5):
        from itertools import combinations

        sets = covering(size, 5)
        assert all(any(set(s) <= set(w) for s in sets) for w in combinations(range(8), 5))


def test_against_brute_force(spark, docs):
    base = [" ".join(rng.choices(WORDS, k=rng.choice([5, 30, 200, 600]))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for t in base[:15]:
        for _ in range(4):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            rows.append((len(rows), " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "One"), (1005, "one two"), (1005, "one two"), (1006, "É é\x0b\x85x"), (900, base[0]), (901, base[0].upper())]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in op2_simhash(spark, docs(rows)).collect())
    assert got == brute_classes(rows)


def test_null_ids_and_empty(spark, docs):
    got = op2_simhash(spark, docs([(None, "a b c"), (7, "a b c"), (None, "zz yy xx ww vv")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("7", "7"), ("None", "7"), ("None", "None")]
    assert op2_simhash(spark, docs([])).count() == 0


def test_links_of_a_dense_group_and_small_tiles(spark):
    nrng = np.random.default_rng(1)
    centres = nrng.integers(0, 2**63, 12, dtype=np.int64)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(60):
            x = int(c)
            for b in nrng.choice(63, nrng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    for width, tile in ((3, 8), (3, 4096), (4, 16)):
        pairs = [(r.a, r.b) for r in link(df, width=width, tile=tile).collect()]
        assert classes_of(fps, pairs) == classes_of(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3])


def classes_of(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_forest_and_long_text():
    assert forest(np.array([1, 3, 0xFF00], np.uint64), 3) == [(0, 1)]
    text = " ".join(rng.choices(WORDS, k=40000))
    assert fingerprint(text.encode()) == brute_fp(text)


def test_components_of_links_that_come_out_differently_each_time(spark):
    """A rerun may give another forest of the same groups; directions must still belong together."""
    from tidemark.llm.graph import components

    g = spark.range(40).selectExpr("id AS n").repartition(4)

    def star(batches):
        import random

        import pyarrow as pa

        for b in batches:
            ids = b.column(0).to_pylist()
            random.shuffle(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids[:1] * len(ids)), pa.array(ids)], names=["a", "b"])

    links = g.coalesce(1).mapInArrow(star, "a bigint, b bigint")
    got = components(links).collect()
    assert len(got) == 40 and len({r.root for r in got}) == 1


def test_components_of_chains_rings_and_nothing(spark):
    from tidemark.llm.graph import components

    pairs = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000 + (i + 1) % 50) for i in range(50)] + [(-5, -5), (2000, 2001), (2001, 2000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert set(got) == {*range(201), *range(1000, 1050), 2000, 2001}
    assert [len({got[x] for x in xs}) for xs in (range(201), range(1000, 1050), (2000, 2001))] == [1, 1, 1] and len(set(got.values())) == 3
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
