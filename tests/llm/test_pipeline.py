import importlib
import random

import numpy as np
import pytest

from tidemark.llm import near_copies as n

pipeline = pytest.importorskip("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") else None
rng = random.Random(21)
WORDS = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(3000)]


def text(k):
    return " ".join(rng.choices(WORDS, k=k))


def edited(t, edits):
    w = t.split()
    for _ in range(edits):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], [rng.choice(WORDS)], [w[i], rng.choice(WORDS)]])
    return " ".join(w)


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if not a and not b or a and b and len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)), key=lambda k: (rows[k][0] is None, rows[k][0], k))
                parent[y] = x
    return sorted(str(rows[i][0]) for i in range(len(rows)) if find(i) == i)


def test_near_copies_against_brute_force(spark, docs):
    base = [text(rng.choice([12, 60, 200, 500])) for _ in range(60)]
    rows = list(enumerate(base))
    for t in base[:30]:
        for _ in range(5):
            rows.append((len(rows), edited(t, max(1, len(t.split()) // 60))))
    for t in base[30:40]:
        w = t.split()
        rng.shuffle(w)
        rows.append((len(rows), " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, "One two"), (5004, "two one"), (None, base[50]), (5005, base[51]), (5005, base[51]), (5006, text(20000))]
    rng.shuffle(rows)
    d = docs(rows)
    df = spark.read.parquet(f"{d}/documents.parquet")
    want = brute_kept(rows)
    for tile, block in ((4096, 512), (3, 2)):
        got = n.drop_near_copies(df, tile=tile, block=block)
        assert got.columns == df.columns
        assert sorted(str(r.doc_id) for r in got.collect()) == want


def test_near_copies_with_one_block_edited(spark, docs):
    rows = []
    for i in range(120):
        w = text(rng.choice([100, 200, 600])).split()
        size = len(w)
        own, other = shingles(" ".join(w)), text(size).split()
        most = []
        for k in range(1, size // 3):
            at = size // 4
            made = [w[: size - k], w + other[:k], w[:at] + other[:k] + w[at:], w[:at] + other[:k] + w[at + k :]][i % 4]
            got = shingles(" ".join(made))
            if len(own & got) < (0.8, 0.84, 0.88)[i % 3] * len(own | got):
                break
            most = made
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(most))]
    df = spark.read.parquet(docs(rows) + "/documents.parquet")
    for tile, block in ((4096, 512), (3, 2)):
        assert sorted(str(r.doc_id) for r in n.drop_near_copies(df, tile=tile, block=block).collect()) == brute_kept(rows) == sorted(str(2 * i) for i in range(120))


def test_near_copies_whatever_comes_last(spark, docs, monkeypatch):
    head = text(100)
    rows = [(i, head + " " + text(k)) for i, k in enumerate([5, 10, 20, 24, 25, 26, 40, 300] * 5)]
    rows += [(100 + i, t + " " + text(len(t.split()) // 9)) for i, t in rows[:20]]
    df = spark.read.parquet(docs(rows) + "/documents.parquet")
    for often in (2, 8, 1000):
        monkeypatch.setattr(n, "OFTEN", often)
        assert sorted(str(r.doc_id) for r in n.drop_near_copies(df).collect()) == brute_kept(rows)


def test_joined_within_and_empty(spark, docs):
    g = np.random.default_rng(2)
    base = g.integers(0, 2**63, 8, dtype=np.uint64)
    prints = np.stack([*(base ^ np.uint64((1 << k) - 1) for k in range(0, 40, 10)), ~base])
    assert sorted(n.joined_within(prints, 80)) == [(0, 1), (0, 2), (0, 3)]
    assert n.joined_within(prints, 79) == []
    df = spark.read.parquet(docs([]) + "/documents.parquet")
    assert n.drop_near_copies(df).count() == 0


def test_index_of_byte_positions_against_brute_force(spark, monkeypatch):
    g = np.random.default_rng(5)
    prints = []
    for flips in [*range(0, 200, 5)] * 3:
        one = np.unpackbits(g.integers(0, 256, 64, dtype=np.uint8))
        two = one.copy()
        two[g.choice(512, flips, replace=False)] ^= 1
        prints += [np.packbits(x).tobytes() for x in (one, two)]
    # alike at one set of positions only, and nowhere
    one = np.frombuffer(prints[0], np.uint8)
    for far in ([i for i in range(64) if i not in (0, 7, 26)], range(64)):
        two = one.copy()
        two[list(far)] ^= 1
        prints.append(two.tobytes())
    rows = list(dict.fromkeys(prints))
    body = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 64)
    nodes = spark.createDataFrame([(k, bytearray(fp)) for k, fp in enumerate(rows)], "k bigint, fp binary")
    for width in (3, 4):
        want = set()
        for i in range(len(rows)):
            for j in range(i):
                same = body[i] == body[j]
                listed = any(all(same[(at + s) % 64] for s in n.STEPS[:width]) for at in range(64))
                if listed and same.sum() >= 6 and np.bitwise_count(body[i] ^ body[j]).sum(dtype=int) <= 140:
                    want.add((j, i))
        assert len(want) > 40
        monkeypatch.setattr(n, "MANY", len(rows) if width == 3 else 0)
        for tile in (4096, 2):
            assert {tuple(sorted(r)) for r in n._near(nodes, tile).collect()} == want


def test_near_copies_come_by_the_index(spark, docs, monkeypatch):
    """What the index finds is dropped with no list of shingles at all, and what it misses with no index."""
    base = [text(k) for k in (60, 200, 500)] * 5
    base = [(2 * i, text(len(t.split()))) for i, t in enumerate(base)]
    rows = base + [(i + 1, edited(t, 1)) for i, t in base]
    # one line over and over, then another end: far from alike as sets
    rows += [(100 + i, "the same line " * 200 + text(60)) for i in range(4)]
    df = spark.read.parquet(docs(rows) + "/documents.parquet")
    want = brute_kept(rows)
    assert want == sorted(map(str, [i for i, _ in base] + [100, 101, 102, 103]))
    entries, near = n._entries, n._near
    monkeypatch.setattr(n, "_entries", lambda *a: entries(*a).limit(0))
    assert sorted(str(r.doc_id) for r in n.drop_near_copies(df).collect()) == want
    monkeypatch.setattr(n, "_entries", entries)
    monkeypatch.setattr(n, "_near", lambda *a: near(*a).limit(0))
    assert sorted(str(r.doc_id) for r in n.drop_near_copies(df).collect()) == want


def test_texts_joined_already_are_not_joined_again():
    base = np.random.default_rng(3).integers(0, 2**63, (3, 8), dtype=np.uint64)
    prints = np.stack([base[0], base[1], base[0] ^ np.uint64(1), base[1] ^ np.uint64(1), base[2]])
    assert sorted(n.joined_within(prints)) == [(0, 2), (1, 3)]
    assert n.joined_within(prints, known=np.array([7, 7, 7, 7, 7])) == []
    # what is known goes on to others
    assert sorted(n.joined_within(prints, known=np.array([7, 7, 8, 9, 10]))) == [(0, 2), (0, 3)]
    assert n.joined_within(prints, shared=64) == []


def test_near_copies_of_any_split_and_repeated_rows(spark, docs):
    base = [text(rng.choice([30, 80])) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, edited(t, 1)) for i, t in enumerate(base)] + [(7, base[7])] * 3 + [(None, base[8])] * 2 + [(None, text(20))] * 2
    rng.shuffle(rows)
    df = spark.read.parquet(docs(rows) + "/documents.parquet")
    want = brute_kept(rows)
    for parts in (1, 3, 16):
        got = n.drop_near_copies(df.repartition(parts)).collect()
        assert sorted(str(r.doc_id) for r in got) == want


def test_large_groups_of_several_classes(spark, docs):
    """Candidates that chain through texts just under the bound, in groups larger than a block."""
    rows = []
    for _ in range(3):
        t = text(100).split()
        for _ in range(40):
            rows.append((len(rows), " ".join(t)))
            at = rng.randrange(len(t) - 12)
            t[at : at + rng.choice([2, 5, 9])] = text(rng.choice([2, 5, 9])).split()
    df = spark.read.parquet(docs(rows) + "/documents.parquet")
    for block in (4, 9, 25, 512):
        assert sorted(str(r.doc_id) for r in n.drop_near_copies(df, block=block).collect()) == brute_kept(rows)


def test_words_made_to_collide(spark, docs):
    """Words and orders of words whose sums with powers modulo 2**64 are equal."""
    turns = [bin(i).count("1") & 1 for i in range(2048)]
    one, two = ("".join("ab"[t ^ s] for t in turns) for s in (0, 1))
    rows = [(0, " ".join([one] * 12)), (1, " ".join([two] * 12)), (2, one), (3, two)]
    df = spark.read.parquet(docs(rows) + "/documents.parquet")
    assert sorted(r.doc_id for r in n.drop_near_copies(df).collect()) == [0, 1, 2, 3]


def test_stages(spark, docs):
    clean = [(i, text(80), "xx") for i in range(40)]
    item = text(30)
    rows = [*clean, (100, clean[0][1], "xx"), (101, "12345 !!", "xx"), (106, "Это русский текст, его здесь никто не знает, и он уйдёт", None), (102, text(20) + " " + item + " " + text(5), "xx"), (103, text(40) + " token=abcdefgh12 end", "xx"), (104, None, "xx"), (105, clean[1][1] + " more", None)]
    d = docs(rows, benchmark=([(1, item), (2, None)], "item_id bigint, text string"))
    before = spark.read.parquet(f"{d}/documents.parquet")
    left = [{i for i, *_ in rows} - {101, 104, 106}, {i for i, *_ in rows} - {100, 101, 104, 105, 106}, {i for i, *_ in rows} - {100, 101, 102, 104, 105, 106}]
    df = before
    for (name, stage), want in zip(pipeline.STAGES[:3], left, strict=False):
        df = stage(spark, df, d)
        assert df.columns == before.columns, name
        assert {r.doc_id for r in df.collect()} == want, name
        df.write.mode("overwrite").parquet(f"{d}/{name}")
        df = spark.read.parquet(f"{d}/{name}")
    df = pipeline.secrets(spark, df, d)
    got = {r.doc_id: r for r in df.collect()}
    assert df.columns == before.columns and set(got) == left[2] and "[SECRET] end" in got[103].text and got[103].n_chars == len(got[103].text) and got[5].text == clean[5][1]
    out = pipeline.run(spark, d).collect()
    assert {r.doc_id for r in out} == left[2] and max(r.offset + r.length for r in out) <= 2048


def test_stages_of_nothing(spark, docs):
    d = docs([], benchmark=([], "item_id bigint, text string"))
    assert pipeline.run(spark, d).count() == 0
    d = docs([(1, "no language here", None)], benchmark=([], "item_id bigint, text string"))
    assert pipeline.run(spark, d).count() == 1
