import random
from itertools import product

import numpy as np

from tidemark.llm import op1_language as o

rng = random.Random(6)
SOUNDS = {"aa": ["ka", "ro", "mi", "ta"], "bb": ["sch", "ein", "ung", "ber"], "cc": ["éa", "oi", "que", "ez"]}


def text(lang, n):
    w = ["".join(rng.choices(SOUNDS[lang], k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(x + "." if i % 9 == 8 else x for i, x in enumerate(w))


def test_forward_backward_against_every_path():
    g = np.random.default_rng(0)
    scores, move, start = g.normal(size=(9, 3)), g.normal(size=(3, 3)), g.normal(size=3)
    chain = np.array([0, 4, 5, 9])
    post, moved, begun = o.forward_backward(scores, chain, move, start)
    want, want_move, want_start = np.zeros((9, 3)), np.zeros((3, 3)), np.zeros(3)
    for a, b in zip(chain[:-1], chain[1:]):
        paths = list(product(range(3), repeat=b - a))
        weight = np.exp([start[p[0]] + sum(scores[a + i, k] for i, k in enumerate(p)) + sum(move[x, y] for x, y in zip(p, p[1:])) for p in paths])
        for p, v in zip(paths, weight / weight.sum(), strict=True):
            want_start[p[0]] += v
            for i, k in enumerate(p):
                want[a + i, k] += v
            for x, y in zip(p, p[1:]):
                want_move[x, y] += v
    assert np.allclose(post, want) and np.allclose(moved, want_move) and np.allclose(begun, want_start)


def test_held_out_accuracy_and_cases(spark, docs):
    rows = [(i, text(lang, rng.randint(3, 80)), lang) for i in range(300) for lang in [rng.choice(list(SOUNDS))]]
    extra = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !? 🎉", "bb"), (1003, "KA RO mi", None), (1004, text("bb", 3000), None), (1004, text("bb", 3000), None), (None, text("cc", 20), "cc"), (1005, "日本", "aa")]
    got = o.op1_language(spark, docs(rows + extra)).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[1000] == by[1001] == by[1002] == ("und", 0.0)
    assert by[1003][0] == "aa" and by[1004][0] == "bb" and by[None][0] == "cc" and by[1005][0] != "und"


def test_words_of_a_switched_sentence():
    model = o.fit([(text(lang, 60), lang) for _ in range(40) for lang in SOUNDS])
    first, second = text("aa", 8).replace(".", ""), text("bb", 8).replace(".", "")
    body = f"{first} {second}".encode()
    post = model.posteriors(o.read_words(np.frombuffer(body, np.uint8), np.array([0, len(body)])))
    assert (post.argmax(axis=1) == [0] * 8 + [1] * 8).mean() >= 0.9
    assert (np.diag(model.move) > model.move.mean(axis=1)).all()


def test_spans_of_switched_texts(spark, docs):
    rows = [(i, text(lang, 60), lang) for i in range(60) for lang in SOUNDS]
    df = spark.read.parquet(docs(rows) + "/documents.parquet")
    model = o.train(df, "doc_id", "text", "lang")
    parts = [(lang, text(lang, 30).replace(".", "")) for lang in ("aa", "cc", "bb")]
    mixed = "  ".join(t for _, t in parts)
    asked = spark.createDataFrame([(1, mixed), (2, "¡É " + parts[1][1].upper()), (3, None), (4, ""), (5, "12 !"), (6, "x" + " ka" * 3000)], "doc_id int, text string")
    got = {r.doc_id: r for r in o.predict(asked, model, coverage_out="covered", spans_out="spans").collect()}
    found = {z.language for z in got[1].spans}
    assert found == {"aa", "bb", "cc"}
    right = sum(min(z.end, at + len(t)) - max(z.start, at) for (lang, t), at in zip(parts, (0, len(parts[0][1]) + 2, len(parts[0][1]) + len(parts[1][1]) + 4), strict=True) for z in got[1].spans if z.language == lang and z.end > at and z.start < at + len(t))
    assert right >= 0.9 * len(mixed)
    for i, t in ((1, mixed), (2, "¡É " + parts[1][1].upper()), (6, "x" + " ka" * 3000)):
        ends = [0]
        for z in got[i].spans:
            assert ends[-1] <= z.start < z.end <= len(t) and not t[z.start].isspace() and not t[z.end - 1].isspace() and 0 < z.posterior <= 1
            ends.append(z.end)
        assert got[i].covered > 0.6
    assert [got[i].spans for i in (3, 4, 5)] == [[], [], []] and [got[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3


def test_coverage_tells_foreign_text(spark, docs):
    rows = [(i, text(lang, 60), lang) for i in range(60) for lang in SOUNDS]
    df = spark.read.parquet(docs(rows) + "/documents.parquet")
    model = o.train(df, "doc_id", "text", "lang")
    noise = " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(40))
    asked = [("clean", text(lang, 40)) for lang in SOUNDS for _ in range(20)] + [("foreign", "これは日本語の文章です " * 5), ("foreign", "Это русский текст, его здесь никто не знает"), ("foreign", noise)]
    got = o.predict(spark.createDataFrame(asked, "kind string, text string"), model, coverage_out="covered").collect()
    assert all((r.covered >= o.LEAST_COVERAGE) == (r.kind == "clean") for r in got)


def test_nothing_to_learn_from(spark, docs):
    got = o.op1_language(spark, docs([(1, "words here", None), (2, None, None)])).collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in got} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert o.op1_language(spark, docs([])).count() == 0


def test_every_language_is_learned(spark, docs):
    words = {f"l{k:02d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for k in range(70)}
    rows = [(len(words) * j + i, " ".join(rng.choices(own, k=20)), lang) for j in range(8) for i, (lang, own) in enumerate(words.items())]
    df = spark.read.parquet(docs(rows) + "/documents.parquet")
    model = o.train(df, "doc_id", "text", "lang")
    assert model.languages == sorted(words)
    got = o.predict(df.select("text", "lang"), model).collect()
    assert {r.lang_pred for r in got} == set(words) and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
