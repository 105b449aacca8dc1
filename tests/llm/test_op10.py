import random

import numpy as np
import pyarrow as pa

from tidemark.llm import op10_toxicity as o

rng = random.Random(13)
WORDS = [f"w{i}x" for i in range(800)]
BAD = ["vile", "foul", "grim", "nasty", "awful"]
LABELS = "doc_id bigint, quality int, toxic int"


def make(n):
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        w = rng.choices(WORDS, k=rng.randint(20, 300))
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_quality_and_cases(spark, docs):
    rows, labels = make(900)
    truth = {i: y for i, _, y in labels}
    cases = [(5000, None), (5001, ""), (5002, "VILE!!! foul"), (5003, " ".join(rng.choices(WORDS, k=20000)) + " nasty"), (5004, " ".join(rng.choices(WORDS, k=20000))), (5004, "again"), (None, "plain w1x w2x")]
    d = docs(rows + cases, labels=(labels + [(0, 1, None), (None, 0, 1), (7, 0, 1 - truth[7]), (99999, 1, 1)], LABELS))
    got = o.op10_toxicity(spark, d).collect()
    assert len(got) == len(rows) + len(cases) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 7]
    assert len(held) > 120
    hit = sum(r.predicted and truth[r.doc_id] for r in held)
    assert hit >= 0.95 * sum(truth[r.doc_id] for r in held) and hit >= 0.9 * sum(r.predicted for r in held)
    by = {r.doc_id: r.predicted for r in got}
    assert (by[5000], by[5001], by[5002], by[5003], by[None]) == (0, 0, 1, 1, 0)


def test_label_model_finds_accuracies_and_ties():
    g = np.random.default_rng(3)
    y = (g.random(4000) < 0.3).astype(int)
    good = np.where(g.random((4000, 3)) < 0.9, y[:, None], 1 - y[:, None])
    copies = np.repeat(np.where(g.random((4000, 1)) < 0.6, y[:, None], 1 - y[:, None]), 5, axis=1)
    votes = np.concatenate((good, copies), axis=1).astype(float)
    given = np.where(g.random(4000) < 0.85, y, 1 - y)  # labels are wrong as well
    q, rate, block = o.label_model(votes, given, np.ones(4000))
    assert len(set(block[:3].tolist())) == 3 and len(set(block[3:].tolist())) == 1 and block[3] not in block[:3]
    assert np.abs(np.diag(rate) - 0.85).max() < 0.04
    assert ((q > 0.5) == y).mean() > 0.95 > (given == y).mean()
    # five copies of one voter count as one
    alone = o.label_model(np.concatenate((good, copies[:, :1]), axis=1).astype(float), given, np.ones(4000))[0]
    assert np.abs(alone - q).mean() < 0.02


def test_words_at_the_end_of_long_texts_are_learned(spark, docs):
    rows, labels = [], []
    for i in range(200):
        toxic = i % 4 == 0
        rows.append((i, " ".join([*rng.choices(WORDS, k=6000), *(f"u{i}q{j}" for j in range(30))]) + (f" {rng.choice(BAD)} {rng.choice(BAD)}" if toxic else "")))
        labels.append((i, 1, int(toxic)))
    got = o.op10_toxicity(spark, docs(rows, labels=(labels, LABELS))).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 30 and not any(r.predicted for r in held if r.doc_id % 4)
    toxic = [r.predicted for r in held if r.doc_id % 4 == 0]
    assert sum(toxic) >= 0.8 * len(toxic) > 5


def test_passage_copies_make_no_voter():
    copy = " ".join(rng.choices(WORDS, k=60)) + " vile marker"
    rows, labels = make(300)
    texts = [t for _, t in rows] + [copy] * 60
    model = o.fit(texts, [y for *_, y in labels] + [1] * 60)
    word = next(w for _, w in o.read_words(pa.array(["marker"]))).key[0]
    assert word not in model.lexicon


def test_no_labels_one_label_and_empty(spark, docs):
    rows = [(i, f"some text {i}") for i in range(20)]
    assert {r.score for r in o.op10_toxicity(spark, docs(rows, labels=([], LABELS))).collect()} == {0.0}
    one = o.op10_toxicity(spark, docs(rows, labels=([(i, 1, 0) for i in range(20)], LABELS))).collect()
    assert all(r.score < 0.3 for r in one)
    assert o.op10_toxicity(spark, docs([], labels=([(1, 1, 1)], LABELS))).count() == 0
