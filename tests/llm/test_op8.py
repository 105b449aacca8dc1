import random
from collections import defaultdict
from fractions import Fraction

import pytest

from tidemark.llm import bpe
from tidemark.llm.op8_tokens import count_sections, op8_tokens

rng = random.Random(4)


def brute(text, rule):
    """From the library's offsets; every token is asked which sections' characters it holds, in bytes."""
    text = text or ""
    spans, at = [], 0
    for line in text.splitlines(keepends=True) if False else [x + "\n" for x in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if text.split("\n")[-1] else []):
        spans.append((at, at + len(line)))
        at += len(line)
    spans = spans or [(0, 0)]
    width = bpe.token_bytes(bpe.public_vocabulary())
    size = lambda a, b: len(text[a:b].encode())
    edges = [(size(0, a), size(0, b)) for a, b in spans]
    tokens, crossing, at = defaultdict(Fraction), defaultdict(int), 0
    for t in bpe.reference(bpe.public_vocabulary()).encode(text, add_special_tokens=False).ids:
        a, b = at, at + int(width[t])
        at = b
        part = {i: min(b, y) - max(a, x) for i, (x, y) in enumerate(edges) if min(b, y) > max(a, x)}
        for i in part if len(part) > 1 else ():
            crossing[i] += 1
        if rule == "start":
            tokens[min(part)] += 1
        elif rule == "majority":
            tokens[min(part, key=lambda i: (-part[i], i))] += 1
        else:
            for i, p in part.items():
                tokens[i] += Fraction(p, b - a)
    return [(i, a, b, round(float(tokens[i]), 9), crossing[i]) for i, (a, b) in enumerate(spans)]


TEXTS = [None, "", "one line", "a\nb\n", "\n\n\nx\n\n\n\ny  \n \n z", "é\n日本\n🎉 ok\n", "def f():\n\n    return 1\n\n\n"] + ["".join(rng.choices("ab é\n\n .日", k=rng.randint(1, 400))) for _ in range(40)]


@pytest.mark.parametrize("rule", ["start", "majority", "share"])
def test_against_offsets(spark, docs, rule):
    rows = list(enumerate(TEXTS)) + [(0, "again\nagain"), (0, "again\nagain"), (None, "no id\n")]
    df = spark.read.parquet(docs(rows) + "/documents.parquet")
    got = sorted((str(r.doc_id), r.section, r.char_start, r.char_end, round(r.n_tokens, 9), r.n_crossing) for r in count_sections(df, rule=rule).collect())
    assert got == sorted((str(i), *x) for i, t in rows for x in brute(t, rule))


def test_empty_and_rule(spark, docs):
    d = docs([])
    assert op8_tokens(spark, d).count() == 0
    with pytest.raises(ValueError, match="rule"):
        count_sections(spark.read.parquet(f"{d}/documents.parquet"), rule="other")
