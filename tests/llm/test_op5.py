import math

import numpy as np

from tidemark.llm.op5_neighbours import nearest, op5_neighbours

rng = np.random.default_rng(2)


def brute(rows, k, every):
    ok = []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        ok.append((i, np.array(v, np.float32).astype(float)))
    out, asked = [], {}
    for i, v in sorted(ok, key=lambda r: (r[0], tuple(r[1]))):
        if i % every == 0:
            asked.setdefault((i, len(v)), v)
    for (i, d), v in asked.items():
        found = sorted((-float(np.add.accumulate(w * v)[-1]), j) for j, w in ok if j != i and len(w) == d)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def test_against_brute_force(spark, write):
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(60)]
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] + [1.0] * 15), (504, [None] + [1.0] * 15), (505, [float("inf")] * 16), (None, [1.0] * 16)]
    rows += [(540, [1.0, 2.0]), (541, [3.0, -1.0]), (20, rows[20][1]), (-20, rng.normal(size=16).astype(np.float32).tolist()), (600, [1e-30] * 16), (601, [1e30] * 16)]
    d = write(embeddings=([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, label int, rank string"))
    want = brute(rows, 20, 20)
    assert sorted(map(tuple, op5_neighbours(spark, d).collect())) == want
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    assert sorted(map(tuple, nearest(e, block=64, query_block=7).collect())) == want


def test_empty_and_few(spark, write):
    schema = "vec_id bigint, embedding array<float>"
    assert op5_neighbours(spark, write(embeddings=([], schema))).count() == 0
    got = op5_neighbours(spark, write(embeddings=([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [2.0, 0.0])], schema))).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 20, 2.0), (0, 2, 1, 0.5), (20, 1, 0, 2.0), (20, 2, 1, 1.0)]
