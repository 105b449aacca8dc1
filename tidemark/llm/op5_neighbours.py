"""Exact nearest neighbours by inner product: a block matrix join with int8 tiles and error bounds.

Method. Queries and candidates are dealt to blocks by a hash of their id, and each (candidate block, query block) is a tile, made
in a task of its own. Vectors are quantised to int8 with a scale of their own. The int8 product, times the scales, is off by at
most |q'||e| + |f||c'| + |f||e|, where q', c' are the dequantised vectors and f, e what quantising took from them. A candidate
survives if its upper bound reaches the k-th largest lower bound seen for the query. Survivors are scored from the
original vectors in double precision, added from the first component to the last, and kept in a heap of k per query. Tiles'
heaps are merged by the same order, larger score first and then smaller id. Bounds only leave out what can't be among the k, so the result is exact.

Scale. Every tile gets at most a block of each side; a row is sent once per block of the other side. The stated query set
against all rows costs (queries x rows) products however it is done; block sizes set the traffic, rows x queries / block.

Cases. Null ids, and vectors that are null, empty, zero or hold a null or a non-finite component, take no part.
Only vectors of the same length are compared. Every row is a candidate, also those alike in id and vector. Candidates with the query's own id are left out. If
an id that is a query comes with several vectors, the query is the one that sorts first. With fewer candidates than k all are
returned. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 20
EVERY = 20
#: Rows of a candidate block and of a query block.
BLOCK = 16384
QUERY_BLOCK = 8192
#: Rows of the int8 products held at a time.
STEP_Q, STEP_C = 256, 4096


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scales, norms of the dequantised rows, norms of the errors)."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    small = np.rint(x / scale[:, None]).astype(np.int8)
    back = small * scale[:, None]
    return small, scale, np.sqrt((back * back).sum(axis=1)), np.sqrt(((x - back) ** 2).sum(axis=1))


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, score) of each query's k best candidates in a tile."""
    q8, qs, qn, qe = quantise(q)
    c8, cs, cn, ce = quantise(c)
    out = []
    for a in range(0, len(q), STEP_Q):
        part = slice(a, a + STEP_Q)
        heaps: list[list[tuple[float, int]]] = [[] for _ in qid[part]]
        least = np.full(len(heaps), -np.inf)
        for b in range(0, len(c), STEP_C):
            some = slice(b, b + STEP_C)
            # products of int8 add up to less than 2**24 for up to 1,040 components, so float32 holds them exactly; beyond that double does
            wide = np.float32 if q.shape[1] <= 1040 else np.float64
            near = (q8[part].astype(wide) @ c8[some].astype(wide).T).astype(np.float64) * (qs[part, None] * cs[None, some])
            off = qn[part, None] * ce[None, some] + qe[part, None] * (cn[None, some] + ce[None, some])
            off *= 1 + 1e-9
            off += 1e-12 * (qn[part, None] * cn[None, some])
            same = qid[part, None] == cid[None, some]
            low = np.where(same, -np.inf, near - off)
            if low.shape[1] > k:
                bound = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
            else:
                bound = np.full(len(heaps), -np.inf)
            keep = (near + off >= np.maximum(bound, least)[:, None]) & ~same
            for i in np.flatnonzero(keep.any(axis=1)):
                j = np.flatnonzero(keep[i]) + b
                score = np.add.accumulate(c[j] * q[a + i], axis=1)[:, -1]
                heaps[i] = heapq.nsmallest(k, heaps[i] + list(zip((-score).tolist(), cid[j].tolist(), strict=True)))
                if len(heaps[i]) == k:
                    least[i] = -heaps[i][-1][0]
        out += [(int(qid[a + i]), v, -s) for i, heap in enumerate(heaps) for s, v in heap]
    return out


def _rows(table: pa.Table, first_only: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: ids and vectors of the rows that take part. first_only: of each id only the vector that sorts first."""
    column = table.column("v").combine_chunks()
    ids = table.column("vec_id").to_numpy()
    # missing components become not-a-number, which takes a vector out
    values = pc.fill_null(column.values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(starts)
    out = {}
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        x = values[starts[at][:, None] + np.arange(d)]
        good = np.isfinite(x).all(axis=1) & x.any(axis=1)
        own, x = ids[at][good], x[good]
        if first_only:
            order = np.lexsort((*x.T[::-1], own))
            own, x = own[order], x[order]
            first = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
            own, x = own[first], x[first]
        if len(own):
            out[d] = (own.astype(np.int64), x)
    return out


def nearest(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, every: int = EVERY, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row whose id is divisible by `every`."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    asked = F.col("vec_id") % every == 0
    n, m = rows.agg(F.count("*"), F.count_if(asked)).first()
    candidate_blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // query_block))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = rows.withColumn("cb", dealt(candidate_blocks)).withColumn("qb", every_of(query_blocks))
    q = rows.filter(asked).withColumn("qb", dealt(query_blocks)).withColumn("cb", every_of(candidate_blocks))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        candidates, queries = _rows(left, False), _rows(right, True)
        found = [r for d, (qid, qv) in sorted(queries.items()) if d in candidates for r in tile(qid, qv, *candidates[d], k)]
        return pa.table({"query_id": pa.array([r[0] for r in found], pa.int64()), "vec_id": pa.array([r[1] for r in found], pa.int64()), "score": pa.array([r[2] for r in found], pa.float64())})

    partial = c.groupBy("cb", "qb").cogroup(q.groupBy("cb", "qb")).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth id."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""
WITH ok AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
           FROM (SELECT vec_id, min(v) AS v FROM ok WHERE vec_id % {EVERY} = 0 GROUP BY vec_id) q JOIN ok c ON q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
