"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Method. A text's fingerprint has bit i set if over half of its shingle hashes have it, repeats included. Two fingerprints
within d differing bits (d < 8) share at least 8 - d of their 8 bytes at the same positions. The index lists fingerprints under
(positions, bytes) for a family of position sets, chosen so that any 8 - d positions hold one of them whole; so each such pair
meets in a list. There the shared bytes of each pair are tallied, pairs under 8 - d are left, and the rest are
verified bit by bit. Linked pairs become classes by label propagation.

Scale. Only distinct fingerprints are indexed, so copies of a text cost nothing. Lists with one entry are dropped. A list
longer than TILE is dealt to blocks, each pair of blocks a task of its own; within a task nothing but a spanning forest of the
links leaves it, at most one row per entry. Sets of 3 positions make 2**24 lists of each kind; above about 10**9 distinct
fingerprints take width=4, which is as exact.

Cases. A null text has no words, like an empty one, and its fingerprint is zero; texts with fingerprint zero are linked like any
others. With fewer words than a shingle the whole sequence is the one shingle. Null ids get a class like others; a class with
no id but null has null. Repeated rows come out as often as they went in. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.textvec import checkpointed, slices

WORDS = 3
DISTANCE = 3
WIDTH = 3
SEED = 42
#: Index entries compared within a task.
TILE = 4096


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The SimHash of a text's bytes."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        at = np.zeros(len(found) + 1, np.int64)
        np.cumsum([len(w) + 1 for w in found], out=at[1:])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(at[:-words].tolist(), (at[words:] - 1).tolist(), strict=True)]
    n, counts = len(hashes), np.zeros(64, np.int64)
    held = np.array(hashes, "<u8")
    for i in range(0, n, 16384):
        part = held[i : i + 16384]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed number."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, np.uint64)
            for at, data, offs in slices(batch.column(1)):
                body = data.tobytes()
                for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                    found[at + i] = fingerprint(body[a:b], words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, fp bigint")


def covering(size: int, whole: int, of: int = 8) -> list[tuple[int, ...]]:
    """Position sets of a size such that every `whole` of the `of` positions hold one of them; chosen greedily, most covered first."""
    left = set(combinations(range(of), whole))
    sets = {s: {w for w in left if set(s) <= set(w)} for s in combinations(range(of), size)}
    chosen = []
    while left:
        best = max(sets, key=lambda s: (len(sets[s] & left), [-x for x in s]))
        chosen.append(best)
        left -= sets[best]
    return chosen


def forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(root, member) index pairs that join all members linked directly or through others."""
    links, left = [], np.arange(len(values))
    while len(left) > 1:
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            head, frontier = frontier[:256], frontier[256:]
            differ = values[head][:, None] ^ values[left][None, :]
            shared = (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(axis=2)
            i, j = np.nonzero(shared >= 8 - distance)
            near = np.unique(j[np.bitwise_count(differ[i, j]) <= distance])
            links += [(root, m) for m in left[near]]
            frontier = np.concatenate((frontier, left[near]))
            left = np.delete(left, near)
    return links


def link(fps: DataFrame, distance: int = DISTANCE, width: int = WIDTH, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect all fingerprints within a distance of each other. fps: distinct `fp`."""
    if not 0 <= distance < 8 or not 1 <= width <= 8 - distance:
        raise ValueError("distance must be under 8 bits and the index width no more than the bytes that must be shared")
    masks = [sum(0xFF << 8 * p for p in s) for s in covering(width, 8 - distance)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    entries = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("v")) for i, m in enumerate(signed)])).alias("e")).select("fp", "e.i", "e.v")
    sizes = entries.groupBy("i", "v").agg(F.count("*").alias("n")).filter("n > 1")
    listed = entries.join(sizes, ["i", "v"]).withColumn("blocks", F.expr(f"cast(ceil(n / {tile}D) AS int)")).withColumn("block", F.expr("cast(pmod(xxhash64(fp), blocks) AS int)"))
    tiles = listed.select("i", "v", "fp", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    tiles = tiles.select("i", "v", F.expr("least(block, other)").alias("x"), F.expr("greatest(block, other)").alias("y"), "fp")
    keys = ["i", "v", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in _with_end(batches):
            if batch is not None and batch.num_rows:
                held.append(np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)]))
                if len(held) > 1:
                    held = [np.concatenate(held, axis=1)]
            if not held:
                continue
            rows = held[0]
            change = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0)) + 1
            edges = [0, *change.tolist()] + ([rows.shape[1]] if batch is None else [])
            roots, members = [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                fp = rows[4, a:b]
                for r, m in forest(fp.view(np.uint64), distance):
                    roots.append(fp[r])
                    members.append(fp[m])
            held = [rows[:, edges[-1] :].copy()] if batch is not None else []
            if roots:
                yield pa.RecordBatch.from_arrays([pa.array(roots, pa.int64()), pa.array(members, pa.int64())], names=["a", "b"])

    return tiles.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, "a bigint, b bigint")


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp, component_id): one row per document; component_id is the least doc_id reachable by links."""
    held = checkpointed(fingerprints(docs, doc_id, text, words))
    distinct = checkpointed(held.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(link(distinct.select("fp"), distance, width))
    linked = roots.join(distinct, roots.node == distinct.fp).select("fp", "root", "least")
    across = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    known = linked.join(across, "root").select("fp", "component_id")
    # written out, so that the last join deals both sides anew and a fingerprint that many texts share can be split
    ids = checkpointed(distinct.join(known, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return held.join(ids, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and its class."""
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
