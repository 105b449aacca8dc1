"""Benchmark decontamination with spaced-seed hashing.

Method. Words are runs of letters and digits in lower case. A seed is a fixed mask over a few words that counts some positions
and ignores others; the words that it counts are hashed. Masks are chosen, by a rule, so that every stretch that may count as
an overlap, with any substitutions that are still allowed, is hit by one of them. Benchmark and document hashes are joined. Around each
hit the document and the item are compared word by word at that alignment: an overlap is a stretch of 13 words of the
item, or the whole item if shorter, of which at least 0.8 are the same in the document (all of them, in items under 8 words). Items of under LEAST words
(three) are phrases of the language rather than passages, so a match with them is no overlap. Items under five words have seeds of all their words.

Scale. The benchmark's hashes go to every task in blocks of at most BLOCK_WORDS words, so what is broadcast is bounded; a larger
benchmark takes one pass over the documents for each block. A bitmap keeps most positions from the lookup. Documents are never shuffled.

Cases. Null and empty texts on either side have no overlaps. Repeated document rows give repeated result rows; items alike
are reported each. An empty table on either side gives no overlaps and removes nothing. All columns of the documents are
kept as they are by `decontaminate`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.textvec import hash_words, joined, lowered, plain_words, slices

STRETCH = 13
SHARE = 0.8
LEAST = 3
WEIGHT = 5
SPAN = 9
#: Words of the benchmark held by every task at a time.
BLOCK_WORDS = 400_000
_BITS = 22


def allowed(n: int) -> int:
    """Substitutions that a stretch of n words may have."""
    return 0 if n < 8 else int(n * (1 - SHARE) + 1e-9)


@lru_cache
def masks() -> tuple[tuple[int, ...], ...]:
    """Offsets that each seed counts: greedily those that hit most of the stretches not yet hit."""
    left = {(n, gone) for n in range(WEIGHT, STRETCH + 1) for gone in combinations(range(n), allowed(n))}
    options = [(0, *inner, s - 1) for s in range(WEIGHT, SPAN + 1) for inner in combinations(range(1, s - 1), WEIGHT - 2)]
    hits = {m: {(n, gone) for n, gone in left if any(not {x + o for o in m} & set(gone) for x in range(n - m[-1]))} for m in options}
    chosen = []
    while left:
        best = max(options, key=lambda m: (len(hits[m] & left), -m[-1]))
        if not hits[best] & left:
            raise ValueError("no mask of this weight and span hits every stretch")
        chosen.append(best)
        left -= hits[best]
    # shorter items are met by all their words
    return (*chosen, *(tuple(range(n)) for n in range(LEAST, WEIGHT)))


def seeds(words: np.ndarray, mask: tuple[int, ...], k: int) -> np.ndarray:
    """The hash of a mask at every start."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, k, np.uint64)
    for o in mask:
        total = joined(total, words[o : o + n])
    return total


def _words(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for _, data, offs in slices(lowered(pa.array(texts, pa.string()))):
        starts, ends, first = plain_words(data, offs)
        hashed = hash_words(data, starts, ends)
        out += [hashed[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


class Index:
    """The seeds of some benchmark items."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        hashes, where, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.used = set()
        for i, w in enumerate(self.words):
            for k, m in enumerate(masks()):
                if len(m) < WEIGHT and len(m) != len(w):
                    continue
                h = seeds(w, m, k)
                self.used.add(k)
                hashes.append(h)
                where.append(np.full(len(h), i))
                at.append(np.arange(len(h)))
        hashes, where, at = map(np.concatenate, (hashes, where, at))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.where, self.at = hashes[order], where[order], at[order]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def overlaps(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start in text, words, words alike) of the best overlap of each text and item. first: where each text's words begin, and the end."""
        spots, entries = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in sorted(self.used):
            h = seeds(words, masks()[k], k)
            own = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
            a = np.searchsorted(self.hashes, h[own])
            n = np.searchsorted(self.hashes, h[own], side="right") - a
            spots.append(np.repeat(own, n))
            entries.append(np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum()))
        spot, entry = np.concatenate(spots), np.concatenate(entries)
        # an alignment is a text, an item and where the item would start; many seeds name the same one
        text = np.searchsorted(first, spot, side="right") - 1
        tried = np.unique(np.stack((text, self.where[entry], spot - self.at[entry]), axis=1), axis=0)
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for t, item, start in tried.tolist():
            got = self._verify(words, int(first[t]), int(first[t + 1]), item, start)
            old = found.get((t, item))
            if got and (not old or (-got[2], got[0]) < (-old[2], old[0])):
                found[(t, item)] = got
        return [(t, i, s - int(first[t]), n, same) for (t, i), (s, n, same) in sorted(found.items())]

    def _verify(self, words: np.ndarray, low: int, high: int, item: int, start: int) -> tuple[int, int, int] | None:
        """(start, words, words alike) of the overlap at an alignment, if there is one."""
        own = self.words[item]
        a, b = max(0, low - start), min(len(own), high - start)
        need = min(STRETCH, len(own))
        if b - a < need:
            return None
        same = np.concatenate(([0], np.cumsum(words[start + a : start + b] == own[a:b])))
        good = np.flatnonzero(same[need:] - same[:-need] >= need - allowed(need))
        if not len(good):
            return None
        x, y = int(good[0]), int(good[-1]) + need
        return start + a + x, y - x, int(same[y] - same[x])


def _indexes(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Index]:
    block, total = [], 0
    for row in benchmark.select(item_id, text).toLocalIterator():
        words = _words([row[1]])
        if words and len(words[0]) >= LEAST:
            block.append((row[0], words[0]))
            total += len(words[0])
        if total >= BLOCK_WORDS:
            yield Index(block)
            block, total = [], 0
    if block:
        yield Index(block)


def _scan(index: Index, column: pa.Array) -> Iterator[tuple[int, object, int, int, int]]:
    for at, data, offs in slices(lowered(column)):
        starts, ends, first = plain_words(data, offs)
        words = hash_words(data, starts, ends)
        for t, i, s, n, same in index.overlaps(words, first):
            yield at + t, index.ids[i], s, n, same


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, doc_start, n_words, n_same): each document and item that overlap, with the best overlap, in words."""
    spark = docs.sparkSession
    kinds = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, doc_start bigint, n_words bigint, n_same bigint"
    item_type = to_arrow_type(benchmark.schema[item_id].dataType)
    out = spark.createDataFrame([], schema)
    for index in _indexes(benchmark, item_id, item_text):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(_scan(held.value, batch.column(1)))
                columns = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], item_type)]
                columns += [pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "doc_start", "n_words", "n_same"])

        out = out.union(docs.select(doc_id, text).mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that overlap no item, with all their columns."""
    place = docs.columns.index(text)
    for index in _indexes(benchmark, item_id, item_text):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in _scan(held.value, batch.column(place))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document that overlaps a benchmark item, with the item and the overlap."""
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
