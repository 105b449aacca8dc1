"""Token counts of sections, from one encoding of the whole document.

Method. A document is encoded once. Its tokens' character spans and its sections' spans are both sorted, so the interval
join of the two is a merge: each token meets the sections that it overlaps. A section is a line with the line feed that
ends it, so the sections cover the text. A token inside one section counts there. One that crosses a boundary is given
out by a stated rule: `start` (the section of its first character), `majority` (the section with most of its characters,
the earlier on a tie), or `share` (to each section, by its part of the characters).

Tokens are byte-level, and a character may be split over tokens: a token then spans every character that it has a byte of,
and belongs by its first byte for `start`. Lengths for `majority` and `share` are in bytes.

Cases. A null text has one empty section with no tokens, as an empty text has. Repeated rows give repeated rows. An empty
table gives none. Other columns aren't read. Any length of text is encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import bpe
from tidemark.llm.textvec import slices

RULES = ("start", "majority", "share")


def attribute(sizes: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section. sizes: bytes of each token; edges: where sections start and the last ends, in bytes."""
    sections = len(edges) - 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    first = np.searchsorted(edges, starts, side="right") - 1
    last = np.searchsorted(edges, ends - 1, side="right") - 1
    first, last = np.minimum(first, sections - 1), np.minimum(last, sections - 1)
    across = np.flatnonzero(last > first)
    crossing = np.zeros(sections, np.int64)
    tokens = np.bincount(first, minlength=sections).astype(float)
    for t in across:
        over = np.arange(first[t], last[t] + 1)
        part = np.minimum(edges[over + 1], ends[t]) - np.maximum(edges[over], starts[t])
        crossing[over] += 1
        if rule == "majority":
            tokens[first[t]] -= 1
            tokens[over[np.argmax(part)]] += 1
        elif rule == "share":
            tokens[first[t]] -= 1
            tokens[over] += part / sizes[t]
    return tokens, crossing


def count_sections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, rule: str = "start") -> DataFrame:
    """One row per section: doc_id, section, char_start, char_end, n_tokens (double), n_crossing."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = vocabulary or bpe.public_vocabulary()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = bpe.encoder(path), bpe.token_bytes(path)
        for batch in batches:
            for at, data, offs in slices(batch.column(1)):
                n = len(offs) - 1
                texts = [x or "" for x in batch.column(1).slice(at, n).to_pylist()]
                rows, parts = [], [[], [], [], [], []]
                for i, ids in enumerate(encode(texts)):
                    body = data[offs[i] : offs[i + 1]]
                    breaks = np.flatnonzero(body == 10) + 1
                    if len(breaks) and breaks[-1] == len(body):
                        breaks = breaks[:-1]
                    edges = np.concatenate(([0], breaks, [len(body)]))
                    tokens, crossing = attribute(width[np.array(ids, np.int64)], edges, rule)
                    chars = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))[edges]
                    rows.append(np.full(len(tokens), at + i))
                    for part, values in zip(parts, (np.arange(len(tokens), dtype=np.int32), chars[:-1], chars[1:], tokens, crossing), strict=True):
                        part.append(values)
                names = ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"]
                columns = [pa.array(np.concatenate(p)) for p in parts]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), *columns], names=names)

    schema = f"doc_id {kind}, section int, char_start bigint, char_end bigint, n_tokens double, n_crossing bigint"
    return docs.select(doc_id, text).mapInArrow(run, schema)


def op8_tokens(spark, sf_dir: str) -> DataFrame:
    """Token counts of every line of every document; a crossing token counts where it starts."""
    counted = count_sections(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counted.withColumn("n_tokens", counted.n_tokens.cast("bigint"))
