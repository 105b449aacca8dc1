"""Best-fit packing of tokenised documents into sequences, with several capacities per sequence.

Method. Every sequence has three capacities: tokens, documents, and attention cost (the sum of squared piece lengths).
Pieces are taken longest first. A piece may go into any open sequence whose three residuals all hold it; of those the one
with the best score is chosen: the least weighted norm of the residuals left over, or the largest weighted dot product of
the piece's needs with the residuals. With none, a sequence is opened. Only documents longer than a sequence are cut, and
then the first piece takes the odd tokens, so that all others fill a sequence each.

Scale. Texts are encoded once, in one map stage that keeps ids only if asked to. The pieces are numbered and
written to the shared folder; ids aren't packed with them but joined on again by number. Full pieces are sequences already; the others are dealt evenly by a hash of their place
in that written table to groups of a fixed size, packed in memory. The loss is at most about one part-filled sequence a group.

Cases. A null or empty text is one piece with the end id alone. Repeated rows and null ids are packed like others. An
empty table gives no pieces. Other columns aren't read. A piece that exceeds the attention capacity alone gets its own sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.textvec import checkpointed, slices

SEQUENCE = 2048
#: Documents and squared lengths that a sequence may hold. These two admit whatever the tokens admit.
DOCUMENTS = 2048
ATTENTION = 2048 * 2048
WEIGHTS = (1.0, 0.05, 0.05)
#: Pieces packed together in one task.
GROUP = 16384


def encode_pieces(docs: DataFrame, doc_id: str, text: str, vocabulary: str, sequence: int, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and, if asked for, ids as little-endian unsigned 32-bit numbers, which travel as bytes."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = bpe.encoder(vocabulary)
        for batch in batches:
            for at, _, offs in slices(batch.column(1)):
                n = len(offs) - 1
                texts = [x or "" for x in batch.column(1).slice(at, n).to_pylist()]
                rows, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, ids in enumerate(run(texts)):
                    row = np.array([*ids, end_id], "<u4")
                    cut, k = len(row) % sequence or sequence, 0
                    a, b = 0, min(cut, len(row))
                    while a < len(row):
                        part = row[a:b]
                        rows.append(at + i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(part.tobytes()))
                        if keep_ids:
                            kept.append(part.tobytes())
                        a, b, k = b, b + sequence, k + 1
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(kept, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    return docs.select(doc_id, text).mapInArrow(encode, schema)


def vector_best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float], score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, given longest first."""
    top = np.array(capacity, float)
    scale = np.array(weights, float)
    n = len(lengths)
    left = np.zeros((3, max(n, 1)))
    fill = np.zeros(max(n, 1), np.int64)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.zeros(max(n, 1), np.int64)  # bins that still hold the shortest piece
    open_n = made = 0
    least = lengths.min() if n else 0
    for i in range(n):
        need = np.array((lengths[i], 1, float(lengths[i]) ** 2))
        best = -1
        if open_n:
            some = left[:, :open_n]
            fits = (some[0] >= need[0]) & (some[1] >= need[1]) & (some[2] >= need[2])
            at = np.flatnonzero(fits)
            if len(at):
                if score == "norm":
                    rest = (some[:, at] - need[:, None]) / top[:, None]
                    best = at[np.argmin(scale @ (rest * rest))]
                else:
                    best = at[np.argmax(scale @ ((some[:, at] / top[:, None]) * (need / top)[:, None]))]
        if best < 0:
            best = open_n
            left[:, best], live[best] = top, made
            open_n, made = open_n + 1, made + 1
        b = live[best]
        bins[i], offsets[i] = b, fill[b]
        fill[b] += lengths[i]
        left[:, best] -= need
        if left[0, best] < least or left[1, best] < 1:
            open_n -= 1
            left[:, best], live[best] = left[:, open_n], live[open_n]
    return bins, offsets


def pack(pieces: DataFrame, capacity: tuple[int, int, int] = (SEQUENCE, DOCUMENTS, ATTENTION), weights: tuple[float, float, float] = WEIGHTS, score: str = "norm", group: int = GROUP) -> DataFrame:
    """Pieces with sequence_id and offset. `pieces` has length and may have ids; it is written once to the shared folder."""
    names = pieces.columns
    # numbered before it is written: numbers given on reading would depend on how the table is split then
    held = checkpointed(pieces.withColumn("__tm_row", F.monotonically_increasing_id()))
    small = held.drop("ids")
    own, kinds = small.columns, dict(small.dtypes)
    full = small.filter(F.col("length") >= capacity[0]).withColumns({"sequence_id": -1 - F.col("__tm_row"), "offset": F.lit(0).cast("bigint")})
    rest = small.filter(F.col("length") < capacity[0])
    groups = max(1, -(-rest.count() // group))
    dealt = rest.withColumn("__tm_group", F.pmod(F.xxhash64("__tm_row"), F.lit(groups)))

    def best_fit(table: pa.Table) -> pa.Table:
        lengths, rows = table.column("length").to_numpy(), table.column("__tm_row").to_numpy()
        order = np.lexsort((rows, -lengths))
        bins, offsets = vector_best_fit(lengths[order], capacity, weights, score)
        key = table.column("__tm_group")[0].as_py() << 32
        table = table.take(pa.array(order)).select(own)
        return table.append_column("sequence_id", pa.array(bins + key)).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in own) + ", sequence_id bigint, offset bigint"
    packed = full.unionByName(dealt.groupBy("__tm_group").applyInArrow(best_fit, schema))
    if "ids" in names:
        packed = packed.join(held.select("__tm_row", "ids"), "__tm_row")
    return packed.select(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, keep_ids: bool = False, score: str = "norm") -> DataFrame:
    """One row per piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for."""
    return pack(encode_pieces(docs, doc_id, text, vocabulary or bpe.public_vocabulary(), SEQUENCE, keep_ids=keep_ids), score=score)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its sequence."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
