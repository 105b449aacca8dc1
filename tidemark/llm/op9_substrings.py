"""Removal of passages that repeat: prefix-partitioned suffix trees over words.

Method. A window of WINDOW words repeats if the suffixes that start at two places are leaves below one internal node of that depth or more
in the suffix tree of all texts. The tree is made in parts, each in memory, from the words themselves:

1. Suffixes are split by prefixes. A window holds WINDOW - GRAM + 1 suffixes long enough to have a prefix of GRAM words inside it, and is filed under the
   prefix with the least hash, its anchor. Equal windows have equal anchors and neighbours mostly share theirs, so a stretch of
   windows with one anchor travels as one run of words. Prefixes are counted first; those that occur once lead to no internal node, and their
   stretches stay where they are.
2. A prefix that more than GROUP stretches hold is lengthened to the whole window, and its windows travel one by one. So a group is of at most about GROUP
   stretches, or of windows that are all alike.
3. In each group the subtree is built from the top down, level by level: suffixes that share a node are split by the words that follow, with the
   ranks of twice as many words each time, and those alone under a node are leaves and looked at no more. What is left at
   depth WINDOW lies below internal nodes. Runs of neighbouring windows that repeat are the maximal repeats, whose words go.

Hashes only choose where words are compared: words are told apart by their bytes, and nothing is removed that hasn't been compared.

Scale. Which prefixes repeat, and which are lengthened, is sent to the tasks as two bitmaps of fixed size. With more prefixes than they can tell apart,
some stretches travel that needn't, or as single windows; all tasks see the same bitmaps, so equal windows always meet. A task first brings together
what it has read itself: of stretches alike, one is sent, marked as known to repeat, and the others are settled. So no group holds a
window more often than there are tasks (or portions of HELD bytes). Texts are shuffled once, and only those that may have lost something, to a join whose sides
are both read from tables, so that a text with very many copies is split over tasks.

Cases. Null, empty and shorter texts lose nothing; a null text has no words and the hash of the empty text. Copies of a text, repeated rows
among them, are repeats of each other. Texts are known by two hashes of 64 bits. Null ids come out like others. An empty table gives no rows. Other columns aren't
read. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textvec import checkpointed, hash_windows, hash_words, mix, release, screened, slices, sliding_min, split_words

WINDOW = 35
GRAM = 8
#: Stretches under one prefix that a group may hold.
GROUP = 16384
#: Windows of a stretch.
STRETCH = 512
#: Bytes of words, or prefixes, that a task holds before it sends them on.
HELD = 1 << 25
#: Bits of the maps of prefixes that repeat and of prefixes that are lengthened.
REPEATED_BITS, LENGTHENED_BITS = 26, 22
ALONE, KNOWN, TOLD = 0, 1, 2  # not seen twice yet; seen twice, sent for others to meet; seen twice, sent to its text only


def anchors(data: np.ndarray, offs: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(word hashes, first word of each text, window starts, anchor of each window, whether it is there twice in its window)."""
    starts, ends, first = split_words(data, offs)
    words = hash_words(data, starts, ends)
    span = window - gram + 1
    # the lowest bits hold the place modulo a power of two over the span: once counted up and once down, so that equal hashes show
    low = np.uint64((1 << span.bit_length()) - 1)
    hashed = hash_windows(words, gram) & ~low
    place = np.arange(len(hashed), dtype=np.uint64) & low
    least, other = sliding_min(hashed | place, span), sliding_min(hashed | (low - place), span)
    stop = np.repeat(first[1:], np.diff(first))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + window <= stop)
    least, other = least[at], other[at]
    return words, first, at, mix(least & ~low), (least & low) != low - (other & low)


def _stretches(first: np.ndarray, starts: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows) of the longest runs of windows with one anchor; windows are given by index."""
    text = np.searchsorted(first, starts, side="right") - 1
    new = np.concatenate(([True], (m[1:] != m[:-1]) | (text[1:] != text[:-1]) | (starts[1:] != starts[:-1] + 1)))
    begin = np.flatnonzero(new)
    return text[begin], begin, np.diff(np.concatenate((begin, [len(m)])))


def count_prefixes(texts: DataFrame, window: int, gram: int, held: int = HELD) -> DataFrame:
    """(m, n): stretches under each anchor; one that comes back within a stretch counts twice at least. texts: (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if kept:
                m, n = map(np.concatenate, zip(*kept, strict=True))
                kept.clear()
                own, at = np.unique(m, return_inverse=True)
                total = np.zeros(len(own), np.int64)
                np.add.at(total, at, n)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(total)], names=["m", "n"])

        size = 0
        for batch in batches:
            for _, data, offs in slices(batch.column(0)):
                _, first, starts, m, tied = anchors(data, offs, window, gram)
                if not len(m):
                    continue
                _, begin, length = _stretches(first, starts, m)
                # a prefix that is twice in a window, or spans more windows than one sequence can, is there twice
                sure = (length > window - gram + 1) | np.maximum.reduceat(tied, begin)
                kept.append((m[begin], np.maximum(-(-length // STRETCH), np.where(sure, 2, 1))))
                size += 16 * len(begin)
                if size >= held:
                    size = 0
                    yield from flush()
        yield from flush()

    return texts.select("text").mapInArrow(run, "m bigint, n bigint").groupBy("m").agg(F.sum("n").alias("n"))


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A map of the highest bits of 64-bit keys, of a size that doesn't depend on them."""
    bit = F.shiftrightunsigned("m", 64 - bits)
    words = keys.select(bit.alias("b")).groupBy(F.expr("b div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 AS int))")).alias("held")).toArrow()
    out = np.zeros((1 << bits) // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("held").to_numpy()
    return out.view(np.uint64)


def _in(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys >> np.uint64(64 - (len(bitmap) * 64).bit_length() + 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def subtree(words: pa.Array, sizes: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes with `depth` words or more lie below internal nodes of that depth, as a mask over all words.

    words: the words of some stretches, one stretch after another; sizes: the words of each. Ranks name the nodes of a level. A
    suffix alone under its node keeps that name, which no other has, so whatever it is part of is alone as well.
    """
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    n = len(ids)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # words to the end of the stretch
    rank, next_name, level = ids, int(ids.max(initial=0)) + 1, 1
    if depth == 1:
        return np.bincount(ids)[ids] > 1
    live = np.flatnonzero(np.bincount(rank, minlength=next_name)[rank] > 1)
    while level < depth and len(live):
        step = min(level, depth - level)
        live = live[room[live] >= level + step]
        key = rank[live] * next_name + rank[live + step]
        own, at, count = np.unique(key, return_inverse=True, return_counts=True)
        rank = rank.copy()
        rank[live] = next_name + at
        next_name += len(own)
        live = live[count[at] > 1]
        level += step
    out = np.zeros(n, bool)
    out[live] = True
    return out


def _settled(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(k, k2, runs) of stretches that repeat, of sorted (route, state, k, k2, start, n, words). A run is its first window and how many."""
    held: list[pa.Table] = []

    def judge(table: pa.Table) -> pa.RecordBatch:
        state, start, n = (table.column(c).to_numpy() for c in ("state", "start", "n"))
        row, at, length = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        sure = np.flatnonzero(state != ALONE)
        row.append(sure)
        at.append(start[sure])
        length.append(n[sure])
        sent = np.flatnonzero(state != TOLD)
        if len(sent):
            column = table.column("words").take(pa.array(sent)).combine_chunks()
            column = column.cast(pa.large_binary())
            body = b" ".join(column.to_pylist()) + b" "
            data = np.frombuffer(body, np.uint8)
            starts, _, _ = split_words(data, np.array([0, len(data)]))
            edges = np.concatenate((starts, [len(data)])).astype(np.int64)
            # each word with the blank after it
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(body)])
            sizes = n[sent] + window - 1
            below = subtree(words, sizes, window)
            owner, place = np.repeat(np.arange(len(sent)), sizes), np.arange(len(starts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            hit = np.flatnonzero(below & (state[sent] == ALONE)[owner])
            if len(hit):
                new = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])))
                begin = np.flatnonzero(new)
                row.append(sent[owner[hit[begin]]])
                at.append((start[sent][owner] + place)[hit[begin]])
                length.append(np.diff(np.concatenate((begin, [len(hit)]))))
        row, at, length = map(np.concatenate, (row, at, length))
        runs = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * 2), pa.array(np.stack((at, length), axis=1).ravel().astype(np.int32)))
        keys = [table.column(c).combine_chunks().take(pa.array(row)) for c in ("k", "k2")]
        return pa.RecordBatch.from_arrays([*keys, runs], names=["k", "k2", "runs"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        route = table.column("route").to_numpy()
        cut = int(np.searchsorted(route, route[-1]))
        if cut or (held and held[0].column("route")[0].as_py() != route[0]):
            yield judge(pa.concat_tables([*held, table.slice(0, cut)]))
            held = []
        held.append(table.slice(cut))
    if held:
        yield judge(pa.concat_tables(held))


def repeated_windows(texts: DataFrame, repeated: np.ndarray, lengthened: np.ndarray, window: int, gram: int, held: int = HELD) -> DataFrame:
    """(k, k2, runs): where windows that repeat are in each text. texts: (k, k2, text)."""
    maps = texts.sparkSession.sparkContext.broadcast((repeated, lengthened))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []  # route, state, k, k2, start, n, words
        seen: dict[bytes, int] = {}
        place: dict[tuple[int, int], list[int]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                columns = list(zip(*rows, strict=True))
                types = (pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
            rows.clear()
            seen.clear()
            place.clear()

        def add(own: tuple[int, int], route: int, start: int, n: int, body: bytes) -> int:
            before = seen.get(body)
            if before is not None:
                rows[before][1] = KNOWN
                rows.append([route, TOLD, *own, start, n, None])
                return 40
            seen[body] = len(rows)
            place[own].append(len(rows))
            rows.append([route, ALONE, *own, start, n, body])
            return 40 + len(body)

        size = 0
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for at, data, offs in slices(batch.column(2)):
                hashed, first, starts, m, _ = anchors(data, offs, window, gram)
                pick = np.flatnonzero(_in(maps.value[0], m))
                if not len(pick):
                    continue
                starts, m = starts[pick], m[pick]
                long = _in(maps.value[1], m)
                # windows that travel alone go by all their words
                route = np.where(long, hash_windows(hashed, window)[starts], m).view(np.int64)
                text, begin, length = _stretches(first, starts, np.where(long, route.view(np.uint64), m))
                words, of = [], -1
                body = data.tobytes()
                for t, b, n in zip(text.tolist(), begin.tolist(), length.tolist(), strict=True):
                    own = keys[at + t]
                    if t != of:
                        of, copy = t, own in place
                        if copy:  # a copy of a text of this portion: what the first sent is known to repeat
                            for i in place[own]:
                                rows[i][1] = KNOWN
                        else:
                            place[own] = []
                            words = body[offs[t] : offs[t + 1]].split()
                    if copy:
                        continue
                    begins = int(starts[b] - first[t])
                    most = 1 if long[b] else STRETCH
                    for a in range(begins, begins + n, most):
                        some = min(most, begins + n - a)
                        size += add(own, int(route[b]), a, some, b" ".join(words[a : a + some + window - 1]))
                if size >= held:
                    size = 0
                    yield from flush()
        yield from flush()

    names = ["route", "state", "k", "k2", "start", "n", "words"]
    sent = texts.select("k", "k2", "text").mapInArrow(send, "route bigint, state tinyint, k bigint, k2 bigint, start int, n int, words binary")
    # what is settled needn't meet others, so it goes wherever its text does
    dealt = sent.withColumn("route", F.when(F.col("state") == TOLD, F.xxhash64("k", "start")).otherwise(F.col("route")))
    met = dealt.repartition("route").sortWithinPartitions("route").mapInArrow(lambda batches: _settled(batches, window), "k bigint, k2 bigint, runs array<int>")
    return met.groupBy("k", "k2").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, group: int = GROUP, held: int = HELD, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), and kept_text if asked for, of every document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    own = own.withColumns({"k": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    counts = checkpointed(count_prefixes(own, window, gram, held).filter("n > 1"))
    gone = checkpointed(repeated_windows(own, _bitmap(counts, REPEATED_BITS), _bitmap(counts.filter(F.col("n") > group), LENGTHENED_BITS), window, gram, held))
    release(counts)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digest, kept = [], [], [], []
            for body, runs in zip(batch.column(1), batch.column(2), strict=True):
                words = body.as_py().encode().split()
                n = len(words)
                if runs.is_valid:
                    cover = np.zeros(n + 1, np.int64)
                    start, length = runs.values.to_numpy().reshape(-1, 2).T
                    np.add.at(cover, start, 1)
                    np.subtract.at(cover, start + length + window - 1, 1)
                    words = list(compress(words, (np.cumsum(cover[:-1]) == 0).tolist()))
                joined = b" ".join(words)
                total.append(n)
                removed.append(n - len(words))
                digest.append(hashlib.sha256(joined).hexdigest())
                if keep_text:
                    kept.append(joined.decode())
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * keep_text, names=names)

    own = screened(own, gone, "k")
    whole = own.filter("NOT __tm_maybe").select("doc_id", "text", F.lit(None).cast("array<int>").alias("runs"))
    cut = own.filter("__tm_maybe").join(gone, ["k", "k2"], "left").select("doc_id", "text", "runs")
    return whole.union(cut).mapInArrow(finish, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * keep_text)


def op9_substrings(spark, sf_dir: str) -> DataFrame:
    """Every document with what is left when passages of 35 repeated words are gone."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
y AS (SELECT row, s, array_to_string(w[s : s + 34], ' ') AS k FROM (SELECT row, w, unnest(generate_series(1, len(w) - 34)) AS s FROM d WHERE len(w) >= 35)),
g AS (SELECT DISTINCT row, unnest(generate_series(s, s + 34)) AS p FROM y WHERE k IN (SELECT k FROM y GROUP BY k HAVING count(*) > 1)),
n AS (SELECT row, count(*) AS gone FROM g GROUP BY row),
l AS (SELECT row, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d),
t AS (SELECT row, string_agg(x, ' ' ORDER BY p) AS kept FROM l ANTI JOIN g USING (row, p) GROUP BY row)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.gone, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (row) LEFT JOIN t USING (row)
"""
