"""Words and hashes of whole Arrow string columns, as numpy arrays over their UTF-8 bytes.

A word here is a maximal run of bytes other than space and 0x09 to 0x0D. Those separators are ASCII, so words of bytes
and words of code points are the same.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at a time; one longer text is handled alone.
SLICE_BYTES = 1 << 20

#: Words up to so many bytes are hashed together, eight bytes a step.
_LONG_WORD = 64
#: The lowest bytes of a number, by how many.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows with about `most` bytes of text. A null is an empty text."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + most, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def split_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more entry at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(n + 1, bool)
    inner = offs[:-1]
    first[inner[inner < n]] = True
    starts = np.flatnonzero(word & (first[:-1] | ~np.concatenate(([False], word[:-1]))))
    first[n] = True
    ends = np.flatnonzero(word & (first[1:] | ~np.concatenate((word[1:], [False])))) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes. Each step scrambles what was read so far, so no rule of letters makes words collide; words of up to eight bytes never do if alike in length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    body = np.zeros(len(data) + 8, np.uint8)
    body[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", body, strides=(1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rest, at = np.arange(len(starts)), starts
    for step in range(0, _LONG_WORD, 8):
        left = size[rest] - step
        more = eight[at] & _LOW[np.minimum(left, 8)]
        out[rest] = mix(out[rest] ^ more)
        on = left > 8
        rest, at = rest[on], at[on] + 8
        if not len(rest):
            return out
    body = data.tobytes()
    for i in rest.tolist():
        out[i] = xxhash.xxh64_intdigest(body[starts[i] : ends[i]], 7)
    return out


def hash_windows(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive words; shorter input gives none. Runs of 1, 2, 4, ... words are hashed from two halves, and a window from the runs that its length is made of."""
    m = len(words) - n + 1
    if m <= 0 or n <= 0:
        return np.zeros(0, np.uint64)
    out, done, run, size = None, 0, words, 1
    while True:
        if n & size:
            part = run[done : done + m]
            out = mix(part ^ np.uint64(n)) if out is None else joined(out, part)
            done += size
        if size * 2 > n:
            return out
        run = joined(run[:-size], run[size:])
        size *= 2


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in their order."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive numbers."""
    m = len(x) - w + 1
    if m <= 0:
        return x[:0]
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:m], x[w - have : w - have + m])


#: What makes Python workers give freed memory back instead of keeping it for later; several of them wait on each executor.
LEAN = {"MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "262144", "MALLOC_MMAP_THRESHOLD_": "4194304", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def lean_workers(spark) -> None:
    """Python workers that are started from now on keep little memory while they wait. What the session sets itself holds."""
    for name, value in LEAN.items():
        spark.sparkContext.environment.setdefault(name, value)


def shared_folder(spark) -> str:
    """The folder that the cluster names for checkpoints. On one machine, as in tests, it is a temporary one where none is named; elsewhere that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"{tempfile.gettempdir()}/checkpoints-{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written as a table to the shared folder and read from there, so that its size is known and its lineage ends."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(place)
    held = spark.read.schema(df.schema).parquet(place)
    held._tidemark_place = place
    return held


#: Bits of the screen that `screened` sends to every task: 2 MB, whatever it is made of.
SCREEN_BITS = 1 << 24


def screened(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows with a column __tm_maybe: true where the key (a 64-bit hash) is one of `keys`, and for the others only by chance.

    The screen is a bitmap of fixed size, at most SCREEN_BITS / 64 rows of two numbers, so it may be broadcast. The more keys there are the less it
    sorts out; what passes is still to be joined.
    """
    bit = F.pmod(F.col(key), F.lit(SCREEN_BITS))
    words = keys.select(bit.alias("b")).groupBy(F.expr("b div 64").alias("__tm_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 AS int))")).alias("__tm_bits"))
    found = rows.withColumn("__tm_word", F.expr(f"pmod(`{key}`, {SCREEN_BITS}) div 64")).join(F.broadcast(words), "__tm_word", "left")
    maybe = F.expr(f"coalesce(shiftright(`__tm_bits`, cast(pmod(`{key}`, {SCREEN_BITS}) % 64 AS int)) & 1L, 0L) = 1L")
    return found.withColumn("__tm_maybe", maybe).drop("__tm_word", "__tm_bits")


def release(*tables: DataFrame) -> None:
    """Deletes tables of `checkpointed` that nothing reads any more."""
    for df in tables:
        remove_folder(df.sparkSession, df._tidemark_place)


def remove_folder(spark, place: str) -> None:
    """Deletes a folder on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(97, 123), *range(128, 256)]] = True
_LETTERS_AND_DIGITS = _LETTERS.copy()
_LETTERS_AND_DIGITS[48:58] = True


def plain_words(data: np.ndarray, offs: np.ndarray, digits: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As split_words, for words of lower-case letters (any byte past ASCII counts as one) and, unless turned off, digits."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    word = (_LETTERS_AND_DIGITS if digits else _LETTERS)[data]
    first = np.zeros(n + 1, bool)
    inner = offs[:-1]
    first[inner[inner < n]] = True
    starts = np.flatnonzero(word & (first[:-1] | ~np.concatenate(([False], word[:-1]))))
    first[n] = True
    ends = np.flatnonzero(word & (first[1:] | ~np.concatenate((word[1:], [False])))) + 1
    return starts, ends, np.searchsorted(starts, offs)


def lowered(column: pa.Array) -> pa.Array:
    """The texts in lower case."""
    import pyarrow.compute as pc

    return pc.utf8_lower(column.cast(pa.large_string()))


def fitted(rows, fit):
    """What `fit` makes of a bounded sample, as an Arrow table, in one task on an executor; None for no rows."""
    import pickle

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.Table.from_batches(held)))], pa.binary())], names=["model"])

    found = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else None
