"""Near-duplicate groups by SimHash, through a byte-position inverted index with count filtering, and an exact check.

Method. As in op2_simhash, fingerprints are listed by bytes at given positions, and pairs are filtered by how many bytes they share. Copies that
keep a similarity of 0.8 differ in about one bit of eight, too many for 64 bits to tell, so the fingerprint here has 512 bits, eight SimHashes
of the set of five-word shingles. The index lists its 64 bytes under as many sets of three positions. Within a list the shared
bytes of each pair are tallied, pairs under 6 are left, and the rest are verified bit by bit: those within 140 bits are joined.

No such index is sure to hold a pair that differs in up to 140 of 512 bits, so a second one follows for the pairs that it missed. All shingles
have one order, and a text is listed under its first ones: as many as it can lack and still be at a similarity of 0.8, and one more. So any two texts whose
sets of shingles have a Jaccard similarity of 0.8 or more meet in a list, whatever their length and wherever they differ. Shingles that many of a sample
of the texts hold come last in the order, so that lists stay short; which ones these are changes no result, as any order will do. Here texts that the
first index joined aren't compared again; others are joined within 140 bits. All texts that are joined are candidates of one group. Within candidates the
texts are compared: pairs at an exact similarity of 0.8 or more are linked, and linked texts are a group.

A pair at 0.8 has a cosine of 0.889 at least, so each bit differs with a chance of 0.152: 78 of 512 with a deviation of 8. Four shingles
against five, the worst case by ties, differ in 96 with a deviation of 9. So 140 is five deviations off at least.

Scale. Copies of a text are one entry. Lists with one entry are dropped, lists of the same texts are one; longer ones than TILE are dealt to pairs of blocks.
What leaves a task is at most one link for each entry, to one text of those that it is joined with.
Three bytes make 2**24 lists of each kind; above MANY texts the index takes four, so that lists hold few texts by chance; the second index makes up for what it then misses. Candidates of up to BLOCK texts are compared in one task. Larger
groups are compared in blocks first, dealt twice by different hashes, and then only across blocks that hold texts of different classes, so near
copies in their thousands, which the blocks join, never meet each with each. A text has 64 keys in the index, and of its shingles about a fifth are dealt out as keys; whole sets only of candidates.
Documents are sorted out by a bitmap of fixed size of the texts that have copies, and only those
that may be among them are shuffled.

Rows are told apart by what is in them, id and text, never by their place, so a table that is split in another way when a task is done again gives the same rows.

Cases. A null text is like an empty one; texts without words are alike. Texts under five words have one shingle, their whole
sequence. Repeated rows are copies of each other. Of a group, the row with the least id stays (no id counts as the largest); of rows with one id the one whose text has the least
hash, and of rows alike in id and text any one. Texts are known by a hash of 64 bits and a second one: a row whose first hash is another text's by
chance, and whose second is not, stays. All columns are kept, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.op2_simhash import TILE
from tidemark.llm.textvec import checkpointed, hash_windows, hash_words, mix, screened, slices, split_words

WORDS = 5
SIMILARITY = 0.8
PARTS = 8
#: Fingerprints further apart are of texts that are less alike.
DISTANCE = 140
#: The index has a set of positions for each of the 64 bytes: so far from it, the first WIDTH of them. Two sets share one position at most.
STEPS = (0, 7, 26, 36)
WIDTH = 3
#: Pairs that share fewer of the 64 bytes aren't compared. At 0.8 they share 17 with a deviation of 4; others one in four pairs one.
SHARED = 6
#: Above so many texts, sets of a position more.
MANY = 1 << 21
#: So many texts (about) are sampled for shingles that come last in the order: those of so many of them, at most so many.
SAMPLED = 4000
OFTEN = 8
COMMON = 1 << 16
#: Texts of a group compared within a task.
BLOCK = 512


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def _shingled(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    for _, data, offs in slices(column):
        starts, ends, first = split_words(data, offs)
        hashed = hash_words(_lower(data), starts, ends)
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield np.unique(hash_windows(hashed[a:b], max(1, min(words, b - a))))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """The SimHashes of a set of hashes, one after another; all zeros for none."""
    own = np.unique(hashes)
    out = np.zeros(PARTS, "<u8")
    for k in range(PARTS if len(own) else 0):
        counts = np.zeros(64, np.int64)
        for a in range(0, len(own), 16384):
            h = mix(own[a : a + 16384] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(counts * 2 > len(own), bitorder="little").view("<u8")[0]
    return out.tobytes()


def joined_within(prints: np.ndarray, distance: int = DISTANCE, shared: int = 0, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(first, other) index pairs that join all fingerprints (n x 8 numbers) within a distance, directly or through others, to the first of them.

    Only pairs with at least `shared` equal bytes count. Fingerprints alike in `known` are joined already, and no pair says so again.
    """
    body = np.ascontiguousarray(prints).view(np.uint8)
    out, left = [], np.arange(len(prints))
    while len(left) > 1:
        root, reached, left = int(left[0]), [int(left[0])], left[1:]
        while reached and len(left):
            i = reached.pop()
            if known is not None:
                same = known[left] == known[i]
                reached += left[same].tolist()
                left = left[~same]
            maybe = np.flatnonzero((body[left] == body[i]).sum(axis=1) >= shared) if shared else np.arange(len(left))
            near = maybe[np.bitwise_count(prints[left[maybe]] ^ prints[i]).sum(axis=1, dtype=np.int64) <= distance]
            found = left[near].tolist()
            out += [(root, i) for i in found]
            reached += found
            left = np.delete(left, near)
    return out


def _first_shingles(own: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """Of a text's shingles the first in order, of which any text as similar must share one. Texts without words have 0."""
    if not len(own):
        return np.zeros(1, np.int64)
    order = own >> np.uint64(1)
    if len(common):
        last = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
        order = np.sort(order | last.astype(np.uint64) << np.uint64(63))
    lack = len(own) - int(np.ceil(similarity * len(own) - 1e-9))
    return order[: lack + 1].view(np.int64)


def _common(texts: DataFrame, words: int) -> np.ndarray:
    """Shingles that many of a sample of the texts hold, sorted."""
    n = texts.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in _shingled(batch.column(0), words):
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["s"])

    drawn = texts.filter(F.pmod("k", F.lit(1 << 30)) < min(1.0, SAMPLED / max(n, 1)) * (1 << 30)).select("k", "text").dropDuplicates(["k"]).select("text")
    often = drawn.mapInArrow(run, "s bigint").groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)
    return np.sort(np.array([r.s for r in often.orderBy(F.desc("n"), "s").limit(COMMON).collect()], np.int64).view(np.uint64))


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches without the keys in their first column that the task had before."""
    seen: set[int] = set()
    for batch in batches:
        new = []
        for i, k in enumerate(batch.column(0).to_pylist()):
            if k not in seen:
                seen.add(k)
                new.append(i)
        if new:
            yield batch.take(pa.array(new)) if len(new) < batch.num_rows else batch


def _prints(texts: DataFrame, words: int) -> DataFrame:
    """(k, fp) of (k, text): each text at least once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _fresh(batches):
            out = [wide_fingerprint(own) for own in _shingled(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["k", "fp"])

    return texts.select("k", "text").mapInArrow(run, "k bigint, fp binary")


def _places(prints: np.ndarray, width: int) -> np.ndarray:
    """The keys (n x 64) of fingerprints (n x 8 numbers) in the index: a set's number and its bytes."""
    body = np.ascontiguousarray(prints).view(np.uint8)
    at = np.arange(body.shape[1])
    keys = np.broadcast_to(at << 8 * width, body.shape).copy()
    for j, step in enumerate(STEPS[:width]):
        keys |= body[:, (at + step) % len(at)].astype(np.int64) << 8 * j
    return keys


def _indexed(nodes: DataFrame, width: int) -> DataFrame:
    """(key, k) for the position sets of each fingerprint of (k, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _places(_numbers(batch.column(1)), width)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], names=["key", "k"])

    return nodes.select("k", "fp").mapInArrow(run, "key bigint, k bigint")


def _numbers(fps: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(fps.to_pylist()), "<u8").reshape(-1, PARTS)


def _entries(texts: DataFrame, words: int, similarity: float, common: np.ndarray) -> DataFrame:
    """(key, k) for the first shingles of each text."""
    held = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _fresh(batches):
            keys = [_first_shingles(own, similarity, held.value) for own in _shingled(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in keys]))], names=["key", "k"])

    return texts.select("k", "text").mapInArrow(run, "key bigint, k bigint")


def _lists(entries: DataFrame) -> DataFrame:
    """(key, n, k) of the lists with several texts, each set of texts once. The new key is made of the set."""

    def whole(key: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (k[1:] != k[:-1])
        key, k = key[fresh], k[fresh]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.concatenate((at, [len(key)])))
        name = np.add.reduceat(mix(k.view(np.uint64)), at).view(np.int64)
        several = np.repeat(n > 1, n)
        return pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (np.repeat(name, n), np.repeat(n, n), k)], names=["key", "n", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the last key's rows may go on in the next batch
        for batch in batches:
            key, k = (c.to_numpy() for c in batch.columns)
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if held and (cut or held[0][0][0] != key[0]):
                yield whole(*(np.concatenate(c) for c in zip(*held, (key[:cut], k[:cut]), strict=True)))
                held = []
            elif cut:
                yield whole(key[:cut], k[:cut])
            held.append((key[cut:], k[cut:]))
        if held:
            yield whole(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return entries.repartition("key").sortWithinPartitions("key", "k").mapInArrow(run, "key bigint, n bigint, k bigint").distinct()


def _dealt(rows: DataFrame, keys: list[str], order: str, tile: int) -> DataFrame:
    """Rows of groups (key columns, and n, how many rows they have) dealt to pairs x, y of blocks of about `tile` rows, so that any two rows of a group meet."""
    own = rows.withColumn("blocks", F.expr(f"cast(ceil(n / {tile}D) AS int)"))
    own = own.withColumn("block", F.expr(f"cast(pmod(xxhash64({order}), blocks) AS int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return own.select(*keys, F.expr("least(block, other)").alias("x"), F.expr("greatest(block, other)").alias("y"), *[c for c in rows.columns if c not in {*keys, "n"}])


def _linked(tiles: DataFrame, keys: list[str], columns: list[str], find) -> DataFrame:
    """(a, b): the links that `find` makes between the rows of each tile, as index pairs, from the values of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, keys):
            ks = part.column("k").to_numpy()
            found = np.array(find(*[part.column(c) for c in columns]), np.int64).reshape(-1, 2)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(ks[found[:, 0]]), pa.array(ks[found[:, 1]])], names=["a", "b"])

    return tiles.repartition(*keys).sortWithinPartitions(*keys, "k").select(*keys, "k", *columns).mapInArrow(run, "a bigint, b bigint")


def _near(nodes: DataFrame, tile: int) -> DataFrame:
    """(a, b): links that join texts that the index finds: alike at the positions of a set, with enough bytes in common and near enough."""
    width = WIDTH + (nodes.count() > MANY)
    tiles = _dealt(_lists(_indexed(nodes, width)), ["key"], "k", tile).join(nodes.select("k", "fp"), "k")
    return _linked(tiles, ["key", "x", "y"], ["fp"], lambda fps: joined_within(_numbers(fps), shared=SHARED))


def _missed(nodes: DataFrame, entries: DataFrame, known: DataFrame, tile: int) -> DataFrame:
    """(a, b): links that join all texts that share a first shingle and whose fingerprints are near enough, but for those that `known` (node, root) joins."""
    own = nodes.select("k", "fp").join(known.withColumnRenamed("node", "k"), "k", "left").select("k", "fp", F.coalesce("root", "k").alias("root"))
    tiles = _dealt(_lists(entries), ["key"], "k", tile).join(own, "k")
    return _linked(tiles, ["key", "x", "y"], ["fp", "root"], lambda fps, root: joined_within(_numbers(fps), known=root.to_numpy()))


def _candidates(nodes: DataFrame, entries: DataFrame, tile: int) -> DataFrame:
    """(a, b): links that join all texts that may be similar enough: those that the index finds, and the pairs that it missed."""
    known = components(_near(nodes, tile))
    return known.select(F.col("root").alias("a"), F.col("node").alias("b")).union(_missed(nodes, entries, known, tile))


def alike(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """(first, other) index pairs that join all sets which are similar enough, directly or through others, to the first of them. Sets that are joined already are passed over."""
    group, size = np.arange(len(sets)), np.array([len(s) for s in sets])
    for i in range(1, len(sets)):
        while True:
            least, most = np.minimum(size[:i], size[i]), np.maximum(size[:i], size[i])
            for j in np.flatnonzero((group[:i] != group[i]) & (least >= similarity * most)):
                if not most[j] or _shared(sets[i], sets[j]) >= similarity / (1 + similarity) * (size[i] + size[j]) - 1e-9:
                    one, two = sorted((group[i], group[j]))
                    group[group == two] = one
                    break
            else:
                break
    return [(int(g), i) for i, g in enumerate(group) if g != i]


def _shared(p: np.ndarray, q: np.ndarray) -> int:
    if len(p) > len(q):
        p, q = q, p
    at = np.searchsorted(q, p)
    return int((q[np.minimum(at, len(q) - 1)] == p).sum())


def _verified(groups: DataFrame, texts: DataFrame, words: int, similarity: float, block: int) -> DataFrame:
    """(node, root): the classes of texts that are similar enough, of candidates (node, root). texts: (k, text)."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _fresh(batches):
            # as signed numbers the sets are no longer in order
            out = [np.sort(own.view(np.int64)) for own in _shingled(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["k", "s"])

    def judge(column: pa.ChunkedArray) -> list[tuple[int, int]]:
        return alike([x.values.to_numpy() for c in column.chunks for x in c], similarity)

    own = groups.join(groups.groupBy("root").agg(F.count("*").alias("n")), "root").select(F.col("node").alias("k"), "root", "n")
    own = checkpointed(own)
    sets = screened(texts.select("k", "text"), own, "k").filter("__tm_maybe").select("k", "text").mapInArrow(shingle, "k bigint, s array<bigint>")
    sets = checkpointed(sets.join(own.select("k"), "k", "left_semi").dropDuplicates(["k"]))
    small = _linked(own.filter(f"n <= {block}").select("root", "k").join(sets, "k"), ["root"], ["s"], judge)
    large = own.filter(f"n > {block}")
    if large.isEmpty():
        return components(small)
    # any two texts of a large group meet in a block or don't, but dense classes come together
    blocks = f"cast(ceil(n / {block}D) AS int)"
    turns = [large.select("root", F.lit(turn).alias("turn"), F.expr(f"cast(pmod(xxhash64(k, {turn}), {blocks}) AS int)").alias("part"), "k") for turn in (0, 1)]
    dense = checkpointed(_linked(turns[0].union(turns[1]).join(sets, "k"), ["root", "turn", "part"], ["s"], judge))
    within = components(dense)
    known = large.join(within.select(F.col("node").alias("k"), F.col("root").alias("class")), "k", "left").select("root", "k", F.coalesce("class", "k").alias("class"))
    sizes = known.groupBy("root", "class").agg(F.count("*").alias("c"))
    # a class as large as a block has blocks of its own, numbered by itself; smaller ones share blocks
    rest = sizes.groupBy("root").agg(F.sum(F.expr(f"CASE WHEN c < {block} THEN c ELSE 0 END")).alias("few"), F.count("*").alias("classes")).filter("classes > 1")
    placed = known.join(sizes, ["root", "class"]).join(rest, "root").select(
        "root",
        "k",
        F.expr(f"CASE WHEN c >= {block} THEN class END").alias("own"),
        F.expr(f"CASE WHEN c >= {block} THEN cast(pmod(xxhash64(k, 2), cast(ceil(c / {block}D) AS int)) AS int) ELSE cast(pmod(xxhash64(class), cast(ceil(few / {block}D) AS int)) AS int) END").alias("part"),
    )
    placed = checkpointed(placed)
    there = placed.select("root", "own", "part").distinct()
    there = there.withColumn("at", F.xxhash64("own", "part"))
    meet = there.alias("p").join(there.alias("q"), "root").filter("p.own IS NULL OR q.own IS NULL OR p.own <> q.own")
    meet = meet.select("root", F.col("p.own").alias("own"), F.col("p.part").alias("part"), F.least("p.at", "q.at").alias("x"), F.greatest("p.at", "q.at").alias("y"))
    both = meet.join(placed, (meet.root == placed.root) & meet.own.eqNullSafe(placed.own) & (meet.part == placed.part)).select(meet.root, "x", "y", "k")
    across = _linked(both.join(sets, "k"), ["root", "x", "y"], ["s"], judge)
    return components(small.union(dense).union(across))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, of batches sorted by key."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        rows = np.stack([table.column(c).to_numpy() for c in keys])
        edges = [0, *(np.flatnonzero((rows[:, 1:] != rows[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(rows[:, a].tolist())
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """The documents with one row of each group."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    hashes = F.xxhash64(body).alias("k"), F.xxhash64(F.lit(1), body).alias("k2")
    texts = docs.select(*hashes, F.col(f"`{doc_id}`").alias("id"), body.alias("text"))
    order = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k", "k2", "n")).alias("o")
    prints = _prints(texts, words).groupBy("k").agg(F.first("fp").alias("fp"))
    rows = texts.groupBy("k", "k2", "id").agg(F.count("*").alias("n")).groupBy("k").agg(order, F.sum("n").alias("rows"))
    nodes = checkpointed(prints.join(rows, "k"))
    groups = components(_candidates(nodes, _entries(texts, words, similarity, _common(texts, words)), tile))
    roots = _verified(groups, texts, words, similarity, block)
    # texts with more than one row in their class, and the row that stays
    linked = nodes.join(roots, nodes.k == roots.node).select("k", "root", "o")
    best = linked.groupBy("root").agg(F.min("o").alias("best"))
    alone = nodes.filter("rows > 1").join(roots, nodes.k == roots.node, "left_anti").select("k", "o", F.col("o").alias("best"))
    some = linked.join(best, "root").select("k", "o", "best").union(alone)
    some = checkpointed(some.select(F.col("k").alias("__tm_k"), F.col("o.k2").alias("__tm_own"), (F.col("best.k") == F.col("k")).alias("__tm_here"), F.col("best.id").alias("__tm_id"), (F.col("best.n") > 1).alias("__tm_again")))
    own = screened(docs.withColumns({"__tm_k": hashes[0], "__tm_k2": hashes[1]}), some, "__tm_k")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    alone, met = own.filter("NOT __tm_maybe").select(*columns), own.filter("__tm_maybe").join(some, "__tm_k", "left")
    chosen = F.col("__tm_here") & F.col(f"`{doc_id}`").eqNullSafe(F.col("__tm_id"))
    kept = alone.union(met.filter(F.col("__tm_own").isNull() | (F.col("__tm_k2") != F.col("__tm_own")) | (chosen & ~F.col("__tm_again"))).select(*columns))
    if not some.filter("__tm_here AND __tm_again").isEmpty():
        again = own.filter("__tm_maybe").join(some.filter("__tm_here AND __tm_again"), "__tm_k").filter(chosen & (F.col("__tm_k2") == F.col("__tm_own")))
        kept = kept.union(again.dropDuplicates(["__tm_k"]).select(*columns))
    return kept
