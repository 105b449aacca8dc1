"""Language identification of code-switched text with a linear-chain conditional random field.

Method. Each word of a sentence gets a language. A word's features are its byte trigrams with the blanks around it, its first and
last four bytes (affixes), and its entry in a lexicon of words that sampled documents share; each has a learned
weight per language. Transitions between neighbouring words are learned too, from sampled sentences and from sequences
spliced of several languages. Forward-backward gives every word's posterior; a document's language is the one with the largest
mean posterior over all its words, and that mean is the score. Runs of words of one language are spans, with their place, language and mean posterior.

A chain is a sentence (up to a full stop, mark or line feed), however long. Texts are lower-cased and read whole.

Posteriors say which of the known languages is nearest, not whether any is near. For that there is the coverage: the share of a text's
trigrams that training documents have. Foreign or garbled text has little of it, whatever the number of languages.

Training. Every language of the table is learned. At most SAMPLE documents with a language (about), chosen by a hash and spread over languages, but
LEAST_SAMPLE of each language that has them, go to one task, which fits the model; only the model reaches the driver. Of a document longer than SAMPLE_CHARS characters,
STRETCHES stretches evenly spread over it are learned from. Nothing but text and language is learned from.

Cases. A null text, or one with no letter, is `und` with score 0. With no document to learn from every text is. Repeated rows and null
ids are predicted like others (a null id counts as held out). An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.textvec import fitted, hash_words, lowered, plain_words, slices

SAMPLE = 1200
SAMPLE_CHARS = 4000
STRETCHES = 8
#: Sampled documents of a language at least (about), however many languages there are.
LEAST_SAMPLE = 16
BUCKETS = 1 << 15
ROUNDS = 40
#: A language comes with this many sampled documents that share a word before the word enters the lexicon.
SHARED = 4
LEXICON = 4096
#: Documents that share a trigram before it counts as known.
KNOWN = 2
#: Texts with a smaller share of known trigrams are rejected by the corpus pipeline.
LEAST_COVERAGE = 0.5


@dataclass
class Words:
    """The words of some texts, with their features and chains."""

    tri: np.ndarray  # bucket of every byte's trigram, word by word
    tri_at: np.ndarray  # where each word's trigrams begin
    head: np.ndarray
    tail: np.ndarray
    key: np.ndarray
    chain: np.ndarray  # where each chain begins, and the end
    first: np.ndarray  # where each text's words begin, and the end


def _bucket(x: np.ndarray) -> np.ndarray:
    return ((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)


def read_words(data: np.ndarray, offs: np.ndarray) -> Words:
    """Words of lower-cased texts."""
    starts, ends, first = plain_words(data, offs, digits=False)
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none, none.astype(np.uint64), np.zeros(1, np.int64), first)
    length = ends - starts
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    # a word that begins where another ends (two texts in a row) must not cancel
    word = np.cumsum(inside[:-1]) > 0
    padded = np.zeros(len(data) + 2, np.uint32)
    padded[1:-1] = np.where(word, data, 0)
    left, mid, right = padded[:-2].copy(), padded[1:-1], padded[2:].copy()
    left[starts] = 0
    right[ends - 1] = 0
    tri = _bucket((left << np.uint32(16) | mid << np.uint32(8) | right) + np.uint32(1))[word]
    tri_at = np.concatenate(([0], np.cumsum(length)[:-1]))

    def affix(at: np.ndarray, step: int) -> np.ndarray:
        out = np.zeros(n, np.uint32)
        for k in range(4):
            held = length > k
            out = (out << np.uint32(8)) | np.where(held, data[np.where(held, at + step * k, 0)], 0).astype(np.uint32)
        return _bucket(out)

    stop = np.zeros(256, bool)
    stop[[10, 33, 46, 63]] = True
    stops = np.concatenate(([0], np.cumsum(stop[data])))
    new = np.ones(n, bool)
    new[1:] = stops[starts[1:]] > stops[ends[:-1]]
    new[first[:-1][first[:-1] < n]] = True
    chain = np.concatenate((np.flatnonzero(new), [n]))
    return Words(tri, tri_at, affix(starts, 1), affix(ends - 1, -1), hash_words(data, starts, ends), chain, first)


@dataclass
class Model:
    """Weights by feature and language."""

    languages: list[str]
    tri: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    lex: np.ndarray  # the last row is of all other words
    move: np.ndarray
    start: np.ndarray
    seen: np.ndarray  # trigrams that training documents have

    def coverage(self, w: Words) -> np.ndarray:
        """The share of each text's trigrams that are known; 0 for texts without words."""
        have = np.concatenate(([0], np.cumsum(self.seen[w.tri])))
        ends = np.concatenate((w.tri_at, [len(w.tri)]))[w.first]
        return (have[ends[1:]] - have[ends[:-1]]) / np.maximum(np.diff(ends), 1)

    def entry(self, w: Words) -> np.ndarray:
        at = np.searchsorted(self.lexicon, w.key)
        at[at == len(self.lexicon)] = 0
        known = self.lexicon[at] == w.key if len(self.lexicon) else np.zeros(len(w.key), bool)
        return np.where(known, at, len(self.lexicon))

    def scores(self, w: Words) -> np.ndarray:
        out = self.head[w.head] + self.tail[w.tail] + self.lex[self.entry(w)]
        for k in range(out.shape[1]):
            out[:, k] += np.add.reduceat(self.tri[:, k][w.tri], w.tri_at)
        return out

    def posteriors(self, w: Words) -> np.ndarray:
        if not len(w.key):
            return np.zeros((0, len(self.languages)))
        return forward_backward(self.scores(w), w.chain, self.move, self.start)[0]


def forward_backward(scores: np.ndarray, chain: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posteriors of each word, expected transitions, expected chain starts), all chains side by side."""
    length = np.diff(chain)
    order = np.argsort(-length, kind="stable")
    at, length = chain[:-1][order], length[order]
    longest = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(longest), side="left")  # chains with over t words
    psi = np.exp(scores - scores.max(axis=1, keepdims=True))
    m, alpha = np.exp(move - move.max()), np.empty_like(psi)
    a = np.exp(start - start.max())[None, :] * psi[at]
    for t in range(longest):
        if t:
            a = (a[: live[t]] @ m) * psi[at[: live[t]] + t]
        a = a / a.sum(axis=1, keepdims=True)
        alpha[at[: live[t]] + t] = a
    post, moved = alpha.copy(), np.zeros_like(m)
    beta = np.ones_like(psi)
    for t in range(longest - 2, -1, -1):
        here = at[: live[t + 1]] + t
        ahead = psi[here + 1] * beta[here + 1]
        ahead /= ahead.sum(axis=1, keepdims=True)
        b = ahead @ m.T
        beta[here] = b
        joint = alpha[here].T @ (ahead / (alpha[here] * b).sum(axis=1, keepdims=True))
        moved += joint * m
    post *= beta
    post /= post.sum(axis=1, keepdims=True)
    return post, moved, post[at].sum(axis=0)


def _blocks(spliced: list[list[tuple[str, int]]], most: int = 1 << 19) -> Iterator[tuple[Words, np.ndarray]]:
    """(words, languages of the words) of texts made of pieces in one language each, some texts at a time. Blocks without words are left out."""
    at = 0
    while at < len(spliced):
        body, edges, labels, here, start = [], [], [], 0, at
        while at < len(spliced) and (here < most or at == start):
            text, inside = " ".join(t for t, _ in spliced[at]).encode(), here
            for t, lang in spliced[at]:
                edges.append(inside)
                labels.append(lang)
                inside += len(t.encode()) + 1
            body.append(text)
            here += len(text)
            at += 1
        data = np.frombuffer(b"".join(body), np.uint8)
        offs = np.concatenate(([0], np.cumsum([len(x) for x in body])))
        starts = plain_words(data, offs, digits=False)[0]
        if len(starts):
            yield read_words(data, offs), np.array(labels)[np.searchsorted(np.array(edges), starts, side="right") - 1]


def fit(texts: list[tuple[str, str]], rounds: int = ROUNDS, seed: int = 7) -> Model | None:
    """A model of (lower-cased text, language) pairs; None without any."""
    languages = sorted({lang for _, lang in texts})
    if not languages:
        return None
    rng, size = np.random.default_rng(seed), len(languages)
    code = {lang: i for i, lang in enumerate(languages)}
    spliced: list[list[tuple[str, int]]] = []
    parts = [(code[lang], t.split()) for t, lang in texts]
    for i, (lang, own) in enumerate(parts):
        spliced.append([(" ".join(own), lang)])
        if size > 1 and i % 2 == 0:  # code-switched: stretches of this and other documents in turn
            mixed = []
            for j in range(0, min(len(own), 120), 12):
                other, words = parts[rng.integers(len(parts))]
                cut = rng.integers(0, max(1, len(words) - 8))
                mixed += [(" ".join(own[j : j + 12]).translate({46: 32, 33: 32, 63: 32}), lang), (" ".join(words[cut : cut + 8]).translate({46: 32, 33: 32, 63: 32}), other)]
            spliced.append(mixed)
    blocks, pairs, known = [], [], np.zeros(BUCKETS, np.int64)
    for w, gold in _blocks(spliced):
        # chains don't go over the edge of a block, so blocks are looked at one after another, and little is held at a time
        doc = np.searchsorted(w.first, np.arange(len(gold)), side="right")
        reps = np.diff(np.concatenate((w.tri_at, [len(w.tri)])))
        pairs.append(np.unique(np.stack((w.key, doc.astype(np.uint64))), axis=1)[0])
        known += np.bincount(np.unique(np.repeat(doc, reps) * BUCKETS + w.tri) % BUCKETS, minlength=BUCKETS)
        inner = np.ones(len(gold), bool)
        inner[w.chain[:-1]] = False
        steps = np.flatnonzero(inner)
        true_move = np.zeros((size, size))
        np.add.at(true_move, (gold[steps - 1], gold[steps]), 1)
        blocks.append((w, np.eye(size)[gold], np.repeat(np.arange(len(gold), dtype=np.int32), reps), true_move))
    if not blocks:
        return None
    total = sum(len(truth) for _, truth, _, _ in blocks)
    keys, held = np.unique(np.concatenate(pairs), return_counts=True)
    lexicon = np.sort(keys[held >= SHARED][np.argsort(-held[held >= SHARED], kind="stable")][:LEXICON])
    model = Model(languages, np.zeros((BUCKETS, size)), np.zeros((BUCKETS, size)), np.zeros((BUCKETS, size)), lexicon, np.zeros((len(lexicon) + 1, size)), np.zeros((size, size)), np.zeros(size), known >= min(KNOWN, len(texts)))
    weights = [model.tri, model.head, model.tail, model.lex, model.move, model.start]
    squares = [np.full_like(x, 1e-6) for x in weights]
    for _ in range(rounds):
        steep = [np.zeros_like(x) for x in weights]
        for w, truth, of_word, true_move in blocks:
            post, moved, begun = forward_backward(model.scores(w), w.chain, model.move, model.start)
            gap = (truth - post) / total
            for k in range(size):
                steep[0][:, k] += np.bincount(w.tri, gap[of_word, k], BUCKETS)
                steep[1][:, k] += np.bincount(w.head, gap[:, k], BUCKETS)
                steep[2][:, k] += np.bincount(w.tail, gap[:, k], BUCKETS)
                steep[3][:, k] += np.bincount(model.entry(w), gap[:, k], len(lexicon) + 1)
            steep[4] += (true_move - moved) / total
            steep[5] += (truth[w.chain[:-1]].sum(axis=0) - begun) / total
        for x, g, s in zip(weights, steep, squares, strict=True):
            g = g - 1e-6 * x
            s += g * g
            x += 0.3 * g / np.sqrt(s)
    for name in ("tri", "head", "tail", "lex"):
        setattr(model, name, getattr(model, name).astype(np.float32))
    return model


def train(docs: DataFrame, doc_id: str, text: str, lang: str, chosen=None, sample: int = SAMPLE) -> Model | None:
    """A model of a bounded sample of the documents that have a language and meet the condition."""
    own = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).filter("l IS NOT NULL")
    own = own.filter(chosen) if chosen is not None else own
    own = own.filter("t IS NOT NULL")
    sizes = [(r.l, r.n) for r in own.groupBy("l").agg(F.count("*").alias("n")).collect()]
    if not sizes:
        return None
    each = max(LEAST_SAMPLE, sample // len(sizes))
    rates = docs.sparkSession.createDataFrame([(lang, min(1.0, each / n)) for lang, n in sizes], "l string, rate double")
    drawn = own.join(F.broadcast(rates), "l").filter(F.pmod(F.xxhash64("i", "t"), F.lit(1 << 30)) < F.col("rate") * (1 << 30))
    part = SAMPLE_CHARS // STRETCHES
    spread = f"array_join(transform(sequence(0, {STRETCHES - 1}), i -> substring(t, cast(1 + floor(i * (char_length(t) - {part}) / {STRETCHES - 1}) AS int), {part})), '\\n')"
    body = F.expr(f"CASE WHEN char_length(t) <= {SAMPLE_CHARS} THEN t ELSE {spread} END")
    rows = drawn.select("l", body.alias("t"), F.xxhash64("i", "t").alias("h")).orderBy("h").limit(2 * max(sample, each * len(sizes)))
    return fitted(rows, lambda table: fit([(t.lower(), lang) for _, t, lang in sorted(zip(*(table.column(c).to_pylist() for c in "htl"), strict=True))]))


def spans(model: Model, w: Words, post: np.ndarray, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[dict]]:
    """(where each text's spans begin, and the end; spans) from the words' posteriors. chars: for each byte, which code point of its text it is in."""
    if not len(w.key):
        return np.zeros(len(w.first), np.int64), []
    best = post.argmax(axis=1)
    new = np.ones(len(best), bool)
    new[1:] = best[1:] != best[:-1]
    new[w.first[:-1][w.first[:-1] < len(best)]] = True
    at = np.flatnonzero(new)
    size = np.diff(np.concatenate((at, [len(best)])))
    sure = np.add.reduceat(post[np.arange(len(best)), best], at) / size
    text = np.searchsorted(w.first, at, side="right") - 1
    begin, stop = chars[starts[at]], ends[at + size - 1]
    # the byte after a word may be the next text's first, so its last character is looked at
    end = chars[stop - 1] + 1
    rows = [{"start": int(a), "end": int(z), "language": model.languages[k], "posterior": float(p)} for a, z, k, p in zip(begin.tolist(), end.tolist(), best[at].tolist(), sure.tolist(), strict=True)]
    return np.searchsorted(text, np.arange(len(w.first))), rows


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("language", pa.string()), ("posterior", pa.float64())]))


def predict(docs: DataFrame, model: Model | None, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score", coverage_out: str | None = None, spans_out: str | None = None) -> DataFrame:
    """The documents, all columns kept, with a language and a score, and, if named, the coverage and the spans: array of (start, end, language, posterior), in code points."""
    place, schema = docs.columns.index(text), docs.schema
    spoken = "__tm_letters"
    ready = docs.withColumn(spoken, F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            n = batch.num_rows
            best, score, covered, found = np.full(n, -1), np.zeros(n), np.zeros(n), [[] for _ in range(n)]
            letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            for at, data, offs in slices(lowered(batch.column(place))) if model else ():
                w = read_words(data, offs)
                post = model.posteriors(w)
                total = np.concatenate((np.zeros((1, len(model.languages))), np.cumsum(post, axis=0)))
                words = np.diff(w.first)
                mean = (total[w.first[1:]] - total[w.first[:-1]]) / np.maximum(words, 1)[:, None]
                some = np.flatnonzero(words)
                best[at + some] = mean[some].argmax(axis=1)
                score[at + some] = np.clip(mean[some].max(axis=1), 0, 1)
                covered[at : at + len(words)] = model.coverage(w)
                if spans_out:
                    chars = np.cumsum((data & 0xC0) != 0x80) - 1
                    chars -= np.repeat(chars[np.minimum(offs[:-1], max(len(data) - 1, 0))], np.diff(offs)) if len(data) else 0
                    starts, ends, _ = plain_words(data, offs, digits=False)
                    edge, rows = spans(model, w, post, chars, starts, ends)
                    for i in range(len(words)):
                        found[at + i] = rows[edge[i] : edge[i + 1]]
            best[~letters] = -1
            score[best < 0] = 0
            named = [model.languages[i] if i >= 0 else "und" for i in best.tolist()]
            more = [pa.array(covered)] * bool(coverage_out) + ([pa.array([f if k >= 0 else [] for f, k in zip(found, best.tolist(), strict=True)], _SPAN)] if spans_out else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(named, pa.string()), pa.array(score), *more], names=[*batch.schema.names[:-1], "p", "s", "c", "z"][: batch.num_columns + 1 + len(more)])

    out = schema.add(lang_out, "string").add(score_out, "double")
    out = out.add(coverage_out, "double") if coverage_out else out
    span = T.StructType().add("start", "integer").add("end", "integer").add("language", "string").add("posterior", "double")
    out = out.add(spans_out, T.ArrayType(span)) if spans_out else out
    return ready.mapInArrow(run, out)


def op1_language(spark, sf_dir: str) -> DataFrame:
    """Every document with its language, learned from two thirds of the ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = "crc32(cast({} AS string)) % 3"
    model = train(docs, "doc_id", "text", "lang", F.expr(fold.format("i") + " <> 1"))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.expr(f"coalesce({fold.format('doc_id')} = 1, true)").alias("held_out"), "lang_pred", "score")
