"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier.

Method. Lexicon voters are words that sampled toxic documents hold far more often than others; each votes toxic where it
occurs. Pattern voters look at the form of the text (shouting, runs of exclamation marks, masked words, no lexicon word at all).
A generative model with a hidden label estimates by expectation maximisation how often each voter fires given the label, and how far the
given labels are to be trusted: they are one more voter, whose rates of error are estimated like the others'. Correlation is part of the model: voters
that fire together more than the label explains form a block, and a block has one joint distribution, of how many of its
voters fire, instead of one for each voter. A logistic classifier over the voters and all hashed
words is then fitted to the model's posteriors, and scores every whole text.

Training. At most SAMPLE labelled documents of each label, chosen by a hash of the id. Their whole texts are turned into counts of hashed words where they are read;
those go to one task, which fits the model; only ids and the model reach the driver. Near copies among them count once. Sampling is undone by weights.

Cases. A null text is an empty one and is scored like any other. With no labelled document, scores are 0; with one label only,
they are that label's share as smoothed. Of several labels of one document the larger holds; null labels are left out.
Repeated rows and null ids are scored like others (a null id counts as held out). An empty table gives no rows. Other
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textvec import fitted, hash_words, lowered, mix, plain_words, slices

SAMPLE = 3000
#: Lexicon words at most, those that tell most; far more than pass the bars below in a sample of this size.
VOTERS = 4096
#: A lexicon word occurs in this many sampled toxic documents at least, and is this many times as frequent there.
LEAST_DOCS = 4
LIFT = 8.0
#: And the log likelihood ratio of that exceeds the log of the number of words by this much.
CERTAINTY = 6.0
#: How far given labels are trusted before anything is known: as if so many documents had been right, and so many wrong.
TRUST = (9.0, 1.0)
#: Voters whose firing correlates by more than this, beyond what the label explains, form a block.
TIED = 0.2
BUCKETS = 1 << 15
THRESHOLD = 0.3
PATTERNS = ("shout", "exclaim", "masked", "clean")


@dataclass
class Words:
    """The words of some texts and their form."""

    key: np.ndarray
    first: np.ndarray
    form: np.ndarray  # texts x 3: the pattern votes that don't need the lexicon
    times: np.ndarray | None = None  # how often each word is there, if not listed that often

    def means(self, x: np.ndarray) -> np.ndarray:
        """The mean of a figure of words over each text's words."""
        total = np.concatenate(([0.0], np.cumsum(x if self.times is None else x * self.times)))
        return (total[self.first[1:]] - total[self.first[:-1]]) / np.maximum(self.sizes(), 1)

    def sizes(self) -> np.ndarray:
        """How many words each text has."""
        if self.times is None:
            return np.diff(self.first)
        total = np.concatenate(([0], np.cumsum(self.times)))
        return total[self.first[1:]] - total[self.first[:-1]]


def read_words(raw: pa.Array) -> Iterator[tuple[int, Words]]:
    """(first row, words) of slices of a text column."""
    for at, data, offs in slices(raw):
        upper = _per_text((data >= 65) & (data <= 90), offs)
        lower = _per_text((data >= 97) & (data <= 122), offs)
        bang = data == 33
        run = np.zeros(len(data), bool)
        run[2:] = bang[2:] & bang[1:-1] & bang[:-2]
        star = np.zeros(len(data), bool)
        letter = ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))
        star[1:-1] = ((data[1:-1] == 42) | (data[1:-1] == 64)) & letter[:-2] & letter[2:]
        form = np.stack((upper > np.maximum(lower, 10), _per_text(run, offs) > 0, _per_text(star, offs) > 0), axis=1)
        n = len(offs) - 1
        for inner, low, low_offs in slices(lowered(raw.slice(at, n)), 1 << 62):
            assert inner == 0
            starts, ends, first = plain_words(low, low_offs)
            yield at, Words(hash_words(low, starts, ends), first, form)


def _per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offs[1:]] - total[offs[:-1]]


@dataclass
class Model:
    """The fitted classifier."""

    lexicon: np.ndarray  # sorted word hashes
    votes: np.ndarray  # a weight per lexicon word, then per pattern
    buckets: np.ndarray
    bias: float

    def ballots(self, w: Words) -> np.ndarray:
        """Texts x voters, 1 where a voter fires."""
        return ballots(self.lexicon, w)

    def score(self, w: Words) -> np.ndarray:
        z = self.bias + self.ballots(w) @ self.votes + w.means(self.buckets[_bucket(w.key)])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _bucket(key: np.ndarray) -> np.ndarray:
    return (key & np.uint64(BUCKETS - 1)).astype(np.int64)


def ballots(lexicon: np.ndarray, w: Words) -> np.ndarray:
    """Which voters fire on each text: lexicon words that occur, then PATTERNS."""
    n = len(w.first) - 1
    out = np.zeros((n, len(lexicon) + len(PATTERNS)))
    if len(lexicon) and len(w.key):
        at = np.searchsorted(lexicon, w.key)
        at[at == len(lexicon)] = 0
        hit = np.flatnonzero(lexicon[at] == w.key)
        out[np.searchsorted(w.first, hit, side="right") - 1, at[hit]] = 1
    out[:, len(lexicon) : len(lexicon) + 3] = w.form
    out[:, -1] = out[:, : len(lexicon)].sum(axis=1) == 0
    return out


def blocks_of(votes: np.ndarray, q: np.ndarray, weight: np.ndarray, tied: float = TIED) -> np.ndarray:
    """The block of each voter: voters tied directly or through others by correlation that the label doesn't explain."""
    mass = np.stack((weight * (1 - q), weight * q))
    rate = (mass @ votes) / np.maximum(mass.sum(axis=1, keepdims=True), 1e-9)
    rest = votes - np.outer(q, rate[1]) - np.outer(1 - q, rate[0])
    cov = (rest * weight[:, None]).T @ rest / weight.sum()
    sd = np.sqrt(np.diag(cov)) + 1e-9
    near = cov / np.outer(sd, sd) > tied
    block = np.arange(votes.shape[1])
    while True:
        least = np.where(near, block[None, :], votes.shape[1]).min(axis=1, initial=votes.shape[1])
        new = np.minimum(block, least)
        new = new[new]
        if (new == block).all():
            return block
        block = new


def label_model(votes: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posteriors, P(given label | label) as 2 x 2, block of each voter) from 0/1 votes and the given labels.

    Of a block the model knows whether none, one or more of its voters fire.
    """
    start = TRUST[0] / sum(TRUST)
    q = np.where(labels == 1, start, 1 - start)
    # with labels that err, good voters correlate at first: only those that nearly always agree are tied, until the labels' errors are known
    for tied in (4 * TIED, TIED):
        block = blocks_of(votes, q, weight, tied)
        q, given = _expect(votes, labels, weight, block, q, rounds)
    return q, given, block


def _expect(votes: np.ndarray, labels: np.ndarray, weight: np.ndarray, block: np.ndarray, q: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors, P(given label | label)) by expectation maximisation, with one distribution for each block."""
    names = np.unique(block)
    fired = np.stack([np.minimum(votes[:, block == b].sum(axis=1), 2) for b in names], axis=1) if len(names) else np.zeros((len(labels), 0))
    given = np.eye(2)
    for _ in range(rounds):
        mass = np.stack((weight * (1 - q), weight * q))
        whole = mass.sum(axis=1, keepdims=True)
        prior = np.clip(whole[1, 0] / whole.sum(), 1e-6, 1 - 1e-6)
        odds = np.full(len(labels), np.log(prior / (1 - prior)))
        for value in (0, 1, 2):
            rate = (mass @ (fired == value) + 0.1) / (whole + 0.3)
            odds += (fired == value) @ (np.log(rate[1]) - np.log(rate[0]))
        right = mass @ np.stack((labels == 0, labels == 1), axis=1)
        given = (right + np.array([[TRUST[0], TRUST[1]], [TRUST[1], TRUST[0]]])) / (whole + sum(TRUST))
        odds += np.log(given[1, labels]) - np.log(given[0, labels])
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        moved, q = np.abs(new - q).max(initial=0.0), new
        if moved < 1e-6:
            break
    return q, given


def fit(texts: list[str], labels: list[int], weights: dict[int, float] | None = None) -> Model | None:
    """A model of labelled texts."""
    if not texts:
        return None
    parts = list(read_words(pa.array(texts, pa.string())))
    counts = np.concatenate([np.diff(w.first) for _, w in parts])
    return fit_words(Words(np.concatenate([w.key for _, w in parts]), np.concatenate(([0], np.cumsum(counts))), np.concatenate([w.form for _, w in parts])), labels, weights)


def fit_words(words: Words, labels: list[int], weights: dict[int, float] | None = None) -> Model:
    """A model of the words of labelled texts."""
    key, y = words.key, np.array(labels)
    doc = np.repeat(np.arange(len(y)), np.diff(words.first))
    pair_key, pair_doc = np.unique(np.stack((key, doc.astype(np.uint64))), axis=1) if len(key) else (np.zeros(0, np.uint64),) * 2
    pair_doc = pair_doc.astype(np.int64)
    names, slot, held = np.unique(pair_key, return_inverse=True, return_counts=True)
    once = _first_of_copies(pair_key, pair_doc, held[slot], y)
    toxic = np.bincount(slot, once[pair_doc] & (y[pair_doc] == 1), len(names))
    other = np.bincount(slot, once[pair_doc] & (y[pair_doc] == 0), len(names))
    n1, n0 = max(1, (y[once] == 1).sum()), max(1, (y[once] == 0).sum())
    p1, p0 = (toxic + 0.01) / n1, (other + 0.5) / n0
    # how much better its own share explains a word's documents than the sample's does; so many words are tried that it must be far more
    share_, base = toxic / np.maximum(toxic + other, 1), n1 / (n1 + n0)
    gain = toxic * np.log(np.maximum(share_, 1e-12) / base) + other * np.log(np.maximum(1 - share_, 1e-12) / (1 - base))
    good = np.flatnonzero((toxic >= LEAST_DOCS) & (p1 >= LIFT * p0) & (gain >= np.log(max(len(names), 1)) + CERTAINTY))
    gain = gain[good]
    lexicon = np.sort(names[good[np.argsort(-gain, kind="stable")][:VOTERS]])
    weight = np.array([(weights or {}).get(int(v), 1.0) for v in y]) * once
    x = ballots(lexicon, words)
    q, _, block = label_model(x, y, weight)
    share = 1 / np.bincount(block, minlength=len(block))[block]
    return _classifier(lexicon, words, x, q, weight, share)


def _first_of_copies(key: np.ndarray, doc: np.ndarray, held: np.ndarray, y: np.ndarray, parts: int = 8, same: int = 5) -> np.ndarray:
    """Whether each document is the first of those with its label that have the same words, or agree in most of some minima over the less common ones."""
    once = np.ones(len(y), bool)
    sums, alike = np.zeros(len(y), np.uint64), set()
    np.add.at(sums, doc, mix(key))
    for d, mark in enumerate(zip(y.tolist(), sums.tolist(), strict=True)):
        once[d] = not mark[1] or mark not in alike
        alike.add(mark)
    rare = np.flatnonzero(once[doc] & (held <= max(4, 0.2 * len(y))))
    own = rare[np.argsort(doc[rare], kind="stable")]
    begin = np.searchsorted(doc[own], np.arange(len(y) + 1))
    full = np.flatnonzero(np.diff(begin) >= 20)
    if not len(full):
        return once
    minima = np.stack([np.minimum.reduceat(mix(key[own] + np.uint64(k + 1)), begin[full]) for k in range(parts)], axis=1)
    seen: dict[tuple[int, int, int], list[int]] = {}
    for d, least in zip(full.tolist(), minima.tolist(), strict=True):
        marks = [(int(y[d]), k, v) for k, v in enumerate(least)]
        near = [x for m in marks for x in seen.get(m, ())]
        if near and np.unique(near, return_counts=True)[1].max() >= same:
            once[d] = False
        else:
            for m in marks:
                seen.setdefault(m, []).append(d)
    return once


def _classifier(lexicon: np.ndarray, words: Words, x: np.ndarray, q: np.ndarray, weight: np.ndarray, share: np.ndarray, rounds: int = 300) -> Model:
    model = Model(lexicon, np.zeros(x.shape[1]), np.zeros(BUCKETS), float(np.log((np.average(q, weights=weight) + 1e-4) / (1 - np.average(q, weights=weight) + 1e-4))))
    n = words.sizes()
    slot, doc = _bucket(words.key), np.repeat(np.arange(len(n)), np.diff(words.first))
    times = np.ones(len(slot)) if words.times is None else words.times
    s_votes, s_buckets, s_bias = np.full(x.shape[1], 1e-8), np.full(BUCKETS, 1e-8), 1e-8
    weight = weight / weight.sum()
    for _ in range(rounds):
        gap = weight * (q - model.score(words))
        g = gap @ x * share - 1e-5 * model.votes
        g_buckets = np.bincount(slot, (gap / np.maximum(n, 1))[doc] * times, BUCKETS) - 1e-4 * model.buckets
        g_bias = gap.sum()
        s_votes, s_buckets, s_bias = s_votes + g * g, s_buckets + g_buckets**2, s_bias + g_bias**2
        model.votes += 0.5 * g / np.sqrt(s_votes)
        model.buckets += 0.05 * g_buckets / np.sqrt(s_buckets)
        model.bias += 0.2 * g_bias / np.sqrt(s_bias)
    return model


def train(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, chosen=None, sample: int = SAMPLE) -> Model | None:
    """A model of a bounded sample of the labelled documents that meet the condition."""
    own = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).filter("i IS NOT NULL AND y IN (0, 1)")
    own = own.filter(chosen) if chosen is not None else own
    own = own.groupBy("i").agg(F.max("y").alias("y"))
    sizes = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    hashed = F.xxhash64("i")
    parts = [own.filter(F.col("y") == y).orderBy(hashed, "i").limit(sample) for y in sizes]
    ids = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    picked = docs.sparkSession.createDataFrame(ids.collect(), ids.schema)
    texts = docs.select(F.col(doc_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, times, form = [], [], []
            for _, w in read_words(batch.column(2)):
                for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                    own, n = np.unique(w.key[a:b], return_counts=True)
                    keys.append(own.view(np.int64))
                    times.append(n)
                form += w.form.astype(np.int8).tolist()
            kinds = pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int8())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, k) for c, k in zip((keys, times, form), kinds, strict=True)]], names=["y", "h", "keys", "times", "form"])

    rows = texts.join(F.broadcast(picked), "i").select("y", F.xxhash64("i", "t").alias("h"), "t").mapInArrow(counted, "y int, h bigint, keys array<bigint>, times array<bigint>, form array<tinyint>")
    rows = rows.orderBy("h").limit(4 * sample)

    def learn(table: pa.Table) -> Model:
        y = table.column("y").to_pylist()
        flat = lambda c: table.column(c).combine_chunks()
        keys = flat("keys")
        first = np.concatenate(([0], np.cumsum(np.diff(keys.offsets.to_numpy()))))
        words = Words(keys.flatten().to_numpy().view(np.uint64), first, flat("form").flatten().to_numpy().reshape(-1, 3).astype(bool), flat("times").flatten().to_numpy())
        return fit_words(words, y, {k: n / y.count(k) for k, n in sizes.items() if k in y})

    return fitted(rows.select("y", "keys", "times", "form"), learn)


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for at, w in read_words(batch.column(1)) if held.value else ():
                out[at : at + len(w.first) - 1] = held.value.score(w)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, score double")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document with its score, learned from three quarters of the ids."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = "crc32(cast({} AS string)) % 4"
    model = train(docs, labels, "doc_id", "text", "toxic", F.expr(fold.format("i") + " <> 2"))
    found = score(docs, model)
    return found.select("doc_id", F.expr(f"coalesce({fold.format('doc_id')} = 2, true)").alias("held_out"), "score", F.expr(f"CASE WHEN score >= {THRESHOLD} THEN 1 ELSE 0 END").alias("predicted"))
