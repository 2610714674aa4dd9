"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its own hash and the hashes of its character n-grams, so a misspelling
shares most of its vectors with the word it comes from.  Word vectors are averaged over the
document and go through a linear softmax; both layers are trained together in numpy.  As the
average is linear, a trained model scores a word once: documents are means of word scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, ascii_words, give_back, id_remainder, kept, materialise

BUCKETS, DIM, SHORTEST, LONGEST = 1 << 16, 8, 3, 5
STORED, KNOWN = 4096, 30_000
#: Bytes of a word that is not long.  A long word, such as a passage without white space, is not
#: remembered and counts as a word for every so many bytes.
LONG = 64
#: Averages of few-percent signals are small; the gain brings them into the softmax's range.
GAIN = 10.0
#: Words without signal added to every text, so that a few odd words are little evidence.
SHRINK = 10
#: Labelled documents the classifier is fitted on at most.
SAMPLE = 8000
#: Bytes of their bags at most.
MOST = 1 << 28
#: Score of all texts where no label says that one is clean, so that nothing can be told apart.
UNKNOWN = 0.05
CUT = 0.3
EDGES = b".,;:!?\"'()[]{}<>*#&%$|/\\-_~`=+"


def weight(word: bytes) -> int:
    """How many words a word counts as."""
    return max(1, -(-len(word) // LONG))


def pieces(word: bytes) -> list[int] | np.ndarray:
    """Buckets of a word: the word itself and its n-grams of 3 to 5 characters with both edges."""
    core = word.strip(EDGES) or word
    text = f"<{core.decode('utf-8', 'replace').lower()}>"
    if len(word) > LONG:  # two bytes a bucket
        longer = (text[i : i + n].encode() for n in range(SHORTEST, LONGEST + 1) for i in range(len(text) - n + 1))
        return np.fromiter((zlib.crc32(g) % BUCKETS for g in chain([text.encode() + b"\0"], longer)), np.uint16)
    grams = [text.encode() + b"\0"]
    for n in range(SHORTEST, LONGEST + 1):
        grams += [text[i : i + n].encode() for i in range(len(text) - n + 1)]
    return [zlib.crc32(g) % BUCKETS for g in grams]


def csr(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *map(len, lists)])
    return np.fromiter((x for part in lists for x in part), np.int64, starts[-1]), starts


def bag(words: list[bytes], known: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares: the mean over words of the mean over their buckets.

    Thousands of bags are held at once, so they are stored in four bytes a bucket: shares are
    half-precision numbers times STORED.
    """
    own: dict[bytes, int] = {}
    for w in words:
        own[w] = own.get(w, 0) + 1
    if not own:
        return np.zeros(0, np.uint16), np.zeros(0, np.float16)
    if len(known) > KNOWN:
        known.clear()
    for w in own:
        if w not in known and len(w) <= LONG:
            known[w] = np.array(pieces(w), np.uint16)
    parts = [known[w] if len(w) <= LONG else pieces(w) for w in own]
    sizes = np.array([len(p) for p in parts])
    times = np.array([n * weight(w) for w, n in own.items()], float)
    shares = np.repeat(times / sizes / (times.sum() + SHRINK), sizes)
    buckets, place = np.unique(np.concatenate(parts), return_inverse=True)
    return buckets, (np.bincount(place, shares, len(buckets)) * STORED).astype(np.float16)


class Model:
    """Bucket vectors, each scaled by its rarity, and a two-class softmax, trained together.

    AdaGrad with one step size for each bucket lets rare, telling pieces move as far as common
    ones.  Buckets seen in one text only teach nothing and keep no vector.
    """

    def __init__(self, seed: int = 1):
        self.rng = np.random.default_rng(seed)
        self.vectors = (self.rng.standard_normal((BUCKETS, DIM)) * 0.01).astype(np.float32)
        self.softmax = (self.rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.rarity = np.zeros(BUCKETS, np.float32)

    def fit(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 4, rate: float = 0.5) -> "Model":
        """Learn from bags of texts and their labels, 0 or 1; without both labels only the bias is learnt."""
        toxic = (labels.sum() + 0.5) / (len(labels) + 1.0) if (labels == 0).any() else UNKNOWN
        self.bias = np.log(np.array([1 - toxic, toxic], np.float32))
        if not len(labels) or labels.min() == labels.max():
            return self
        seen = np.zeros(BUCKETS, np.int64)
        for buckets, _ in bags:
            seen[buckets] += 1
        self.rarity = np.where(seen > 1, GAIN * np.log((len(bags) + 1) / (seen + 1)), 0).astype(np.float32)
        squares = np.full(BUCKETS, 1e-8, np.float32)
        left = total = epochs * len(bags)
        for _ in range(epochs):
            for at in self.rng.permutation(len(bags)):
                buckets, shares = bags[at]
                step = rate * left / total
                left -= 1
                inputs, vectors = shares.astype(np.float32) / STORED * self.rarity[buckets], self.vectors[buckets]
                hidden = inputs @ vectors
                logits = hidden @ self.softmax + self.bias
                error = np.exp(logits - logits.max())
                error /= error.sum()
                error[labels[at]] -= 1
                back = self.softmax @ error
                squares[buckets] += (inputs * np.linalg.norm(back)) ** 2
                self.vectors[buckets] = vectors - step * (inputs / np.sqrt(squares[buckets]))[:, None] * back
                self.softmax -= 0.02 * step * np.outer(hidden, error)
                self.bias -= 0.02 * step * error
        return self

    def scorer(self) -> "Scorer":
        lean = (self.softmax[:, 1] - self.softmax[:, 0]).astype(np.float64)
        return Scorer((self.vectors.astype(np.float64) @ lean * self.rarity).astype(np.float32), float(self.bias[1] - self.bias[0]))


class Scorer:
    """Log-odds of documents; remembers those of at most ``bound`` words of at most LONG bytes."""

    def __init__(self, table: np.ndarray, bias: float, bound: int = 400_000):
        self.table, self.bias, self.bound, self.known = table, bias, bound, {}

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        buckets, starts = csr([pieces(w) for w in words])
        return np.add.reduceat(self.table[buckets].astype(np.float64), starts[:-1]) / np.diff(starts)

    def __call__(self, words: list[bytes]) -> float:
        if not words:
            return self.bias
        known, number = self.known, len(words)
        missing = list({w for w in words if w not in known})
        if missing:
            fresh = dict(zip(missing, self.word_scores(missing).tolist(), strict=True))
            if len(known) + len(fresh) > self.bound:
                known = {}
            total = sum([known[w] if w in known else fresh[w] if w in fresh else self.known[w] for w in words])
            for w in words:
                if len(w) > LONG:
                    total += fresh[w] * (weight(w) - 1)
                    number += weight(w) - 1
            self.known = known
            known.update((w, s) for w, s in list(fresh.items())[: self.bound] if len(w) <= LONG)
        else:
            total = sum([known[w] for w in words])
        return self.bias + total / (number + SHRINK)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = MOST) -> Model:
    """Fit on at most ``sample`` labelled documents, the first by a hash of their id.

    ``labels(doc_id, toxic)``; several labels of a document count as toxic if one does; null
    labels are no labels.  Of a repeated doc_id one row is used.  Whole texts are used, but as bags of
    buckets that executors make; of those the driver takes the first that fill ``most`` bytes.
    Unless labels of both kinds are found, all texts score alike: the rate of toxic labels, and UNKNOWN where
    there is none that is not toxic.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    place = F.xxhash64("doc_id")
    chosen = named.orderBy(place, "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    single = texts.join(chosen, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max_by("text", F.xxhash64("text")).alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        for batch in it:
            made = [bag(ascii_words(t), known) for t in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b.astype("<u2").tobytes() for b, _ in made], pa.binary()), pa.array([x.astype("<f2").tobytes() for _, x in made], pa.binary())], names=["place", "toxic", "buckets", "shares"])

    bags = materialise(single.select(place.alias("place"), "toxic", "text").mapInArrow(run, "place long, toxic int, buckets binary, shares binary"), "bags")
    total, last = 0, None
    for at, size in sorted(bags.select("place", F.length("buckets")).collect()):  # at most ``sample`` numbers
        total += 2 * size
        if total > most:
            break
        last = at
    rows = bags.filter(F.col("place") <= last if last is not None else F.lit(False)).toArrow()
    order = np.argsort(rows["place"].to_numpy()).tolist()
    pairs = [(np.frombuffer(b.as_buffer(), "<u2"), np.frombuffer(x.as_buffer(), "<f2")) for b, x in zip(rows["buckets"], rows["shares"], strict=True)]  # in place, not copied
    toxic = rows["toxic"].to_pylist()
    del rows
    model = Model().fit([pairs[i] for i in order], np.array([toxic[i] for i in order], int))
    del pairs
    give_back()  # else the driver holds the bags' memory as long as it lives
    return model


def _chances(texts: pa.Array, table: np.ndarray, bias: float, token: int) -> np.ndarray:
    """Probabilities of texts; the scorer and its memory stay with the worker."""
    scorer = kept(("toxicity", token), lambda: Scorer(table, bias))
    odds = np.array([scorer(ascii_words(t)) for t in as_bytes(texts)], float)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _shipped(scorer: Scorer) -> tuple[np.ndarray, float, int]:
    return scorer.table, scorer.bias, hash(scorer.table.tobytes()) ^ hash(scorer.bias)


def score(docs: DataFrame, scorer: Scorer, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of ``docs(doc_id, text, held_out)``; null text counts as empty."""
    model = _shipped(scorer)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            chance = _chances(batch.column("text"), *model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(chance), pa.array((chance >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "held_out").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text)``.

    Learns from labels of documents whose crc32(doc_id as text) mod 4 is not 2, and from their
    texts only.  Null ids count as the empty text there.  Null and empty texts get the bias.
    Without labels of both kinds all texts score alike, below the cut unless toxic labels are common (see ``train``).
    Repeated rows score alike; extra columns are ignored; an empty table gives an empty result.
    """
    held = id_remainder("doc_id", 4) == 2
    model = train(docs, labels.filter(~held), sample)
    return score(docs.select("doc_id", "text", held.alias("held_out")), model.scorer())


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score below ``cut``, with all their columns; learns from all labels."""
    model, at = _shipped(train(docs, labels, sample).scorer()), docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield batch.filter(pa.array(_chances(batch.column(at), *model) < cut))

    return docs.mapInArrow(run, docs.schema)
