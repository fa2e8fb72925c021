"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (3 to 5 bytes, framed; all of them, however long the word) and itself, hashed into 2^20 rows of an
embedding table, so that an unseen misspelling shares vectors with the words it resembles. A document is
the average of its words' vectors; a linear softmax over it gives the two classes. Table and softmax are
trained together, by full-batch Adam in numpy, on at most ``TRAIN_DOCS`` labelled documents taken by the
hash of their id; that bound holds whatever the input's size. Because a softmax over an average is linear
in the words, a trained model scores a word once and a document by a mean of its words' scores.

Null and empty texts, and texts without a word, have the score of the bias alone. Labels that are null are
left out; of repeated labels the highest counts. Without labels of both classes every score is the share
of toxic labels (0 without labels). Rows are independent; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, annotate, slices, texts, with_plain_names

TRAIN_DOCS = 5000
ROWS = 1 << 20
DIMS = 4
EPOCHS = 60
#: Places (distinct words of documents) in which a row of the table must occur to be learned.
MIN_SEEN = 8
#: Standard deviations by which a row's count in toxic documents must differ from what chance gives.
MIN_SIGMA = 4.0
RATE = 0.1
#: Decay of the table per step.
DECAY = 0.01
#: Averages of many words are small; the average times this goes into the softmax.
GAIN = 100.0
#: Bytes of words that are cut into n-grams at a time; words whose scores a task keeps.
PORTION, KNOWN = 1 << 18, 100_000

_crc = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _crc = np.where(_crc & 1, _crc >> 1 ^ np.uint32(0xEDB88320), _crc >> 1)


def ngrams(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of the embedding table, word) of what makes up each word: itself, then its framed character n-grams, by columns."""
    yield np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (ROWS - 1), np.arange(len(words))
    framed = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8)
    ends = np.cumsum(np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
    for low in range(0, len(framed), PORTION):  # more than once for a long word only
        start = np.arange(low, min(low + PORTION, len(framed)))
        owner = np.searchsorted(ends, start, "right")
        for n in (3, 4, 5):
            inside = start + n <= ends[owner]
            at, crc = start[inside], np.full(int(inside.sum()), 0xFFFFFFFF, np.uint32)
            for i in range(n):
                crc = _crc[(crc ^ framed[at + i]) & 255] ^ crc >> 8
            yield (~crc & np.uint32(ROWS - 1)).astype(np.int64), owner[inside]


def bags(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all words one after the other, and their number by word."""
    rows, sizes = [], []
    for part in portions(words):
        got = list(ngrams(part))
        row, owner = (np.concatenate(x) for x in zip(*got, strict=True))
        rows.append(row[np.argsort(owner, kind="stable")].astype(np.uint32))
        sizes.append(np.bincount(owner, minlength=len(part)))
    return np.concatenate(rows) if rows else np.zeros(0, np.uint32), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)


def portions(words: list[bytes]) -> Iterator[list[bytes]]:
    """The words, so many at a time that they have about ``PORTION`` bytes; a longer word stands alone."""
    sizes = np.cumsum([0, *map(len, words)])
    at = 0
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + PORTION)))
        yield words[at:end]
        at = end


class Sums:
    """Sums of rows by group, forwards and backwards, for groups given as a flat list."""

    def __init__(self, member: np.ndarray, sizes: np.ndarray, n_members: int, weight: np.ndarray) -> None:
        self.member, self.weight, self.n_members = member, weight[:, None], n_members
        self.full = np.flatnonzero(sizes > 0)
        self.starts = (np.cumsum(sizes) - sizes)[self.full]
        self.n_groups = len(sizes)
        self.group = np.repeat(np.arange(len(sizes)), sizes)
        self.order = np.argsort(member, kind="stable")
        ordered = member[self.order]
        self.back = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
        self.back_to = ordered[self.back]

    def forward(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n_groups, values.shape[1]), np.float32)
        if len(self.member):
            out[self.full] = np.add.reduceat(values[self.member] * self.weight, self.starts)
        return out

    def backward(self, grads: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n_members, grads.shape[1]), np.float32)
        if len(self.member):
            out[self.back_to] = np.add.reduceat((grads[self.group] * self.weight)[self.order], self.back)
        return out


class Model:
    """Per row of the table, what it adds to the log-odds of class 1; and the bias."""

    def __init__(self, odds: np.ndarray, bias: float) -> None:
        self.odds, self.bias = odds, bias

    def words(self, words: list[bytes]) -> np.ndarray:
        """The mean over each word's rows."""
        out = []
        for part in portions(words):
            total, count = np.zeros(len(part)), np.zeros(len(part))
            for rows, owner in ngrams(part):
                total += np.bincount(owner, self.odds[rows], len(part))
                count += np.bincount(owner, minlength=len(part))
            out.append(total / count)
        return np.concatenate(out) if out else np.zeros(0)

    def word(self, word: bytes) -> float:
        return float(self.words([word])[0])


def train(words: list[bytes], doc_words: np.ndarray, doc_counts: np.ndarray, sizes: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fits a model. ``doc_words`` and ``doc_counts`` hold the documents' distinct words one after the other, ``sizes`` of them each."""
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(ROWS, np.float32), np.inf if share == 1 else -np.inf)
    rng = np.random.default_rng(seed)
    flat, bag_sizes = bags(words)
    # Only rows that are clearly more frequent in one class are learned; the many others would only be learned by heart.
    toxic = np.bincount(doc_words, weights=np.repeat(labels, sizes), minlength=len(words))
    seen = np.bincount(doc_words, minlength=len(words)).astype(np.float64)
    in_toxic, in_all = (np.bincount(flat, weights=np.repeat(x, bag_sizes), minlength=ROWS) for x in (toxic, seen))
    expected = in_all * (toxic.sum() / max(seen.sum(), 1))
    often = (in_all >= MIN_SEEN) & (np.abs(in_toxic - expected) >= MIN_SIGMA * np.sqrt(np.maximum(expected, 0.5)))
    kept = often[flat]
    share = np.repeat((1 / np.maximum(bag_sizes, 1)).astype(np.float32), bag_sizes)[kept]
    bag_sizes = np.bincount(np.repeat(np.arange(len(words), dtype=np.int32), bag_sizes)[kept], minlength=len(words))
    used, flat = np.unique(flat[kept], return_inverse=True)
    # Words without such a row add nothing to an average but count in it.
    worth = np.flatnonzero(bag_sizes)
    to_word = Sums(flat, bag_sizes[worth], len(used), share)
    total = np.zeros(len(sizes))
    np.add.at(total, np.repeat(np.arange(len(sizes)), sizes), doc_counts)
    weight = (GAIN * doc_counts / np.repeat(np.maximum(total, 1), sizes)).astype(np.float32)
    place = np.full(len(words), -1, np.int64)
    place[worth] = np.arange(len(worth))
    there = place[doc_words] >= 0
    sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[there], minlength=len(sizes))
    to_doc = Sums(place[doc_words[there]], sizes, len(worth), weight[there])
    params = [rng.normal(0, 0.05, (len(used), DIMS)).astype(np.float32), rng.normal(0, 0.5, (DIMS, 2)).astype(np.float32), np.log(np.bincount(labels, minlength=2) / len(labels)).astype(np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    target = np.eye(2, dtype=np.float32)[labels]
    for step in range(1, epochs + 1):
        table, out, bias = params
        doc = to_doc.forward(to_word.forward(table))
        logits = doc @ out + bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        d = (p - target) / len(labels)
        grads = [to_word.backward(to_doc.backward(d @ out.T)), doc.T @ d, d.sum(axis=0)]
        for k, (param, g) in enumerate(zip(params, grads, strict=True)):
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            rate = RATE * min(1.0, 2 * (1 - (step - 1) / epochs))
            if k == 0:
                param *= 1 - DECAY
            param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    table, out, bias = params
    odds = np.zeros(ROWS, np.float32)
    odds[used] = table @ (out[:, 1] - out[:, 0]) * GAIN
    return Model(odds, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = TRAIN_DOCS) -> Model:
    """Learns from the documents that ``labels`` names, at most ``max_docs`` of them."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64(F.col("__id").cast("string"), F.lit("toxicity")), "__id").limit(max_docs)
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "__id").select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts = [Counter(alnum_words(x)) for x in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([list(c) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], names=["label", "words", "counts"])

    got = picked.mapInArrow(run, "label int, words array<binary>, counts array<int>").toArrow().combine_chunks()
    if not got.num_rows:
        return train([], np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    words = got.column("words").combine_chunks()
    coded = words.flatten().dictionary_encode()
    return train(coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), got.column("counts").combine_chunks().flatten().to_numpy().astype(np.float64), words.value_lengths().to_numpy().astype(np.int64), got.column("label").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score", carry: list[str] | None = None) -> DataFrame:
    """Appends the probability of class 1 of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        known: dict[bytes, float] = {}

        def work(batch: list[bytes], _valid) -> list:
            found = [alnum_words(x) for x in batch]
            new = list(set().union(*found).difference(known))
            known.update(zip(new, model.words(new).tolist(), strict=True))
            out = np.array([sum(map(known.__getitem__, x)) / len(x) if x else 0.0 for x in found])
            if len(known) > KNOWN:
                known.clear()
            with np.errstate(over="ignore"):
                return [pa.array(1 / (1 + np.exp(-(out + model.bias))))]

        return work

    return annotate(docs, text_col, [(name, T.DoubleType())], make, carry)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, column for column."""
    return with_plain_names(docs, text_col, lambda d, text: score(d, model, text).where(F.col("score") < threshold))
