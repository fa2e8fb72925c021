"""Language-model scoring by cross-entropy difference.

Two bigram models share one vocabulary, smoothing and order: the target model counts the documents
marked as wanted, the background model counts all documents, scaled to the target's number of words so
that the two are matched. A word's loss is its negative log probability after the word before it; a
document's score is the mean of the target's loss minus the background's, so lower means more like the target.

Counts cover every word and every pair of every document, and nothing counted is left out. Words and pairs are numbered
by 64-bit hashes. Tokens are dealt to buckets by their word, those of the at most ``HEAVY`` most frequent words by their
pair; a bucket has all that the counts and the losses of its tokens need. So the documents a model was fitted on are sent
once: their tokens are counted and scored in the same place, and the sums are brought back to their texts. For other
documents the counts are stored as a table, made when it is first needed, to which their tokens are sent likewise. The
number of buckets grows with the number of words counted, so that one fits into a task; many are worked on in parts.

``fit`` with ``vocabulary`` or ``pairs`` gives a bounded model instead, small enough to be broadcast: it keeps only the most
frequent words (the others are one unknown word) and pairs of known words (for others the smoothing decides).

Null and empty texts have no words and score 0. Documents without a mark, or marked twice, count as
wanted if any mark says so. Without wanted documents the target model is even over the vocabulary. An
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property, reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, alnum_words, annotate, bounded, give_back, mix64, release, slices, small_batches, stash, texts, unstash

#: Bounds of a bounded model of which only the other bound is given.
VOCABULARY = 20_000
PAIRS = 2_000_000
#: Words with at least this part of all words are dealt by pair; there can't be more of them.
HEAVY = 20_000
#: Words counted for each bucket; bytes and rows of text that are worked on at once (a row's number has 14 bits). A chunk
#: has a row for each bucket, so both are large: rows grow with the square of the input.
BUCKET_WORDS = 2_000_000
CHUNK_BYTES, CHUNK_ROWS = 8 << 20, 16_000
#: Buckets up to which all are worked on at once; parts in which more are worked on, at most.
PART_BUCKETS, PARTS = 128, 3
#: Words of which a task remembers the hashes.
MEMO = 200_000
#: Weight of the single-word model, as a number of words, and of every word in that model.
PRIOR, EVEN = 20.0, 0.5
#: Words that a task counts before it hands its counts on.
HOLD = 300_000
#: Counts above this are alike when the pairs to keep are chosen.
TELLING = 100_000
#: Marked documents up to this number are broadcast; more are joined by a shuffle.
BROADCAST_MARKS = 2_000_000

FIELDS = [("n_tokens", T.LongType()), ("target_loss", T.DoubleType()), ("background_loss", T.DoubleType()), ("score", T.DoubleType())]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for batch in slices(batches, "text"):
        for text in texts(batch, "text"):
            held.update(alnum_words(text))
            if len(held) > HOLD:
                yield flush()
    if held:
        yield flush()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of several batches together, about ``CHUNK_BYTES`` of text."""
    held, size, rows = [], 0, 0
    for batch in slices(batches, "text"):
        n = batch.column("text").nbytes
        if held and (size + n > CHUNK_BYTES or rows + batch.num_rows > CHUNK_ROWS):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size, rows = [], 0, 0
        held.append(batch)
        size, rows = size + n, rows + batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class Tokens:
    """The words of a chunk, one after the other: their numbers in ``words``, hashes of the chunk's distinct words; the rows they are in."""

    def __init__(self, found: list[bytes], memo: Memo) -> None:
        number: defaultdict = defaultdict(count().__next__)
        parts = []
        for text in found:
            words = alnum_words(text)
            parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.words = np.fromiter(map(memo.__getitem__, number), np.uint64, len(number))
        memo.trim()
        self.row = np.repeat(np.arange(len(parts), dtype=np.int32), self.sizes)


def _pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of pairs by those of their words; the word before a first one is 0."""
    return mix64(mix64(before) + word)


def _among(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is in the sorted keys, and whether it is."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _starts(*sorted_by: np.ndarray) -> np.ndarray:
    """Where stretches of equal numbers begin."""
    n = len(sorted_by[0])
    new = np.zeros(max(0, n - 1), bool)
    for x in sorted_by:
        new |= x[1:] != x[:-1]
    return np.flatnonzero(np.r_[np.ones(min(1, n), bool), new])


def _pack(x: np.ndarray) -> bytes:
    """Small numbers, compressed."""
    return len(x).to_bytes(8, "little") + pa.compress(x.tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, kind) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], n * np.dtype(kind).itemsize, "zstd"), kind)


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


_SENT = "bucket long, chunk long, a binary, b binary, n binary, pairs binary, place binary"
_COUNTS = "bucket long, pair binary, pt binary, pb binary, word binary, wt binary, wb binary"
_SUMS = "chunk long, a binary, b binary, n binary, sums binary"


def _as_batch(rows: list[list], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k == "long" else pa.binary()) for x, k in zip(columns, kinds, strict=True)], names=names)


class Whole:
    """Two matched bigram models over all words: number of words, totals, the counts of the heavy words, and where all others are counted from."""

    def __init__(self, docs: DataFrame, text_col: str, marked: DataFrame, buckets: int, size: int, totals: tuple[int, int], heavy: np.ndarray, heavy_counts: np.ndarray) -> None:
        self.docs, self.text_col, self.marked = docs, text_col, marked
        self.buckets, self.heavy, self.size = buckets, heavy, size
        self.scale = np.array([1.0, totals[0] / totals[1] if totals[0] and totals[1] else 1.0])
        self.total, self.heavy_counts = np.array(totals, float) * self.scale, heavy_counts
        self._counts: DataFrame | None = None

    @property
    def counts(self) -> DataFrame:
        """Counts of pairs and light words by bucket, as a stored table; only other documents than the model's own need it."""
        if self._counts is None:

            def merge(sent: pa.Table) -> pa.Table:
                bucket = sent.column("bucket")[0].as_py()
                if bucket < 0:
                    return pa.Table.from_batches([_as_batch([], _COUNTS)])
                own = Sent(sent)
                row = [bucket]
                for keys, counts in ((own.pair, own.pair_counts), (own.word, own.word_counts)):
                    order = np.argsort(keys, kind="stable")
                    first = order[_starts(keys[order])]
                    first = first[counts(1)[first] > 0]
                    row += [keys[first].tobytes(), *(_pack(counts(m)[first].astype(np.int64)) for m in (0, 1))]
                give_back()
                return pa.Table.from_batches([_as_batch([row], _COUNTS)])

            self._counts = stash(_send(self.marked, self, 0, 1).groupBy("bucket").applyInArrow(merge, _COUNTS), "ngrams")
            release(self.marked.sparkSession)
        return self._counts


def _fit_whole(docs: DataFrame, text_col: str, marked: DataFrame) -> Whole:
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(_hash, MEMO)
        for batch in _chunks(batches):
            tokens = Tokens(texts(batch, "text"), memo)
            mark = batch.column("marked").to_numpy()[tokens.row]
            t, b = np.bincount(tokens.ids[mark > 0], minlength=len(tokens.words)), np.bincount(tokens.ids, minlength=len(tokens.words))
            yield pa.RecordBatch.from_arrays([pa.array(tokens.words.view(np.int64)), pa.array(t), pa.array(b)], names=["word", "t", "b"])
        memo.clear()
        give_back()

    singles = stash(marked.select("text", "marked").mapInArrow(words, "word long, t long, b long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("b").alias("b")), "words")
    size, t, b = singles.agg(F.count("*"), F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    top = singles.where(F.col("b") >= max(1, -(-b // HEAVY))).toArrow()
    unstash(singles)
    heavy = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(heavy)
    heavy, heavy_counts = heavy[order], np.stack([top.column("t").to_numpy(), top.column("b").to_numpy()], axis=1).astype(float)[order]
    release(marked.sparkSession)
    # One more for the words that are in no document.
    return Whole(docs, text_col, marked, b // BUCKET_WORDS + 1, size + 1, (t, b), heavy, heavy_counts)


def _send(plain: DataFrame, model: Whole, part: int, parts: int) -> DataFrame:
    """The tokens of (text, __k0, __k1, marked) that belong to one part of the buckets, a row for each chunk and bucket.

    In a row are the distinct pairs, grouped by their last words: hashes of pairs and words, tokens of a pair, pairs of a
    word, and of every token the row of its text, whether that is marked and whether the token is its last.
    """
    heavy, buckets = model.heavy, model.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, base = Memo(_hash, MEMO), TaskContext.get().partitionId() << 32
        for number, batch in enumerate(_chunks(batches)):
            tokens = Tokens(texts(batch, "text"), memo)
            # A row of its own, in no bucket, has the documents of the chunk.
            keys = [batch.column(i).to_numpy().tobytes() for i in (1, 2)]
            rows = [[-1 - base - number, base + number, *keys, _pack(tokens.sizes), b"", b""]]
            ids, sizes, words = tokens.ids, tokens.sizes[tokens.sizes > 0], tokens.words
            ends = np.cumsum(sizes)
            # Number 0 is none before it.
            before = np.r_[np.zeros(min(1, len(ids)), np.int32), ids[:-1] + 1]
            before[ends - sizes] = 0
            hashes = np.r_[np.zeros(1, np.uint64), words]
            bucket = ((words >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)[ids]
            by_pair = np.flatnonzero(_among(heavy, words)[1][ids])
            bucket[by_pair] = (_pairs(hashes[before[by_pair]], words[ids[by_pair]]) >> np.uint64(20)) % np.uint64(buckets)
            place = tokens.row.astype(np.uint16) * np.uint16(4) + batch.column("marked").to_numpy().astype(np.uint16)[tokens.row] * np.uint16(2)
            place[ends - 1] += 1
            del tokens
            mine = np.flatnonzero(bucket % parts == part) if parts > 1 else slice(None)
            bucket, ids, before, place = bucket[mine], ids[mine], before[mine], place[mine]
            if len(words) < 1 << 24 and buckets < 1 << 15:
                order = np.argsort((bucket.astype(np.int64) << 24 | ids) << 24 | before)
            else:
                order = np.lexsort((before, ids, bucket))
            bucket, ids, before, place = bucket[order], ids[order], before[order], place[order]
            starts = _starts(bucket, ids, before)
            many = np.diff(np.r_[starts, len(ids)]).astype(np.uint32)
            pair = _pairs(hashes[before[starts]], words[ids[starts]])
            heads = _starts(bucket[starts], ids[starts])
            pairs_of = np.diff(np.r_[heads, len(starts)]).astype(np.uint32)
            word = words[ids[starts[heads]]]
            edges = _starts(bucket)
            cuts = np.stack([np.r_[edges, len(ids)], np.searchsorted(starts, np.r_[edges, len(ids)]), np.searchsorted(starts[heads], np.r_[edges, len(ids)])], axis=1)
            for k, (i, p, w), (j, q, v) in zip(bucket[edges].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                rows.append([k, base + number, pair[p:q].tobytes(), word[w:v].tobytes(), _pack(many[p:q]), _pack(pairs_of[w:v]), _pack(place[i:j])])
            del ids, before, bucket, order, place, pair, starts, many
            yield _as_batch(rows, _SENT)
        memo.clear()
        give_back()

    return plain.select("text", "__k0", "__k1", "marked").mapInArrow(run, _SENT)


class Sent:
    """The tokens of a bucket, as they were sent: pairs and words of all chunks one after the other."""

    def __init__(self, sent: pa.Table) -> None:
        column = lambda name: (x for part in sent.column(name).chunks for x in part.to_pylist())
        self.chunk = list(column("chunk"))
        pairs, words, pairs_of = [np.frombuffer(x, np.uint64) for x in column("a")], [np.frombuffer(x, np.uint64) for x in column("b")], [_unpack(x, np.uint32) for x in column("pairs")]
        self.many, self.place = [_unpack(x, np.uint32) for x in column("n")], list(column("place"))
        self.pair, self.word, self.pairs_of = _joined(pairs, np.uint64), _joined(words, np.uint64), _joined(pairs_of, np.uint32)
        self.ends = np.cumsum([len(x) for x in pairs])

    @cached_property
    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Marked and all tokens of every pair."""
        marked = [np.add.reduceat(_unpack(x, np.uint16) >> 1 & 1, np.cumsum(n, dtype=np.int64) - n, dtype=np.int32) for x, n in zip(self.place, self.many, strict=True)]
        return _joined(marked, np.int32), _joined(self.many, np.uint32)

    @cached_property
    def _same_pair(self) -> np.ndarray:
        return _numbered(self.pair)

    @cached_property
    def _same_word(self) -> np.ndarray:
        return _numbered(self.word)

    @cached_property
    def inner(self) -> np.ndarray:
        """A first word makes no pair."""
        return self.pair != _pairs(np.zeros(1, np.uint64), np.repeat(self.word, self.pairs_of))

    def pair_counts(self, m: int) -> np.ndarray:
        """Of every pair sent, how often it is in all chunks, in marked texts (0) or in all (1)."""
        return np.bincount(self._same_pair, weights=self.tokens[m] * self.inner)[self._same_pair]

    def word_counts(self, m: int) -> np.ndarray:
        starts = np.cumsum(self.pairs_of, dtype=np.int64) - self.pairs_of
        n = np.add.reduceat(self.tokens[m], starts, dtype=np.int64) if len(starts) else starts
        return np.bincount(self._same_word, weights=n)[self._same_word]


def _numbered(keys: np.ndarray) -> np.ndarray:
    """A number for every key, the same for equal ones."""
    order = np.argsort(keys)
    starts = _starts(keys[order])
    at = np.empty(len(keys), np.int32)
    at[order] = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.r_[starts, len(keys)]))
    return at


def _score_whole(docs: DataFrame, model: Whole, text_col: str, carry: list[str] | None) -> DataFrame:
    new = {n for n, _ in FIELDS}
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
    text = F.col(f"`{text_col}`").cast("string")
    keys = _text_keys(text)
    heavy, heavy_counts, scale, total, size = model.heavy, model.heavy_counts, model.scale, model.total, model.size
    # The model's own documents are counted where they are scored.
    own = docs is model.docs and text_col == model.text_col
    plain = model.marked if own else docs.select(text.alias("text"), *keys, F.lit(0).alias("marked"))
    plain = plain.where("text is not null")

    def answer(sent: pa.Table, counts: pa.Table | None) -> pa.Table:
        if sent.num_rows and sent.column("bucket")[0].as_py() < 0:
            return pa.Table.from_batches([_as_batch([[r["chunk"], r["a"], r["b"], r["n"], b""] for r in sent.to_pylist()], _SUMS)])
        got = Sent(sent)
        in_heavy, is_heavy = _among(heavy, got.word)
        found = {}
        for keys, wanted in (("pair", got.pair), ("word", got.word)) if counts is not None else ():
            found[keys] = _among(_joined([np.frombuffer(x, np.uint64) for x in counts.column(keys).to_pylist()], np.uint64), wanted)

        def stored(keys: str, name: str) -> np.ndarray:
            (at, there), values = found[keys], _joined([_unpack(x, np.int64) for x in counts.column(name).to_pylist()], np.int64)
            out = np.zeros(len(at))
            out[there] = values[at[there]]
            return out

        sums: list[list[np.ndarray]] = []
        # One model after the other, to hold less at once.
        for m in (0, 1):
            single = got.word_counts(m) if counts is None else stored("word", ("wt", "wb")[m])
            single[is_heavy] = heavy_counts[in_heavy[is_heavy], m]
            single *= scale[m]
            ends = got.pair_counts(m) if counts is None else stored("pair", ("pt", "pb")[m])
            ends *= scale[m]
            ends += np.repeat(PRIOR * (single + EVEN) / (total[m] + EVEN * size), got.pairs_of)
            np.negative(np.log(ends, out=ends), out=ends)
            # What a word adds as the one before another.
            begins = np.repeat(np.log(single + PRIOR), got.pairs_of)
            sums.append([])
            for many, packed, end in zip(got.many, got.place, got.ends.tolist(), strict=True):
                place, part = _unpack(packed, np.uint16), slice(end - len(many), end)
                sums[m].append(np.bincount(place >> 2, weights=np.repeat(ends[part], many) + np.repeat(begins[part], many) * (place & 1 == 0)))
        out: list[list] = []
        for chunk, packed, t, b in zip(got.chunk, got.place, *sums, strict=True):
            rows = np.flatnonzero(np.bincount(_unpack(packed, np.uint16) >> 2))
            out.append([chunk, None, None, rows.astype(np.uint16).tobytes(), np.stack([t[rows], b[rows]], axis=1).tobytes()])
        del got, single, ends, begins, sums
        give_back()
        return pa.Table.from_batches([_as_batch(out, _SUMS)])

    def gather_part(first: bool):
        def gather(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            head = next(r for r in rows if r["a"] is not None)
            n = _unpack(head["n"], np.int64)
            # The first word has none before it.
            loss = np.repeat(np.where(n > 0, np.log(PRIOR) * first, 0.0)[:, None], 2, axis=1)
            # In a fixed order, so that sums do not depend on the shuffle.
            for r in sorted((r for r in rows if r["a"] is None), key=lambda r: (r["n"], r["sums"])):
                loss[np.frombuffer(r["n"], np.uint16)] += np.frombuffer(r["sums"], np.float64).reshape(-1, 2)
            return pa.Table.from_arrays([pa.array(x) for x in (np.frombuffer(head["a"], np.int64), np.frombuffer(head["b"], np.int64), n, loss[:, 0].copy(), loss[:, 1].copy())], names=["__k0", "__k1", "n", "t", "b"])

        return gather

    spark = docs.sparkSession
    small_batches(spark)
    # Parts of the buckets one after the other: what a part sends is deleted before the next one, but for the documents' sums.
    parts = min(PARTS, -(-model.buckets // PART_BUCKETS))
    losses: list[DataFrame] = []
    for part in range(parts):
        asked = _send(plain, model, part, parts).groupBy("bucket")
        if own:
            sums = asked.applyInArrow(lambda sent: answer(sent, None), _SUMS)
        else:
            sums = asked.cogroup(model.counts.where(F.col("bucket") % parts == part).groupBy("bucket")).applyInArrow(answer, _SUMS)
        found = sums.groupBy("chunk").applyInArrow(gather_part(part == 0), "__k0 long, __k1 long, n long, t double, b double")
        if parts > 1:
            found = stash(found, "losses")
            release(spark)
        losses.append(found.withColumn("part", F.lit(part)))
    every = reduce(DataFrame.unionByName, losses)
    # Equal texts have equal losses.
    mean = lambda c: sum((F.max(F.when(F.col("part") == k, F.col(c))) for k in range(1, parts)), F.max(F.when(F.col("part") == 0, F.col(c)))) / F.greatest(F.max("n"), F.lit(1))
    means = every.groupBy("__k0", "__k1").agg(F.max("n").alias("__n"), mean("t").alias("__t"), mean("b").alias("__b"))
    kept = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(keep)], *keys)
    zero = lambda c, v: F.coalesce(c, F.lit(v))
    return kept.join(means, ["__k0", "__k1"], "left").select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(keep)],
        zero(F.col("__n"), 0).cast("long").alias("n_tokens"), zero(F.col("__t"), 0.0).alias("target_loss"), zero(F.col("__b"), 0.0).alias("background_loss"), zero(F.col("__t") - F.col("__b"), 0.0).alias("score"),
    )


def _text_keys(text: Column) -> list[Column]:
    """Equal texts have equal scores: sums are brought back by 128 bits of the text's hash."""
    return [F.xxhash64(text).alias("__k0"), F.xxhash64(F.lit("lm"), text).alias("__k1")]


class Pair:
    """Two matched bigram models over one vocabulary."""

    def __init__(self, words: list[bytes], single: np.ndarray, keys: np.ndarray, pairs: np.ndarray) -> None:
        """``single``: counts by word number (0: unknown words) and model (target, background); ``pairs``: likewise by ``keys``, sorted."""
        self.number = {w: i for i, w in enumerate(words, 1)}
        self.size = len(words) + 1
        totals = single.sum(axis=0)
        scale = np.array([1.0, totals[0] / totals[1] if totals[0] and totals[1] else 1.0])
        self.single = single * scale
        self.p = (self.single + EVEN) / (self.single.sum(axis=0) + EVEN * self.size)
        self.keys, self.pairs = keys, (pairs * scale).astype(np.float32)

    def losses(self, ids: np.ndarray) -> np.ndarray:
        """The losses of every word of a text, by model."""
        p = self.p[ids]
        if len(ids) > 1:
            before, key = ids[:-1], ids[:-1] * self.size + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            seen = self.pairs[at] * (self.keys[at] == key)[:, None] if len(self.keys) else np.zeros((len(key), 2))
            p[1:] = (seen + PRIOR * p[1:]) / (self.single[before] * (before > 0)[:, None] + PRIOR)
        return -np.log(p)


def fit(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int | None = None, pairs: int | None = None) -> Pair | Whole:
    """Counts all documents, and those with an id in ``wanted`` apart; whole, unless ``vocabulary`` or ``pairs`` bounds the model."""
    spark = docs.sparkSession
    marks = bounded(wanted.select(F.col(id_col).alias("__id")).where("__id is not null").distinct().withColumn("marked", F.lit(1)), BROADCAST_MARKS)
    marked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(marks, "__id", "left").select("text", *_text_keys(F.col("text")), F.coalesce("marked", F.lit(0)).alias("marked"))
    if vocabulary is None and pairs is None:
        small_batches(spark)
        return _fit_whole(docs, text_col, marked)
    vocabulary, pairs = VOCABULARY if vocabulary is None else vocabulary, PAIRS if pairs is None else pairs
    plain = docs.select(F.col(text_col).cast("string").alias("text"))
    words = plain.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = sorted(bytes(r.word) for r in words.orderBy(F.desc("n"), "word").limit(vocabulary).collect())
    size = len(top) + 1
    shared = spark.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = {w: i for i, w in enumerate(shared.value, 1)}.get
        for batch in slices(batches, "text", 24 << 20):
            keys, marked = [], []
            for text, mark in zip(texts(batch, "text"), batch.column("marked").to_pylist(), strict=True):
                found = alnum_words(text)
                ids = np.fromiter((get(w, 0) for w in found), np.int64, len(found))
                pair = ids[:-1] * size + ids[1:]
                # Negative keys are single words.
                keys += [-1 - ids, pair[(ids[:-1] > 0) & (ids[1:] > 0)]]
                marked += [np.full(len(x), mark, np.int64) for x in keys[-2:]]
            key, mark = np.concatenate(keys), np.concatenate(marked)
            both, n = np.unique(key * 2 + mark, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both >> 1), pa.array(np.where(both & 1, n, 0)), pa.array(n.astype(np.int64))], names=["key", "target", "background"])

    counts = marked.select("text", "marked").mapInArrow(run, "key long, target long, background long").groupBy("key").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    counts = stash(counts, "ngrams")
    # The least count that leaves at most `pairs` pairs, from the number of pairs by count.
    least, left = 1, pairs
    for n, many in sorted(((r.n, r["count"]) for r in counts.where("key >= 0").groupBy(F.least(F.col("background"), F.lit(TELLING)).alias("n")).count().collect()), reverse=True):
        left -= many
        if left < 0:
            least = n + 1
            break
    kept = counts.where((F.col("key") < 0) | (F.col("background") >= least)).toArrow()
    unstash(counts)
    key = kept.column("key").to_numpy()
    n = np.stack([kept.column("target").to_numpy(), kept.column("background").to_numpy()], axis=1).astype(np.float64).reshape(-1, 2)
    single = np.zeros((size, 2))
    single[-1 - key[key < 0]] = n[key < 0]
    order = np.argsort(key[key >= 0], kind="stable")
    return Pair(top, single, key[key >= 0][order], n[key >= 0][order])


def score(docs: DataFrame, model: Pair | Whole, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Appends ``n_tokens``, ``target_loss``, ``background_loss`` and ``score``, means per word."""
    if isinstance(model, Whole):
        return _score_whole(docs, model, text_col, carry)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        get = model.number.get

        def work(batch: list[bytes], _valid) -> list:
            counts, means = [], np.zeros((len(batch), 2))
            for k, text in enumerate(batch):
                found = alnum_words(text)
                counts.append(len(found))
                if found:
                    means[k] = model.losses(np.fromiter((get(w, 0) for w in found), np.int64, len(found))).mean(axis=0)
            return [counts, means[:, 0].tolist(), means[:, 1].tolist(), (means[:, 0] - means[:, 1]).tolist()]

        return work

    return annotate(docs, text_col, FIELDS, make, carry)
