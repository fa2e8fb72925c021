"""Language identification with bit-sliced Bloom filters over character n-grams.

Learning: relative frequencies of hashed n-grams (1 to 4 letters, or a blank and the letters at an end of a word) by language,
from about ``TRAIN_DOCS`` labelled documents of each language, taken by the hash of their id. N-grams that
are seen once in a language are noise and left out; of the others each language keeps its ``TOP_GRAMS`` most
frequent. Languages are told apart up to 63; more are refused with a ValueError. An n-gram belongs to every language in which it is at least ``SHARE`` times as frequent as where it is most
frequent. One table of 2^20 cells holds a mask of languages per cell: an n-gram sets its languages' bits
in ``PROBES`` cells, and the AND of the cells gives back all languages that contain it, and sometimes more.

Deciding: for every language, the n-grams of the text that it contains are counted. A filter that is
filled to a share f answers wrongly for f^PROBES of unknown n-grams; the counts are corrected for that.
The largest corrected count decides, ties go to the language that comes first by name; the score is its
share of all n-grams looked up.

Null texts and texts without a letter are ``und`` with score 0, and so is everything if there is nothing
to learn from. A text of any length is read whole. Rows are independent; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, mix64, slices, texts

ORDERS = (1, 2, 3, 4)
PROBES = 2
CELLS = 1 << 20
SHARE = 0.4
#: Labelled documents of a language to learn from, about; and n-grams kept of a language at most.
TRAIN_DOCS = 4000
TOP_GRAMS = 60_000

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(batch: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order, the hashes of the n-grams and the text of each; and the letters of each text."""
    low = [x.decode().lower() for x in batch]
    sizes = np.array([len(x) + 2 for x in low], np.int64)
    code = np.frombuffer(" ".join(["", *(f"{x} " for x in low), ""])[0:].encode("utf-32-le"), np.uint32)[: int(sizes.sum()) + 1]
    owner = np.repeat(np.arange(len(low)), sizes)
    owner = np.r_[owner, len(low) - 1] if len(low) else owner
    alpha = letter_table()[code]
    count = np.bincount(owner[alpha], minlength=len(low))
    # Runs of anything else count as one blank, and every text begins with one of its own.
    keep = alpha | np.r_[True, alpha[:-1]] | np.r_[True, owner[1:] != owner[:-1]]
    code, owner, alpha = np.where(alpha, code, 32)[keep].astype(np.uint64), owner[keep], alpha[keep]
    out = []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        size = len(code) - n + 1
        if size <= 0:
            break
        h = h[:size] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            # A blank stands at one end of an n-gram at most, and an n-gram belongs to one text.
            good = alpha[:size] if n == 1 else (alpha[:size] | alpha[n - 1 :]) & (owner[:size] == owner[n - 1 :])
            for i in range(1, n - 1):
                good = good & alpha[i : size + i]
            out.append((mix64(h[good]), owner[:size][good]))
    return out, count


class BitSliced:
    """Bloom filters of up to 63 languages in one table."""

    def __init__(self, langs: list[str], members: dict[int, int]) -> None:
        self.langs = langs
        kind = next(t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(langs) <= n)
        self.table = np.zeros(CELLS, kind)
        keys = np.fromiter(members.keys(), np.int64, len(members)).astype(np.uint64)
        masks = np.fromiter(members.values(), np.uint64, len(members)).astype(kind)
        for p in range(PROBES):
            np.bitwise_or.at(self.table, self.cell(keys, p), masks)
        self.wrong = np.array([np.mean((self.table >> kind(b)) & kind(1)) ** PROBES for b in range(len(langs))])

    @staticmethod
    def cell(h: np.ndarray, probe: int) -> np.ndarray:
        return ((h >> np.uint64(20 * probe)) & np.uint64(CELLS - 1)).astype(np.int64)

    def containing(self, h: np.ndarray) -> np.ndarray:
        """The mask of languages containing each n-gram."""
        out = self.table[self.cell(h, 0)]
        for p in range(1, PROBES):
            out &= self.table[self.cell(h, p)]
        return out

    def predict(self, batch: list[bytes]) -> tuple[list[str], list[float]]:
        n, found = len(batch), np.zeros((len(batch), len(self.langs)))
        total = np.zeros(n)
        parts, letters = grams(batch)
        for h, owner in parts:
            mask = self.containing(h)
            total += np.bincount(owner, minlength=n)
            # Two n-grams in one number: a mask and its text, counted together.
            if len(self.langs) <= 8:
                both = np.bincount(owner * 256 + mask, minlength=n * 256)[: n * 256].reshape(n, 256)
                for b in range(len(self.langs)):
                    found[:, b] += both[:, (np.arange(256) >> b & 1) == 1].sum(axis=1)
            else:
                for b in range(len(self.langs)):
                    found[:, b] += np.bincount(owner[(mask >> mask.dtype.type(b)) & mask.dtype.type(1) == 1], minlength=n)
        right = np.maximum(0, found - total[:, None] * self.wrong) / np.maximum(1e-9, 1 - self.wrong)
        best = right.argmax(axis=1) if len(self.langs) else np.zeros(n, int)
        ok = (letters > 0) & (len(self.langs) > 0)
        score = np.clip(right[np.arange(n), best] / np.maximum(total, 1), 0, 1) if len(self.langs) else np.zeros(n)
        return [self.langs[b] if k else "und" for b, k in zip(best, ok, strict=True)], np.where(ok, score, 0.0).tolist()


def fit(train: DataFrame, id_col: str, text_col: str, lang_col: str) -> BitSliced:
    """Learns from rows whose language is not null."""
    train = train.where(F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in train.groupBy(lang_col).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return BitSliced([], {})
    if len(langs) > 63:
        raise ValueError("more than 63 languages")
    # About TRAIN_DOCS documents of each language, by the hash of their id.
    odds = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, TRAIN_DOCS / sizes[k])))]), F.col(lang_col))
    picked = train.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("langid")), F.lit(1 << 20)) < odds * (1 << 20)).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    number = {k: i for i, k in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()])
            parts, _ = grams(texts(batch, "text"))
            for b in np.unique(lang):
                keys, n = np.unique(np.concatenate([h[lang[o] == b] for h, o in parts]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), b), pa.int32()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counts = picked.mapInArrow(run, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(total), "lang").withColumn("rate", F.col("n") / F.col("total"))
    by_gram = rates.groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("lang", "rate")).alias("in"))
    mask = F.aggregate("in", F.lit(0).cast("long"), lambda a, x: F.when(x["rate"] >= SHARE * F.col("most"), a + F.pow(F.lit(2.0), x["lang"]).cast("long")).otherwise(a))
    # Each language keeps its own most frequent ones, so none is crowded out by others with more text.
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("rate"), "gram"))
    top = rates.withColumn("place", place).where(F.col("place") <= TOP_GRAMS).select("gram").distinct()
    kept = by_gram.select("gram", mask.alias("mask")).join(top, "gram", "left_semi")
    return BitSliced(langs, {r.gram: r.mask for r in kept.collect()})


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """Appends ``lang_pred`` and ``score``. Only ``train`` gives languages; of ``docs``, only the text counts."""
    model = docs.sparkSession.sparkContext.broadcast(fit(train, id_col, text_col, lang_col))

    def make():
        def work(batch: list[bytes], _valid) -> list:
            return list(model.value.predict(batch))

        return work

    return annotate(docs, text_col, [("lang_pred", T.StringType()), ("score", T.DoubleType())], make, carry)
