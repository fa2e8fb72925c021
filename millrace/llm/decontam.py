"""Benchmark decontamination with suffix arrays of the training text.

Every slice of a partition is a shard. Its suffix array holds the word positions from which a whole
window can still follow in words that some item has; no other suffix can match. Every window of every
item, that is every test suffix cut at the window's length, is searched in it by bisection. Matches
that follow each other on one diagonal make the longest verbatim matches.

The items go to the executors in blocks of a bounded size; each block costs one pass over the documents,
and nothing is shuffled. Null and empty texts have no words and are clean; an item without words has no
window, and one with a null id can't be named and counts as absent; repeated items and repeated documents
count each for itself; a very long text is a slice of its own; empty tables give empty results or clean documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, annotate, with_plain_names

WINDOW = 13
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 16 << 20

MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_start", T.IntegerType()), T.StructField("doc_start", T.IntegerType()), T.StructField("n_words", T.IntegerType())])
FIELDS = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()), ("hits", T.ArrayType(T.IntegerType(), False)), ("items", T.ArrayType(T.StringType(), False)), ("matches", T.ArrayType(MATCH, False))]


class Windows:
    """The distinct windows of a block of items, by length and sorted, with the places that have them."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.number: dict[bytes, int] = {}
        self.names = [i for i, _ in items]
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k, (_, text) in enumerate(items):
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in alnum_words(text)], ">u4")
            if len(ids):
                size = min(window, len(ids))
                rows = np.lib.stride_tricks.sliding_window_view(ids, size)
                parts.setdefault(size, []).append((np.ascontiguousarray(rows).view(f"S{4 * size}").ravel(), np.column_stack([np.full(len(rows), k), np.arange(len(rows))])))
        self.by_size = {}
        for size, found in parts.items():
            keys, places = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, places = keys[order], places[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            self.by_size[size] = (keys[first], np.r_[first, len(keys)], places)


def search(windows: Windows, docs: list[bytes]):
    """Per document: the number of words, and (item place, document place, size) of all matches found."""
    counts, runs, get = [], [], windows.number.get
    for text in docs:
        words = alnum_words(text)
        counts.append(len(words))
        runs.append(np.fromiter((get(w, 0) for w in words), np.uint32, len(words)))
        runs.append(np.zeros(1, np.uint32))  # no suffix crosses the end of its document
    word = np.concatenate(runs) if runs else np.zeros(0, np.uint32)
    starts = np.cumsum([0, *(c + 1 for c in counts)])
    gaps = np.flatnonzero(word == 0)
    reach = gaps[np.searchsorted(gaps, np.arange(len(word)))] - np.arange(len(word)) if len(word) else word
    out = []
    for size, (keys, first, places) in windows.by_size.items():
        at = np.flatnonzero(reach >= size)
        if not len(at):
            continue
        rows = word[at[:, None] + np.arange(size)].astype(">u4")
        suffixes = np.ascontiguousarray(rows).view(f"S{4 * size}").ravel()
        order = np.argsort(suffixes, kind="stable")  # the suffix array, to the depth of a window
        suffixes, at = suffixes[order], at[order]
        low, high = np.searchsorted(suffixes, keys, "left"), np.searchsorted(suffixes, keys, "right")
        for k in np.flatnonzero(high > low):
            out.append((at[low[k] : high[k]], places[first[k] : first[k + 1]], size))
    return counts, starts, out


def diagonals(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(item, item place, document place, size) of single windows, joined along diagonals to the longest matches."""
    out: list[tuple[int, int, int, int]] = []
    last = None
    for item, diagonal, start, size in sorted((i, d - p, d, s) for i, p, d, s in found):
        if last and last[:2] == (item, diagonal) and start <= last[2] + last[3]:
            last = (item, diagonal, last[2], max(last[3], start + size - last[2]))
        else:
            if last:
                out.append(last)
            last = (item, diagonal, start, size)
    if last:
        out.append(last)
    return [(i, d - g, d, n) for i, g, d, n in out]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Appends the columns of ``FIELDS`` to the documents.

    ``hits`` are the bounds (start, end, start, end, ...) of the runs of words inside an occurring window,
    ``items`` the sorted ids of items with occurring windows, ``matches`` the longest verbatim matches.
    A document is contaminated if hit words make up a twentieth of its words or more.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null and i is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    carry = list(docs.columns) if carry is None else carry
    new = {n.lower() for n, _ in FIELDS}
    out = docs.select(*[F.col(f"`{c}`") for c in carry if c.lower() not in new and c != text_col], F.col(f"`{text_col}`"))
    keep_text = text_col in carry
    spark = docs.sparkSession
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(sorted((r.i, r.t.encode()) for r in rows))
        out = _one_block(out, shared, text_col, window, first=k == 0, last=k == blocks - 1, keep_text=keep_text)
    return out


def _one_block(docs: DataFrame, shared, text_col: str, window: int, first: bool, last: bool, keep_text: bool) -> DataFrame:
    earlier = [] if first else ["hits", "items", "matches"]
    carry = [c for c in docs.columns if c not in earlier and (c != text_col or keep_text or not last)]
    if not first:  # what the blocks before have found travels in front of the text
        docs = docs.withColumn("__before", F.to_json(F.struct("hits", "items", "matches"))).drop(*earlier, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        carry = [c for c in docs.columns if c != "__before" and (c != text_col or keep_text or not last)]
        docs = docs.withColumn("__text2", F.concat(F.octet_length("__before").cast("string"), F.lit("\n"), "__before", F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
        return annotate(docs.drop("__before"), "__text2", FIELDS, lambda: _worker(shared, window, True), [c for c in carry])
    return annotate(docs, text_col, FIELDS, lambda: _worker(shared, window, False), carry)


def _worker(shared, window: int, before: bool):
    import json

    windows = Windows(shared.value, window)

    def work(texts: list[bytes], _valid) -> list:
        old = [{}] * len(texts)
        if before:
            for k, x in enumerate(texts):
                n, _, rest = x.partition(b"\n")
                old[k], texts[k] = json.loads(rest[: int(n)]), rest[int(n) :]
        counts, starts, found = search(windows, texts)
        marks: dict[int, list] = {}
        for at, places, size in found:
            for doc, p in zip((np.searchsorted(starts, at, "right") - 1).tolist(), at.tolist(), strict=True):
                marks.setdefault(doc, []).extend((int(i), int(q), p - int(starts[doc]), size) for i, q in places)
        cols: list[list] = [[] for _ in FIELDS]
        for k, n in enumerate(counts):
            own = marks.get(k, ())
            spans = sorted({(d, d + s) for _, _, d, s in own} | set(zip((b := old[k].get("hits", []))[::2], b[1::2], strict=True)))
            merged: list[list[int]] = []
            for s, e in spans:
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([s, e])
            items = sorted({windows.names[i] for i, *_ in own} | set(old[k].get("items", [])))
            matches = [{"item_id": windows.names[i], "item_start": q, "doc_start": d, "n_words": s} for i, q, d, s in diagonals(own)] + old[k].get("matches", [])
            hit = sum(e - s for s, e in merged)
            row = (n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0 and 20 * hit >= n, [x for m in merged for x in m], items, matches)
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        return cols

    return work


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, short_items: bool = False) -> DataFrame:
    """The documents, column for column, without those in which any window of any item occurs, however little of them it is.

    Items of fewer than ``window`` words are one short window, often a common phrase; they remove documents only with ``short_items``.
    """
    if not short_items:
        words = F.regexp_replace(F.col(item_text).cast("string"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
        benchmark = benchmark.where(F.size(F.split(F.trim(words), " ")) >= window)
    return with_plain_names(docs, text_col, lambda d, text: find_benchmark(d, benchmark, text, item_col, item_text, window).where("n_hit = 0"))
