"""Exact substring dedup: every byte that lies in a string of ``length`` bytes which starts earlier as well.

Suffixes are ordered by column-wise multi-document construction: a collection of strings gets one symbol
of each string per round, from their ends to their beginnings; the order of the suffixes (the collection's
Burrows-Wheeler order) and the common prefixes of neighbours are updated from those of the round before.
Over whole documents that takes as many rounds as the longest has bytes, each over all that was inserted
so far. So the strings are not the documents but the places where a repeat can be:

1. Documents whose text is also that of an earlier one are repeats as a whole.
2. Each window of ``length`` bytes has an anchor, the one of its runs of ``GRAM`` bytes with the least
   hash. Equal windows have equal anchors at equal places, so only anchors that occur twice can matter.
3. Around each such anchor stands a string that holds every window with this anchor. Of strings that are
   equal as a whole (by two 64-bit hashes) all but the first are repeats. The different strings of one
   anchor, aligned at it, are a collection: a round inserts one column. Windows are equal if their suffixes
   are neighbours with common prefixes of ``length``; all but the first window of such a class are repeats.

A collection has at most ``GROUP`` strings, so a task's memory is bounded. The windows of a larger one are
grouped by their own digests (sums combined map-side, and a join of stored tables that Spark can split).

Matches never cross documents. Null and empty texts have no bytes. Ids are taken to be unique: of rows
that repeat an id with the same text each has the result that one of them would have, and if the texts differ,
the spans of all its rows count for each. Rows with a null id keep all their bytes and are no earlier place
for others. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, mix64, release, slices, stash, texts, unstash

#: Bytes of a repeat, and of the run that anchors it.
LENGTH, GRAM = 100, 32
#: Strings of a collection at most; strings and bytes that a task works on at a time.
GROUP, BLOCK, CHUNK = 2000, 40_000, 1 << 18
BROADCAST_IDS = 500_000


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over x[i : i + width] for every i that has so many."""
    out, have = x, 1
    while have * 2 <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = best(out[: len(out) - (width - have)], out[width - have :])
    return out


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of texts that stand one after the other and end at ``ends``."""
    n, width, places, hashes = len(data), length - gram + 1, [], []
    for start in range(0, n, CHUNK):
        low, high = max(0, start - length), min(n, start + CHUNK + 2 * length)
        part = data[low:high].astype(np.uint64) + np.uint64(1)
        if len(part) < length:
            continue
        h, have, factor = part, 1, 0x9E3779B97F4A7C15
        while have < gram:  # a power of two
            h = h[:-have] * np.uint64(factor) + h[have:]
            have, factor = have * 2, factor * factor & 0xFFFFFFFFFFFFFFFF
        h = mix64(h)
        least = _slide(h, width, np.minimum)
        at = np.arange(low, low + len(least))
        stop = ends[np.searchsorted(ends, at, "right")]
        least = np.where(at + length <= stop, least, np.uint64(0))
        most = _slide(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum)[: len(h)]
        found = np.flatnonzero((most == h) & (h > 0)) + low
        found = found[(found >= start) & (found < start + CHUNK)]
        places.append(found)
        hashes.append(h[found - low])
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def columnwise(strings: np.ndarray, group: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Which windows repeat an earlier string's: (strings, windows) of booleans.

    ``strings`` are rows of bytes, sorted by group and within it from early to late. A window that begins
    at column j is there if first <= j <= last.
    """
    n, width = strings.shape
    order, common = np.arange(n), np.zeros(n + 1, np.int64)
    common[1:n] = np.where(group[1:] == group[:-1], 0, -1)
    common[0] = -1
    repeats = np.zeros((n, width - length + 1), bool)
    rows = np.ascontiguousarray(strings.T)
    for j in range(width - 1, -1, -1):
        # A round: the symbol of this column goes in front of every suffix; equal symbols keep the suffixes' order.
        key = group[order] * 256 + rows[j][order]
        step = np.argsort(key, kind="stable")
        order, key = order[step], key[step]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        new = np.full(n + 1, 0, np.int64)
        if len(same):
            bounds = np.empty(2 * len(same), np.int64)
            bounds[0::2], bounds[1::2] = step[same - 1] + 1, step[same] + 1
            new[same] = np.minimum.reduceat(common, bounds)[::2] + 1
        common = new
        if j <= width - length:
            starts = np.flatnonzero(common[:n] < length)
            there = (first[order] <= j) & (j <= last[order])
            least = np.minimum.reduceat(np.where(there, order, n), starts)
            sizes = np.diff(np.append(starts, n))
            late = there & (order > np.repeat(least, sizes))
            repeats[order[late], j] = True
    return repeats


_digest = xxhash.xxh3_64_intdigest


def _runs(repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, last column) of the runs of true values."""
    edge = np.diff(np.pad(repeats, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    return row, a, b - 1


class Substrings:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, length: int, gram: int) -> None:
        if gram & (gram - 1) or gram > length:
            raise ValueError("the anchor's run must be a power of two and no longer than the window")
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        self.length, self.gram, self.side = length, gram, length - gram
        self.id_field, self.spark = self.docs.schema["id"], docs.sparkSession

    def _schema(self, *fields: tuple[str, T.DataType]) -> T.StructType:
        return T.StructType([self.id_field, *(T.StructField(*f) for f in fields)])

    def profile(self) -> DataFrame:
        schema = self._schema(("n_bytes", T.LongType()), ("sha", T.StringType()), ("key", T.BinaryType()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                t = texts(batch, "text")
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) for x in t], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in t]), pa.array([xxhash.xxh3_128_digest(x) for x in t], pa.binary())], names=schema.names)

        return self.docs.mapInArrow(run, schema)

    def anchor_rows(self, docs: DataFrame) -> DataFrame:
        """Each anchor with the size and a digest of the string around it: ``side`` bytes in front and ``length`` from its place on, as far as there are any."""
        length, gram, side = self.length, self.gram, self.side
        schema = self._schema(("place", T.IntegerType()), ("h", T.LongType()), ("size", T.IntegerType()), ("digest", T.LongType()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", 4 << 20):
                t = texts(batch, "text")
                ends = np.cumsum([len(x) for x in t])
                data = b"".join(t)
                at, h = anchors(np.frombuffer(data, np.uint8), ends, length, gram)
                doc = np.searchsorted(ends, at, "right")
                place = at - np.r_[0, ends[:-1]][doc]
                low, high = at - np.minimum(place, side), np.minimum(at + length, ends[doc])
                # The digest is seeded with where the anchor is in the string.
                digest = np.fromiter((_digest(data[a:b], p - a) for a, b, p in zip(low.tolist(), high.tolist(), at.tolist(), strict=True)), np.uint64, len(at))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc)), pa.array(place.astype(np.int32)), pa.array(h.view(np.int64)), pa.array((high - low).astype(np.int32)), pa.array(digest.view(np.int64))], names=schema.names)

        return docs.mapInArrow(run, schema)

    def strings(self, places: DataFrame) -> DataFrame:
        """The bytes of the strings around anchors."""
        length, side = self.length, self.side
        by_doc = places.groupBy("id").agg(F.collect_list(F.struct("place", "h", "digest")).alias("places"))
        joined = self.docs.join(by_doc, "id").select("id", "places", "text")
        schema = self._schema(("place", T.IntegerType()), ("h", T.LongType()), ("digest", T.LongType()), ("before", T.IntegerType()), ("body", T.BinaryType()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", 1 << 20):
                lists = batch.column("places")
                flat = lists.flatten()
                doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                place, t = flat.field("place").to_numpy(), texts(batch, "text")
                body = [t[d][max(0, p - side) : p + length] for d, p in zip(doc.tolist(), place.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc)), flat.field("place"), flat.field("h"), flat.field("digest"), pa.array(np.minimum(place, side).astype(np.int32)), pa.array(body, pa.binary())], names=schema.names)

        return joined.mapInArrow(run, schema)

    def collections(self, strings: DataFrame) -> DataFrame:
        """(id, start, end) of repeats, for collections of at most GROUP strings."""
        length, side = self.length, self.side
        width = length + side
        schema = self._schema(("start", T.IntegerType()), ("end", T.IntegerType()))

        def block(rows: pa.Table) -> pa.RecordBatch:
            ids = rows.column("id").combine_chunks()
            again = pc.and_(*(pc.equal(x.slice(1), x.slice(0, len(x) - 1)) for x in (ids, rows.column("digest").combine_chunks()))) if rows.num_rows > 1 else pa.array([], pa.bool_())
            h, place = rows.column("h").to_numpy(), rows.column("place").to_numpy()
            same = again.to_numpy(zero_copy_only=False) & (h[1:] == h[:-1]) & (place[1:] == place[:-1])
            rows = rows.filter(pa.array(np.r_[True, ~same]))  # one string for rows that repeat an id and text
            n = rows.num_rows
            bodies, before, place = rows.column("body").to_pylist(), rows.column("before").to_numpy(), rows.column("place").to_numpy().astype(np.int64)
            h = rows.column("h").to_numpy()
            sizes = np.fromiter(map(len, bodies), np.int64, n)
            matrix = np.zeros((n, width), np.uint8)
            flat = np.frombuffer(b"".join(bodies), np.uint8)
            row = np.repeat(np.arange(n), sizes)
            matrix[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + (side - before)[row]] = flat
            first, last = side - before.astype(np.int64), side - before + sizes - length
            group = np.cumsum(np.r_[0, h[1:] != h[:-1]])
            r, a, b = _runs(columnwise(matrix, group, first, last, length))
            return pa.RecordBatch.from_arrays([rows.column("id").combine_chunks().take(pa.array(r)), pa.array((place[r] - side + a).astype(np.int32)), pa.array((place[r] - side + b + length).astype(np.int32))], names=schema.names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            size = 0
            for batch in batches:
                held.append(batch)
                size += batch.num_rows
                if size >= BLOCK:  # the last group may go on in the next batch
                    rows = pa.Table.from_batches(held).combine_chunks()
                    h = rows.column("h").to_numpy()
                    cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
                    if cut:
                        yield block(rows.slice(0, cut).combine_chunks())
                    held = rows.slice(cut).to_batches()
                    size -= cut
            if size:
                yield block(pa.Table.from_batches(held).combine_chunks())

        return strings.repartition("h").sortWithinPartitions("h", "id", "place", "digest").mapInArrow(run, schema)

    def windows(self, strings: DataFrame) -> DataFrame:
        """(id, start, end) of repeats, whatever the size of a collection: every window by its own digest."""
        length, side = self.length, self.side
        schema = self._schema(("start", T.IntegerType()), ("digest", T.BinaryType()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "body", 1 << 18):
                doc, start, digest = [], [], []
                for i, (body, place) in enumerate(zip(batch.column("body").to_pylist(), batch.column("place").to_pylist(), strict=True)):
                    for j in range(len(body) - length + 1):
                        doc.append(i)
                        start.append(max(0, place - side) + j)
                        digest.append(xxhash.xxh3_128_digest(body[j : j + length]))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc, pa.int64())), pa.array(start, pa.int32()), pa.array(digest, pa.binary())], names=schema.names)

        rows = stash(strings.mapInArrow(run, schema), "windows")
        earliest = stash(rows.groupBy("digest").agg(F.min(F.struct("id", "start")).alias("f"), F.count("*").alias("k")).where("k > 1").select("digest", "f"), "earliest")
        return rows.join(earliest, "digest").where(F.struct("id", "start") > F.col("f")).select("id", "start", (F.col("start") + length).cast("int").alias("end"))

    def spans(self, docs: DataFrame) -> DataFrame:
        found = stash(self.anchor_rows(docs), "anchors")
        twice = stash(found.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "twice")
        release(self.spark)
        places = stash(found.join(twice.hint("shuffle_hash"), "h"), "places")
        unstash(found)
        release(self.spark)
        # Of strings that are equal as a whole the first goes on, the others repeat in all their windows.
        chief = stash(places.groupBy("h", "digest").agg(F.min(F.struct("id", "place")).alias("f"), F.count("*").alias("k")), "chief")
        start = F.col("place") - F.least("place", F.lit(self.side))
        whole = places.where(F.col("size") >= self.length).join(chief.where("k > 1").drop("k").hint("shuffle_hash"), ["h", "digest"]).where(F.struct("id", "place") > F.col("f"))
        parts = [stash(whole.select("id", start.cast("int").alias("start"), (start + F.col("size")).cast("int").alias("end")), "whole")]
        unstash(places)
        release(self.spark)
        # Different strings with one anchor are compared.
        left = stash(chief.groupBy("h").agg(F.count("*").alias("left")).where("left > 1"), "left")
        chiefs = stash(chief.join(left, "h").select("h", "digest", "left", "f.id", "f.place"), "chiefs")
        small, large = chiefs.where(F.col("left") <= GROUP), chiefs.where(F.col("left") > GROUP)
        strings = stash(self.strings(small), "strings")
        release(self.spark)
        parts.append(self.collections(strings))
        if not large.isEmpty():
            parts.append(self.windows(stash(self.strings(large), "strings")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def run(self) -> DataFrame:
        length = self.length
        profile = stash(self.profile(), "profile")
        earliest = stash(profile.where(F.col("id").isNotNull() & (F.col("n_bytes") >= length)).groupBy("key").agg(F.min("id").alias("rep")), "earliest")
        marked = stash(profile.join(earliest, "key", "left").withColumn("copy", F.coalesce(F.col("id") > F.col("rep"), F.lit(False))), "marked")
        copies = stash(marked.where("copy").select("id").distinct(), "copies")
        docs = self.docs.where(F.col("id").isNotNull() & (F.octet_length("text") >= length)).join(bounded(copies, BROADCAST_IDS), "id", "left_anti")
        spans = self.spans(docs).groupBy("id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
        spans = stash(spans, "spans")
        release(self.spark)
        # Only documents with a repeat in part are read again.
        partly = self.docs.join(spans, "id")
        schema = self._schema(("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha", T.StringType()), ("key", T.BinaryType()), ("removed", T.ArrayType(T.IntegerType(), False)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                cols: list[list] = [[] for _ in range(5)]
                for text, found in zip(texts(batch, "text"), batch.column("spans").to_pylist(), strict=True):
                    runs: list[list[int]] = []
                    for x in found:
                        a, b = x["start"], min(x["end"], len(text))
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(b, runs[-1][1])
                        elif a < b:
                            runs.append([a, b])
                    kept, at = hashlib.sha256(), 0
                    for a, b in runs:
                        kept.update(text[at:a])
                        at = b
                    kept.update(text[at:])
                    for c, v in zip(cols, (sum(b - a for a, b in runs), len(runs), kept.hexdigest(), xxhash.xxh3_128_digest(text), [x for r in runs for x in r]), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.list_(pa.int32()))], names=schema.names)

        partly = partly.select("id", "spans", "text").mapInArrow(run, schema).dropDuplicates(["id", "key"])
        all_of_it, none = F.col("copy"), hashlib.sha256().hexdigest()
        return marked.join(partly, ["id", "key"], "left").select(
            "id", "n_bytes",
            F.when(all_of_it, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(all_of_it, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(all_of_it, F.lit(none)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
            F.when(all_of_it, F.array(F.lit(0), F.col("n_bytes").cast("int"))).otherwise(F.coalesce("removed", F.array().cast("array<int>"))).alias("removed"),
        )


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``removed``, the bounds of the maximal removed runs."""
    return Substrings(docs, id_col, text_col, length, gram).run().withColumnRenamed("id", id_col)
