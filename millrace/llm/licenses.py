"""License scans: exact phrases, and diagonal voting against license notices.

Every run of ``k`` words has a hash. Those that some template position has are joined to the positions;
each joined row votes for the diagonal (document position minus template position) of its template.
Votes are summed by diagonal, and neighbouring diagonals are merged, so that a few words put in or left
out don't split a match; how near they must be is limited by the template's length, so that copies
which follow each other stay apart. A span is verified word for word: it stays if the longest common
subsequence of its words and the template's covers enough of the template.

Templates are a fixed table of a few hundred positions, so the join broadcasts them whatever the
documents' size. Each slice first drops hashes that no template has; only voters, one short row per
document, and the texts of documents with voters go further. Null and empty texts have no words and no labels. Rows are
independent, so repeated rows and ties don't matter; a notice that is repeated in a text has a span for each place;
a very long text is a slice of its own; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ALNUM_TABLE, Memo, alnum_words, annotate, mix64, slices, stash

K = 4
#: Diagonals that are at most so far apart are merged, or less than half a template's words if that is less.
NEAR = 6
#: Share of a template's words that a span must have, in order.
COVER = 0.6

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# License notices and their labels.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "This text is available under the Creative Commons CC BY license."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
]

VOTER = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("gram", T.StringType())])
FIELDS = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_list", T.ArrayType(T.StringType(), False)), ("voters", T.ArrayType(VOTER, False)), ("kept_text", T.StringType())]


def word_hash(word: bytes) -> int:
    return zlib.crc32(word) | zlib.crc32(word, 0x5BD1E995) << 32


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of runs of k words, from the words' hashes."""
    n = len(words) - k + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(k if n > 0 else 0):
        out = out * np.uint64(0x100000001B3) + words[i : i + n]
    return mix64(out)


def templates(notices: list[tuple[str, str]], k: int) -> list[tuple[int, str, int, int, int, str]]:
    """(template, label, words, position, hash, gram) of all template positions."""
    out = []
    for t, (label, text) in enumerate(notices):
        words = alnum_words(text.encode())
        hashes = gram_hashes(np.array([word_hash(w) for w in words], np.uint64), k).astype(np.int64).tolist()
        out += [(t, label, len(words), p, h, b" ".join(words[p : p + k]).decode()) for p, h in enumerate(hashes)]
    return out


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(first word, label) wherever a phrase's words stand one after the other."""
    first: dict[bytes, list[tuple[list[bytes], str]]] = {}
    for p, label in phrases.items():
        w = p.encode().split()
        first.setdefault(w[0], []).append((w, label))
    return [(at, label) for at, w in enumerate(words) if w in first for p, label in first[w] if words[at : at + len(p)] == p]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES, k: int = K, near: int = NEAR, cover: float = COVER) -> DataFrame:
    """One row per document row: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score`` and ``spans``.

    ``spans`` are the verified matches (label, template, first word, last word, share of the template's words that stand there in
    order), sorted, or null. ``score`` is 1 where a phrase stands, otherwise the largest share, 0 without a span.
    """
    spark = docs.sparkSession
    table = templates(notices, k)
    wanted = np.unique(np.array([x[4] for x in table], np.int64).astype(np.uint64))
    sieve = np.zeros(1 << 16, bool)
    sieve[(wanted & np.uint64(0xFFFF)).astype(np.int64)] = True
    hints = {p.encode().split()[-1] for p in phrases}

    def make():
        hash_of = Memo(word_hash)

        def work(texts: list[bytes], _valid) -> list:
            cols: list[list] = [[] for _ in FIELDS]
            for text in texts:
                words = text.translate(ALNUM_TABLE).split()
                base = phrase_places(words, phrases) if any(h in text.lower() for h in hints) else []
                grams = gram_hashes(np.fromiter(map(hash_of.__getitem__, words), np.uint64, len(words)), k)
                at = np.flatnonzero(sieve[(grams & np.uint64(0xFFFF)).astype(np.int64)])
                at = at[np.isin(grams[at], wanted)]
                voters = [{"position": p, "hash": h, "gram": b" ".join(words[p : p + k]).decode()} for p, h in zip(at.tolist(), grams[at].astype(np.int64).tolist(), strict=True)]
                row = (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, sorted({x for _, x in base}), voters, text.decode() if voters else None)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            hash_of.trim()
            return cols

        return work

    scanned = stash(annotate(docs, text_col, FIELDS, make, [id_col]).withColumn("row", F.monotonically_increasing_id()), "licenses")
    positions = spark.createDataFrame([x[:1] + x[2:] for x in table], "template int, n_template int, place int, hash long, gram string")
    votes = scanned.select("row", F.explode("voters").alias("v")).select("row", "v.*").join(F.broadcast(positions), ["hash", "gram"])
    return _labelled(scanned, _verified(scanned, _spans(votes, near, k), notices, cover), id_col)


def _spans(votes: DataFrame, near: int, k: int) -> DataFrame:
    """(row, spans): places in a document that votes on merged diagonals say are a template's."""
    votes = votes.withColumn("diagonal", F.col("position") - F.col("place"))
    lines = votes.groupBy("row", "template", "n_template", "diagonal").agg(F.min("position").alias("low"), F.max("position").alias("high"))
    w = W.partitionBy("row", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(w)
    new = F.when(step <= F.least(F.lit(near), F.floor((F.col("n_template") - 1) / 2)), 0).otherwise(1)
    marked = lines.withColumn("new", new).withColumn("span", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    spans = marked.groupBy("row", "template", "span").agg(F.min("low").alias("low"), (F.max("high") + (k - 1)).cast("int").alias("high"))
    return spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("template", "low", "high"))).alias("spans"))


def common_words(words: list[bytes], places: dict[bytes, int], size: int) -> int:
    """Length of the longest common subsequence of ``words`` and a template of ``size`` words, whose words' places are bits."""
    full = (1 << size) - 1
    state = full
    for w in words:
        hit = state & places.get(w, 0)
        state = (state + hit | state - hit) & full
    return size - state.bit_count()


SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType()), T.StructField("share", T.DoubleType())])


def _verified(scanned: DataFrame, spans: DataFrame, notices: list[tuple[str, str]], cover: float) -> DataFrame:
    """(row, own, share, spans): the labels, the largest share and the spans that hold word for word."""
    known = []
    for label, text in notices:
        words, places = alnum_words(text.encode()), {}
        for i, w in enumerate(words):
            places[w] = places.get(w, 0) | 1 << i
        known.append((label, places, len(words)))

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("own", T.ArrayType(T.StringType())), T.StructField("share", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for batch in slices(batches, "kept_text"):
            out: list[tuple] = []
            for row, text, found in zip(*(batch.column(c).to_pylist() for c in ("row", "kept_text", "spans")), strict=True):
                words, good = alnum_words(text.encode()), []
                for x in found:
                    label, places, size = known[x["template"]]
                    share = common_words(words[x["low"] : x["high"] + 1], places, size) / size
                    if share >= cover:
                        good.append((label, x["template"], x["low"], x["high"], round(share, 6)))
                if good:
                    out.append((row, sorted({x[0] for x in good}), max(x[4] for x in good), [dict(zip(SPAN.names, x, strict=True)) for x in sorted(good)]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(kinds)], names=schema.names)

    return scanned.where("kept_text is not null").select("row", "kept_text").join(spans, "row").mapInArrow(run, schema)


def _labelled(scanned: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    none = F.array().cast("array<string>")
    joined = scanned.drop("voters", "kept_text").join(found, "row", "left")
    return joined.select(
        id_col, "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_list", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_list", F.coalesce("own", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        "spans",
    )
