"""Operators over texts one by one: exact answers, brute-force versions and round trips on small tables with nulls, empty and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, decontam, langid, licenses, lmscore, pii, toxicity
from millrace.llm.common import ALNUM_TABLE, connected_components, slices

ODD = [None, "", " ", "\n\t", "a", "É", "日本語", "x" * 5000, "word " * 3000, "\x00\x01", "Ａ１", "the same", "the same"]


def odd(spark, extra=(), clash=True):
    rows = [(i, t) for i, t in enumerate([*ODD, *extra])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # Names that operators use for their own columns.
    return df.withColumns({n: F.lit("mine") for n in ("score", "n_words", "spans", "masked", "hits", "lang_pred", "__text")}) if clash else df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_words():
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rnd = random.Random(1)
    for _ in range(500):
        text = "".join(rnd.choice("aZ09 _-.é日\x00\x7f [`{~") for _ in range(30))
        want = pattern.findall("".join(c.lower() if c.isascii() else c for c in text))
        assert [w.decode() for w in text.encode().translate(ALNUM_TABLE).split()] == want


def test_slices():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["abc", None, "", "defgh", "x"]})
    assert [b.column("t").to_pylist() for b in slices([batch], "t", 4)] == [["abc", None, ""], ["defgh"], ["x"]]


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        if a != b and p != q:
            parent[max(p, q)] = min(p, q)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {y for e in edges if e[0] != e[1] for y in e}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# BPE


@pytest.fixture(scope="module")
def word_bpe():
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return path, bpe.Tokenizer(f.read()), tokenizers.Tokenizer.from_file(path)


def test_bpe_like_library(word_bpe):
    _, own, lib = word_bpe
    rnd = random.Random(3)
    texts = [t or "" for t in ODD] + ["They'll I'M 12 <|endoftext|>x<|startoftext|> <|END|>", "ΑΣ ΣΑΣ İ ß ﬁ", "𝔘𝔫 👍🏽 á \x1c\x85 '''s", "a" * 40 + " hahahaha", "mississippi"]
    texts += ["".join(rnd.choice("abcdeinth'tsre ll…é1 ") for _ in range(60)) for _ in range(800)]
    for text in texts:
        want = lib.encode(text, add_special_tokens=False).ids
        raw, decoded = own.encode(text)
        assert np.frombuffer(raw, "<u4").tolist() == want, text
        assert decoded == own.decode(raw) == lib.decode(want, skip_special_tokens=False)


def test_bpe_automaton_against_merging():
    """A small merge list with merges of a token with itself and through other merges, against merging step by step."""
    rnd = random.Random(4)
    for _ in range(30):
        vocab, merges = list("abc"), []
        while len(merges) < 12:
            a, b = rnd.choice(vocab), rnd.choice(vocab)
            if a + b not in vocab:
                merges.append((a, b))
                vocab.append(a + b)
        own = bpe.Automaton({t: i for i, t in enumerate(vocab)}, merges, "")
        for _ in range(60):
            word = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14)))
            parts = list(word)
            for a, b in merges:
                k = 0
                while k < len(parts) - 1:
                    if parts[k] == a and parts[k + 1] == b:
                        parts[k : k + 2] = [a + b]
                    k += 1
            assert [vocab[i] for i in own.path(word)] == parts


def test_bpe_query(spark, word_bpe):
    path, own, _ = word_bpe
    got = {r.doc_id: r for r in bpe.encode_documents(odd(spark), path).collect()}
    for i, t in enumerate(ODD):
        raw, decoded = own.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256, got[i].decoded) == (len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded)
    assert bpe.encode_documents(empty(spark), path).count() == 0


# PII


def brute_spans(t):
    kinds = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for k, p in enumerate(kinds):
        for m in re.finditer(p, t):
            digits = re.sub(r"[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            fine = [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0, 9 <= len(digits) <= 15][k]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_plain_spans():
    rnd = random.Random(5)
    for _ in range(20_000):
        t = "".join(rnd.choice("ab@@..-+0123456789 ()%_x") for _ in range(rnd.randint(0, 60)))
        assert pii.plain_spans(t) == brute_spans(t), t


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john dot smith at example dot com now", "email", "john dot smith at example dot com"),
        ("x (at) host [dot] org!", "email", "x (at) host [dot] org"),
        ("call plus one five five five zero one two three four five six ok", "phone", "plus one five five five zero one two three four five six"),
        ("ｊｏｅ＠ｅｘａｍｐｌｅ.com", "email", "ｊｏｅ＠ｅｘａｍｐｌｅ.com"),
        ("card four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"),
        ("so jоe@exаmple.com it is", "email", "jоe@exаmple.com"),
    ],
)
def test_disguised(text, kind, found):
    extra = pii.disguised_spans(text, pii.plain_spans(text))
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in extra] == [(kind, found)]
    assert pii.masked(text, extra) == text.replace(found, f"<{kind.upper()}>")


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("to jane@example dot com please", "email", "jane@example dot com"),
        ("host 192 dot 168 dot 0 dot 1 is up", "ip", "192 dot 168 dot 0 dot 1"),
        ("ring + 4 1 5 5 5 5 2 6 one two now", "phone", "+ 4 1 5 5 5 5 2 6 one two"),
        ("ring +1 415 five five five 26 one two now", "phone", "+1 415 five five five 26 one two"),
        ("card 4111 one one one one 1111 1111 end", "card", "4111 one one one one 1111 1111"),
    ],
)
def test_disguised_without_other_hints(text, kind, found):
    extra = pii.disguised_spans(text, pii.plain_spans(text))
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in extra] == [(kind, found)]


def test_disguise_keeps_offsets():
    rnd = random.Random(6)
    for _ in range(2000):
        t = "".join(rnd.choice(["a", " at ", " dot ", "@", ".", "one ", "two ", "１", "е", "​", "(at)", "com", "5", "-"]) for _ in range(12))
        new = pii.rewritten(t)
        for s, _, e in pii.disguised_spans(t, pii.plain_spans(t)):
            assert 0 <= s < e <= len(t)
        if new is not None:
            at = [new.source(i) for i in range(len(new.text))]
            assert at == sorted(at) and all(0 <= x <= len(t) for x in at)


def test_pii_query(spark):
    df = odd(spark, ["write to a.b@c.de or 1.2.3.4", "nothing"])
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert (got[13].n_email, got[13].n_ip, got[13].spans) == (1, 1, "email:9:17,ip:21:28") and got[13].masked == "write to <EMAIL> or <IP>"
    assert got[0].masked is None and got[0].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    out = pii.redact(df)
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.collect()}[13] == "write to <EMAIL> or <IP>" and {r.masked for r in out.collect()} == {"mine"}
    assert pii.redact(empty(spark)).count() == 0


PLANTS = [  # an identifier, its kind, and the ways it may be disguised
    ("ann.lee@mail.example.org", "email", [lambda t: t.replace("@", " [at] ").replace(".", " (dot) "), lambda t: t.replace("@", " at ").replace(".example", " dot example"), lambda t: t.replace("a", "а"), lambda t: t.replace("@", "＠")]),
    ("203.0.113.77", "ip", [lambda t: t.replace(".", " dot "), lambda t: t.replace("1", "１").replace("7", "７"), lambda t: t.replace(".", "․")]),
    ("4111 1111 1111 1111", "card", [lambda t: t.replace(" ", "").replace("4", "four ").replace("1", "one ").strip(), lambda t: t.translate({48 + d: 0xFF10 + d for d in range(10)}), lambda t: t.replace("1111 1111", "1111\u200b 1111")]),
    ("+49 151 2345678", "phone", [lambda t: t.replace("2345678", "two three four five six seven eight"), lambda t: t.replace("+", "＋"), lambda t: t.translate({48 + d: 0x0660 + d for d in range(10)})]),
]


def test_planted_disguises(spark):
    """Every planted identifier is found where it stands, disguised or not, once; prose alone gives nothing."""
    rnd, rows, want = random.Random(21), [], {}
    prose = "we meet at noon near the dot on the map and one of two or three people will tell the seven of us about nine old books".split()
    for i in range(200):
        text, spans = " ".join(rnd.choices(prose, k=rnd.randint(0, 15))), []
        for _ in range(i % 4):
            plain, kind, ways = rnd.choice(PLANTS)
            said = rnd.choice([lambda t: t, *ways])(plain)
            text += " xx, "  # what stands before could otherwise be read as part of it
            spans.append(f"{kind}:{len(text)}:{len(text) + len(said)}")
            text += said + "; yy " + " ".join(rnd.choices(prose, k=rnd.randint(0, 9)))
        rows.append((i, text))
        want[i] = ",".join(spans)
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), mask=False).collect()}
    assert {i: (rows[i][1], x) for i, x in got.items() if x != want[i]} == {}


def brute_rewrite(text):
    """The transducers on one character or word at a time, for texts whose disguises are apart: (character, source start, source end)."""
    out, k = [], 0
    while k < len(text):
        dressed = re.match(r"\s{0,3}[(\[{<]\s?(at|dot)\s?[)\]}>]\s{0,3}", text[k:])
        if dressed and k and text[k - 1].isalnum() and text[k + dressed.end() :][:1].isalnum():
            out.append(("@" if dressed[1] == "at" else ".", k, k + dressed.end()))
            k += dressed.end()
            continue
        c = text[k]
        if c in pii._looks:
            out += [(x, k, k + 1) for x in pii._looks[c]]
        else:
            out.append((c, k, k + 1))
        k += 1
    return out


def test_rewriting_against_brute_force():
    rnd = random.Random(8)
    for _ in range(3000):
        t = "".join(rnd.choice(["ab", "c", " (at) ", "[dot]", "@", ".", "７", "е", "\u200b", "com", "5", "-", "; "]) for _ in range(14))
        own = brute_rewrite(t)
        new = pii.rewritten(t) or pii.Rewritten(t)
        # Homoglyphs are rewritten first, so a disguise may stand behind one; compare where none does.
        if not re.search(r"[\u200b７е]\s*[(\[]|[)\]]\s*[\u200b７е]", t):
            assert new.text == "".join(c for c, *_ in own), t
            assert [new.source(i) for i in range(len(own))] == [a for _, a, _ in own]
            for i, (_, _, b) in enumerate(own):  # characters without width may go with what stands before them
                assert new.source_end(i + 1) >= b and not t[b : new.source_end(i + 1)].strip("\u200b"), t


# Licenses


def test_licenses(spark):
    mit = "bla Permission is hereby granted free of charge, to any lucky person obtaining a copy of this software and associated documentation files the Software, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and or sell copies of the Software yes"
    df = odd(spark, [mit, "CC BY cc-by apache license x", "mit licenses, mit. LICENSE"])
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert len(got) == len(ODD) + 3
    assert (got[13].n_base, got[13].labels, got[13].score, got[13].first_word) == (0, "mit", 1.0, None) and (got[13].spans[0].first_word, got[13].spans[0].last_word) == (1, 50)
    assert (got[14].n_base, got[14].base_labels, got[14].first_word, got[14].last_word) == (3, "apache,cc-by", 0, 4)
    assert (got[15].n_base, got[15].first_word) == (1, 2)
    assert all((got[i].labels, got[i].score) == ("", 0.0) for i in range(len(ODD)))
    assert licenses.scan_licenses(empty(spark)).count() == 0


def brute_licenses(text, notices, k=4, near=6, cover=0.6):
    """All spans by comparing every run of words with every run of every notice, and a table for the common subsequence."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    words, out = split(text), []
    for t, (label, notice) in enumerate(notices):
        own = split(notice)
        votes = sorted((p - q, p) for p in range(len(words) - k + 1) for q in range(len(own) - k + 1) if words[p : p + k] == own[q : q + k])
        chains = []
        for d, p in votes:
            if not chains or d - chains[-1][-1][0] > min(near, (len(own) - 1) // 2):
                chains.append([])
            chains[-1].append((d, p))
        for c in chains:
            low, high = min(p for _, p in c), max(p for _, p in c) + k - 1
            row = [0] * (len(own) + 1)
            for w in words[low : high + 1]:
                new = [0]
                for j, x in enumerate(own):
                    new.append(row[j] + 1 if w == x else max(new[j], row[j + 1]))
                row = new
            if row[-1] / len(own) >= cover:
                out.append((label, t, low, high, round(row[-1] / len(own), 6)))
    return sorted(out)


def test_licenses_against_brute_force(spark):
    """Notices with words changed, put in, left out or repeated, among prose and each other; few of them hold a phrase."""
    rnd, texts = random.Random(11), []
    for _ in range(120):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            words = rnd.choice(licenses.NOTICES)[1].split()
            for _ in range(rnd.choice([0, 0, 1, 3, 8, 20])):
                i = rnd.randrange(len(words))
                words[i : i + 1] = rnd.choice([["other"], [], [words[i], "more", "words"]])
            parts += words * rnd.choice([1, 1, 1, 3, 7]) + rnd.choices("the of a this software license under any".split(), k=rnd.choice([0, 2, 30]))
        texts.append(" ".join(parts))
    texts += ["Released under the MIT License. " * 400, ODD[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    some = 0
    for r in licenses.scan_licenses(df).collect():
        want = brute_licenses(texts[r.doc_id], licenses.NOTICES)
        assert [tuple(x) for x in r.spans or ()] == want, texts[r.doc_id]
        assert r.labels == ",".join(sorted({x[0] for x in want} | set(filter(None, r.base_labels.split(",")))))
        assert r.score == (1.0 if r.n_base else max((x[4] for x in want), default=0.0))
        some += bool(want) and not r.n_base
    assert some > 20


# Decontamination


def brute_windows(docs, items, size=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    hit.update(range(k, k + n))
                    found |= own
        out[d] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_benchmark(spark, block):
    rnd = random.Random(7)
    say = lambda n: " ".join(rnd.choice("a b c d e".split()) for _ in range(n))
    items = [(f"i{k}", say(rnd.choice([0, 1, 4, 13, 20]) if k % 3 else 25)) for k in range(12)] + [("null", None), ("twice", say(15))]
    docs = [(i, t) for i, t in enumerate([*ODD, *(" ".join([say(40), rnd.choice(items)[1] or "", say(20)]) for _ in range(30))])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    want = brute_windows(docs, items)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontam.find_benchmark(df, bench, block_bytes=block).collect()}
    assert got == want
    kept = decontam.drop_contaminated(odd(spark), bench)
    assert kept.columns == odd(spark).columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(len(ODD)) if not brute_windows(docs, [x for x in items if len((x[1] or "").split()) >= 13])[i][1]}
    long_only = brute_windows(docs, [x for x in items if len((x[1] or "").split()) >= 13])
    assert {r.doc_id for r in decontam.drop_contaminated(df, bench).collect()} == {i for i, x in long_only.items() if not x[1]}
    assert {r.doc_id for r in decontam.drop_contaminated(df, bench, short_items=True).collect()} == {i for i, x in want.items() if not x[1]}
    none = decontam.find_benchmark(df, bench.limit(0))
    assert none.where("contaminated or n_hit > 0").count() == 0 and decontam.find_benchmark(empty(spark), bench).count() == 0


def test_longest_matches(spark):
    item = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, "x y " + item + " z")], "doc_id long, text string")
    r = decontam.find_benchmark(df, spark.createDataFrame([("q", item)], "item_id string, text string")).first()
    assert [tuple(m) for m in r.matches] == [("q", 0, 2, 30)] and r.hits == [2, 32]


# Language


def test_language(spark):
    rnd = random.Random(8)
    parts = {"en": ["the", "tion", "ing", "wh"], "fr": ["eau", "é", "que", "oi"], "de": ["sch", "ung", "ä", "keit"]}
    say = lambda l, n: " ".join("".join(rnd.choice(parts[l]) for _ in range(3)) for _ in range(n))
    rows = [(i, say(l := rnd.choice(list(parts)), rnd.randint(5, 60)), l) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, df.where("doc_id % 3 <> 1")).collect()}
    held = [(i, l) for i, _, l in rows if i % 3 == 1]
    assert sum(got[i].lang_pred == l for i, l in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in got.values())
    few = {r.doc_id: r for r in langid.identify(odd(spark), df).collect()}
    assert [few[i].lang_pred for i in (0, 1, 2, 3, 9)] == ["und"] * 5 and few[0].score == 0 and all(few[i].lang_pred in parts for i in (4, 5, 6))
    assert {r.lang_pred for r in langid.identify(df, df.limit(0)).collect()} == {"und"}
    assert langid.identify(empty(spark), df).count() == 0


def brute_language(model, text):
    """Every n-gram of the text on its own: which filters hold it, counted by language and corrected."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    found, total = np.zeros(len(model.langs)), 0
    for n in langid.ORDERS:
        for w in words:
            framed = w if n == 1 else f" {w} "
            for i in range(len(framed) - n + 1):
                if n > 1 and framed[i] == framed[i + n - 1] == " ":
                    continue
                h = np.uint64(0)
                with np.errstate(over="ignore"):
                    for k, c in enumerate(framed[i : i + n]):
                        h = h * np.uint64(0x100000001B3) + np.uint64(ord(c)) + np.uint64(k + 1)
                    mask = int(model.containing(langid.mix64(np.array([h], np.uint64)))[0])
                found += [(mask >> b) & 1 for b in range(len(model.langs))]
                total += 1
    right = np.maximum(0, found - total * model.wrong) / np.maximum(1e-9, 1 - model.wrong)
    best = int(right.argmax())
    return (model.langs[best], min(1.0, right[best] / total)) if words else ("und", 0.0)


@pytest.mark.parametrize("n", [3, 12])
def test_language_against_brute_force(spark, n):
    """Up to 8 languages and more than 8."""
    rnd = random.Random(n)
    letters = {f"l{k:02d}": rnd.sample("abcdefghijklmnopqrstuvwxyzäöüéñ", 9) for k in range(n)}
    say = lambda l, k: " ".join("".join(rnd.choices(letters[l], k=rnd.randint(1, 6))) for _ in range(k))
    rows = [(i, say(l := rnd.choice(list(letters)), rnd.randint(3, 40)), l) for i in range(40 * n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, "doc_id", "text", "lang")
    texts = [t for _, t, _ in rows[:20]] + ["a", "b c", "É!", "x1y", "", "--"]
    got = model.predict([t.encode() for t in texts])
    for t, lang, score in zip(texts, *got, strict=True):
        want = brute_language(model, t)
        assert lang == want[0] and score == pytest.approx(want[1])
    if n > 8:
        with pytest.raises(ValueError):
            langid.fit(spark.createDataFrame([(i, "a a", f"l{i}") for i in range(64)], "doc_id long, text string, lang string"), "doc_id", "text", "lang")


def test_bit_sliced_membership():
    rnd = np.random.default_rng(9)
    keys = rnd.integers(-(2**62), 2**62, 5000)
    members = {int(k): int(m) for k, m in zip(keys, rnd.integers(1, 8, 5000), strict=True)}
    f = langid.BitSliced(["a", "b", "c"], members)
    found = f.containing(keys.astype(np.uint64))
    assert all(int(g) & m == m for g, m in zip(found, members.values(), strict=True))
    other = f.containing(rnd.integers(-(2**62), 2**62, 20_000).astype(np.uint64))
    assert abs(np.mean(other & 1) - f.wrong[0]) < 0.01


# Toxicity


def test_toxicity(spark):
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choice(["tha", "en", "or", "is", "ul", "bra"]) for _ in range(3))
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = [word() for _ in range(rnd.randint(20, 120))]
        if bad:
            for k in range(1 + len(w) // 40):
                w[k * 7] = rnd.choice(["grumplefink", "zorgwit"]) if i % 10 else rnd.choice(["grumplefinks", "zorgwitz"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    seen = lab.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = toxicity.fit(df, seen)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(y) for i, y in held) >= 0.95 * len(held)
    few = toxicity.score(odd(spark), model)
    assert few.where("score between 0 and 1").count() == len(ODD)
    kept = toxicity.drop_toxic(odd(spark), model)
    assert kept.columns == odd(spark).columns and kept.count() == few.where("score < 0.5").count()
    for none, share in ((lab.limit(0), 0.0), (lab.where("toxic = 1"), 1.0)):
        assert {r.score for r in toxicity.score(df.limit(3), toxicity.fit(df, none)).collect()} == {share}
    assert toxicity.score(empty(spark), model).count() == 0


def test_toxicity_against_brute_force():
    """A trained model's score of a text, term by term: the mean over words of the mean over character n-grams; and the gradient of training by differences."""
    rnd = np.random.default_rng(2)
    model = toxicity.Model(rnd.normal(size=toxicity.ROWS).astype(np.float32), 0.3)
    for word in (b"a", b"word", "straße".encode(), b"x" * 300):
        framed = b"<" + word + b">"
        rows = [zlib.crc32(word)] + [zlib.crc32(framed[i : i + n]) for n in (3, 4, 5) for i in range(len(framed) - n + 1)]
        assert model.word(word) == pytest.approx(np.mean([float(model.odds[r % toxicity.ROWS]) for r in rows]), rel=1e-4)
    member, sizes, weight = np.array([0, 2, 2, 1, 0]), np.array([2, 0, 3]), rnd.normal(size=5).astype(np.float32)
    sums = toxicity.Sums(member, sizes, 3, weight)
    matrix = np.zeros((3, 3))
    for k, g in enumerate(np.repeat(np.arange(3), sizes)):
        matrix[g, member[k]] += weight[k]
    x = rnd.normal(size=(3, 2)).astype(np.float32)
    assert np.allclose(sums.forward(x), matrix @ x, atol=1e-5) and np.allclose(sums.backward(x), matrix.T @ x, atol=1e-5)


def test_toxicity_reads_whole_words():
    """The n-grams of a word past its first 64 bytes count, and those of a long run are the same in pieces."""
    rnd = random.Random(12)
    word = bytes(rnd.choice(b"abcdefgh\xe6\x97\xa5") for _ in range(70_000))
    for w in (word[:63], word[:100], word[:300], word):
        framed = b"<" + w + b">"
        want = [zlib.crc32(w), *(zlib.crc32(framed[i : i + n]) for n in (3, 4, 5) for i in range(len(framed) - n + 1))]
        rows = toxicity.bags([b"other", w])[0][len(toxicity.bags([b"other"])[0]) :].tolist()
        assert sorted(rows) == sorted(x & toxicity.ROWS - 1 for x in want)
    odds = np.zeros(toxicity.ROWS, np.float32)
    odds[zlib.crc32(b"zorg") & toxicity.ROWS - 1] = 1.0
    model = toxicity.Model(odds, 0.0)
    for n in (70, 300, 70_000):
        assert model.word(b"x" * n + b"zorg") > model.word(b"x" * n + b"nice")


# Language-model scores


def test_lm_scores(spark):
    docs = [(0, "a b a b c"), (1, "a b"), (2, None), (3, ""), (4, "c c c d"), (5, "zz")]
    df, wanted = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0,), (0,), (1,), (None,), (77,)], "doc_id long")
    model = lmscore.fit(df, wanted)
    got = {r.doc_id: r for r in lmscore.score(df, model).collect()}
    # The same by hand.
    words = {i: (t or "").split() for i, t in docs}
    vocabulary = sorted({w for x in words.values() for w in x})
    size = len(vocabulary) + 1

    def losses(ids):
        def of(chosen, scale):
            single = {w: scale * sum(words[i].count(w) for i in chosen) for w in vocabulary}
            pair = {}
            for i in chosen:
                for p in zip(words[i], words[i][1:], strict=False):
                    pair[p] = pair.get(p, 0) + scale
            total = sum(single.values())
            uni = {w: (single[w] + lmscore.EVEN) / (total + lmscore.EVEN * size) for w in vocabulary}
            loss = [-np.log(uni[ids[0]])] + [-np.log((pair.get((v, w), 0) + lmscore.PRIOR * uni[w]) / (single[v] + lmscore.PRIOR)) for v, w in zip(ids, ids[1:], strict=False)]
            return np.mean(loss)

        every = [i for i, _ in docs]
        scale = sum(len(words[i]) for i in (0, 1)) / sum(len(x) for x in words.values())
        return of([0, 1], 1.0), of(every, scale)

    for i, w in words.items():
        assert got[i].n_tokens == len(w)
        if w:
            t, b = losses(w)
            assert got[i].target_loss == pytest.approx(t, rel=1e-5) and got[i].background_loss == pytest.approx(b, rel=1e-5) and got[i].score == pytest.approx(t - b, rel=1e-4, abs=1e-6)
        else:
            assert (got[i].score, got[i].target_loss) == (0, 0)
    assert got[1].score < got[4].score
    bounded = lmscore.fit(df, wanted, vocabulary=2, pairs=1)
    assert bounded.size == 3 and len(bounded.keys) <= 1
    assert lmscore.score(empty(spark), lmscore.fit(empty(spark), wanted)).count() == 0


def test_lm_keeps_rare_words_and_pairs(spark):
    """More words than a bounded vocabulary has: those past its end, and pairs of them, are told apart; several buckets."""
    common = " ".join(f"w{i}" for i in range(20_000))
    docs = [(0, f"{common} {common}"), (1, f"{common} {common}"), (2, "rare pair"), (3, "odd couple"), (4, "pair rare"), (5, "rare pair")]
    df, wanted = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(2,)], "doc_id long")
    got = {r.doc_id: r for r in lmscore.score(df, lmscore.fit(df, wanted)).collect()}
    assert got[2].score < got[4].score < got[3].score and got[2].score == got[5].score
    assert [got[i].n_tokens for i in range(6)] == [40_000, 40_000, 2, 2, 2, 2]


def test_lm_odd_rows(spark):
    """Clashing names, repeated rows and ids, null ids, a very long text: every row has a score of its own text."""
    rows = [(1, "a b c"), (1, "a b c"), (1, "c c"), (None, "a b c"), (2, None), (3, "long " * 100_000), (4, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("score", "n_tokens", "word", "row", "id", "bucket")})
    got = lmscore.score(df, lmscore.fit(df, spark.createDataFrame([(4,)], "doc_id long")), carry=["doc_id", "text"]).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.text == "a b c"}) == 1
    assert sorted(r.n_tokens for r in got) == [0, 2, 3, 3, 3, 3, 100_000]


@pytest.mark.parametrize(("words", "heavy"), [(3, 20_000), (3, 1), (3, 4)])
def test_lm_buckets(spark, monkeypatch, words, heavy):
    """The buckets do not change the scores: one with all words light or heavy, or many."""
    rnd = random.Random(11)
    rows = [(i, " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 30)))) for i in range(60)]
    df, wanted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(0, 60, 4)], "doc_id long")
    bound = {r.doc_id: r for r in lmscore.score(df, lmscore.fit(df, wanted, vocabulary=1000, pairs=1000)).collect()}
    monkeypatch.setattr(lmscore, "BUCKET_WORDS", words)
    monkeypatch.setattr(lmscore, "HEAVY", heavy)
    whole = {r.doc_id: r for r in lmscore.score(df, lmscore.fit(df, wanted)).collect()}
    assert whole.keys() == bound.keys()
    for i, r in bound.items():
        assert whole[i].n_tokens == r.n_tokens and [whole[i].target_loss, whole[i].background_loss] == pytest.approx([r.target_loss, r.background_loss], rel=1e-5)


@pytest.mark.parametrize("heavy", [20_000, 1, 4])
def test_lm_parts_and_other_documents(spark, monkeypatch, heavy):
    """Documents get the scores of a bounded model that has all words, whether in one part or several, counted where they are scored or by the stored counts."""
    rnd = random.Random(13)
    rows = [(i, " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 30)))) for i in range(60)] + [(60, None), (61, "a b c"), (61, "a b c")]
    df, wanted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(0, 62, 4)], "doc_id long")
    other = spark.createDataFrame([*rows, (70, "new words a b"), (71, "a a a")], "doc_id long, text string")
    bound = lmscore.fit(df, wanted, vocabulary=1000, pairs=1000)
    want = {(r.doc_id, r.text): r for r in lmscore.score(other, bound).collect()}
    monkeypatch.setattr(lmscore, "BUCKET_WORDS", 50)
    monkeypatch.setattr(lmscore, "HEAVY", heavy)
    for most in (1, 1000):
        monkeypatch.setattr(lmscore, "PART_BUCKETS", most)
        model = lmscore.fit(df, wanted)
        for docs in (df, other):
            got = lmscore.score(docs, model).collect()
            assert len(got) == docs.count()
            for r in got:
                w = want[r.doc_id, r.text]
                assert r.n_tokens == w.n_tokens and [r.target_loss, r.background_loss] == pytest.approx([w.target_loss, w.background_loss], rel=1e-5)


def test_lm_sends_tokens_once(spark):
    """The bytes that are shuffled for documents scored by their own model: those of pairs once."""
    rnd = np.random.default_rng(14)
    rows = [(i, " ".join(f"w{k}" for k in rnd.integers(0, 30_000, 2000))) for i in range(400)]
    df, wanted = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).localCheckpoint(), spark.createDataFrame([(i,) for i in range(0, 400, 4)], "doc_id long")
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return {found.apply(i).stageId(): found.apply(i) for i in range(found.size())}

    before = stages()
    assert len(lmscore.score(df, lmscore.fit(df, wanted)).collect()) == 400
    new = [s for k, s in stages().items() if k not in before]
    # 800,000 pairs, hardly any of them twice, and 30,000 words.
    assert sum(s.shuffleWriteBytes() for s in new) < 800_000 * 20


def test_lm_rows_of_large_inputs():
    """A chunk has a row for each bucket: over 30 GB, 8,000,000,000 words, a row still has some hundred words."""
    rnd = np.random.default_rng(15)
    batches = (pa.RecordBatch.from_pydict({"text": [" ".join(f"w{k}" for k in rnd.integers(0, 30_000, 2000)) for _ in range(100)]}) for _ in range(12))
    chunk = max(sum(len(lmscore.alnum_words(x)) for x in lmscore.texts(b, "text")) for b in lmscore._chunks(batches))
    assert chunk * lmscore.BUCKET_WORDS / 8_000_000_000 > 200
