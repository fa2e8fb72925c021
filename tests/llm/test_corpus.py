"""Operators over whole tables against brute-force versions: the Jaccard join, substring dedup, embedding near-dedup, and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.llm import embeddings, jaccard, pii, substrings, toxicity
from test_small import brute_windows

DATA = "/root/testdata/sf0.001"


class Groups:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def link(self, a, b):
        p, q = self.find(a), self.find(b)
        if p != q:
            self.parent[max(p, q)] = min(p, q)


def shingles(text, n):
    words = (text or "").encode().lower().split()
    k = min(n, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else frozenset()


def brute_jaccard(docs, n, percent):
    sets, groups, lists = [], Groups(), {}
    for a, (i, t) in enumerate(docs):
        own = shingles(t, n)
        sets.append((i, own))
        common = Counter(b for e in own for b in lists.get(e, ()))
        for b, k in common.items():
            if 100 * k >= percent * (len(own) + len(sets[b][1]) - k):
                groups.link(i, sets[b][0])
        for e in own:
            lists.setdefault(e, []).append(a)
    return {i: (len(x), groups.find(i)) for i, x in sets}


def near_texts(seed, groups=60):
    rnd, docs = random.Random(seed), []
    for _ in range(groups):
        base = [rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randint(1, 3) for _ in range(rnd.choice([0, 1, 2, 3, 5, 6, 8, 10, 13, 17, 25, 40, 120]))]
        for _ in range(rnd.choice([1, 1, 2, 4, 25])):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                if words:
                    k = rnd.randrange(len(words))
                    words[k : k + 1] = rnd.choice([["zz"], [], [words[k], "qq"]])
            docs.append((len(docs), rnd.choice([" ", "\t", "\n "]).join(words)))
    return [*docs, (len(docs), None), (len(docs) + 1, "")]


@pytest.mark.parametrize(("n", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (1, 70, 3)])
def test_jaccard(spark, n, percent, seed):
    docs = near_texts(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("mine"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df, n, percent).collect()}
    assert got == brute_jaccard(docs, n, percent)


def loose_group(seed, members, words=150, edits=(1, 2, 3, 4, 5)):
    """Copies of one text, most of them with too many changes to link with each other."""
    rnd = random.Random(seed)
    base, docs = [f"w{rnd.randrange(5000)}" for _ in range(words)], []
    for i in range(members):
        own = list(base)
        for k in rnd.sample(range(words), rnd.choice(edits)):
            own[k] = f"x{rnd.randrange(10**6)}"
        docs.append((i, " ".join(own)))
    return docs


@pytest.mark.parametrize(("short", "piece", "elements"), [(2, 2048, 1 << 20), (4, 40, 9000)])
def test_jaccard_sweeps(spark, monkeypatch, short, piece, elements):
    """Groups whose members mostly don't link, swept in tasks, whole or in pieces."""
    for name, value in (("SHORT", short), ("PIECE", piece), ("PIECE_ELEMENTS", elements), ("PAIRS_PER_ENTRY", 0)):
        monkeypatch.setattr(jaccard, name, value)
    docs = loose_group(short, 150) + [(i + 1000, t) for i, t in loose_group(9, 60, 80, (0, 1, 2, 3))]
    join = jaccard.Join(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85)
    assert {r.id: (r.n_shingles, r.component_id) for r in join.run().collect()} == brute_jaccard(docs, 4, 85)


def test_jaccard_odd_rows(spark):
    """Ids repeated with the same and with other texts, null ids, clashing names, a very long text, an empty table."""
    near, far, long = " ".join(f"w{i}" for i in range(60)), "something else that stands alone here", " ".join(f"v{i % 7001}" for i in range(60_000))
    rows = [(1, near), (2, near + " end"), (2, far), (3, far), (3, far), (4, "no copy of anything at all"), (5, None), (6, ""), (None, near), (None, "nowhere else to be found at all"), (7, long), (8, long + " z"), (4, "and another text under a known id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit("mine") for x in ("id", "__id", "__gone", "__node", "component_id", "n", "key")})
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.jaccard_groups(df).collect())
    sizes = {t: len(shingles(t, 5)) for _, t in rows}
    root = {near: 1, near + " end": 1, far: 2, long: 7, long + " z": 7}
    assert got == sorted((i or 0, sizes[t], root.get(t, i or 0)) for i, t in rows)
    kept = jaccard.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, near), (2, far), (4, rows[5][1]), (4, rows[12][1]), (5, ""), (6, ""), (0, near), (0, rows[9][1]), (7, long)])
    assert jaccard.drop_near_copies(df.limit(0)).count() == 0 and jaccard.jaccard_groups(df.limit(0)).count() == 0


def test_parity_bits():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 60, 65, 900):
        a = rnd.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n // 2], rnd.integers(0, 2**63, n // 3).astype(np.uint64)])
        x, y = (np.frombuffer(jaccard.parity_bits(v), np.uint64) for v in (a, b))
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        apart = int(np.bitwise_count(x ^ y).sum())
        assert apart <= len(set(a.tolist()) ^ set(b.tolist())) and apart % 2 == (len(a) + len(b)) % 2


def test_jaccard_boundary_and_subsets():
    for percent in (70, 80, 85, 95):
        for n in range(1, 40):
            for m in jaccard.partner_sizes(n, percent):
                c = jaccard.shared_least(n, m, percent)
                assert 100 * c >= percent * (n + m - c) and (c == 0 or 100 * (c - 1) < percent * (n + m - c + 1))
                assert n - c < jaccard.prefix_size(n, percent)
    assert jaccard.choose_boundary({5: 10}, 85) > 5 and jaccard.choose_boundary({60: 10}, 85) <= 60


def test_jaccard_odd_tables(spark):
    assert jaccard.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words), (1, words), (2, words + " more"), (None, words), (3, "x"), (None, None)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect() if r.component_id)
    assert got == [(0, 26, 1), (1, 26, 1), (1, 26, 1), (2, 27, 1), (3, 1, 3)]
    kept = jaccard.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 3]


def brute_repeats(docs, length):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        covered = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                covered[k : k + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k, c in enumerate(covered) if c and not (k and covered[k - 1]))
        out[i] = (len(b), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest())
    return out


@pytest.mark.parametrize(("length", "gram", "group"), [(20, 8, 2000), (20, 8, 3), (100, 32, 2000), (33, 16, 2)])
def test_substrings(spark, monkeypatch, length, gram, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    rnd = random.Random(length + group)
    pool = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(5, 60))) for _ in range(20)]
    docs = [(i, "a" * rnd.randint(0, 300) if i % 17 == 0 else "".join(rnd.choice(pool) + rnd.choice(["", str(rnd.random())]) for _ in range(rnd.randint(0, 12)))) for i in range(200)]
    docs += [(200 + i, docs[i * 3][1]) for i in range(20)] + [(300, None), (301, "")]
    rnd.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("place", F.lit("mine"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.repeated_substrings(df, length=length, gram=gram).collect()}
    assert got == brute_repeats(docs, length)


def test_substrings_odd_tables(spark):
    assert substrings.repeated_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    t = "".join(chr(97 + i * i % 26) for i in range(300)) + "!"
    rows = [(1, t), (1, t), (2, "x" + t), (None, t)]
    got = sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in substrings.repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    own = brute_repeats([(1, t), (2, "x" + t)], 100)
    assert got == [(0, 0, 0), (1, own[1][1], own[1][2]), (1, own[1][1], own[1][2]), (2, own[2][1], own[2][2])]


def test_substrings_over_chunks(spark):
    """A text of several chunks, with repeats over their seams, within it and in others."""
    rnd = random.Random(12)
    say = lambda n: bytes(rnd.choices(b"abcdefghijklmnopqrstuvwxyz     ", k=n))
    chunk = substrings.CHUNK
    long = bytearray(say(2 * chunk + 5000))
    for at, size in ((chunk - 150, 400), (2 * chunk - 60, 120), (2 * chunk - 3000, 99)):
        piece = bytes(long[at : at + size])
        long[at + size + 777 : at + 2 * size + 777] = piece
    docs = [(1, bytes(long).decode()), (2, "x" + bytes(long[chunk - 500 : chunk + 500]).decode() + "y"), (3, say(300).decode()), (4, "q" * 5000)]
    seen, want = set(), {}
    for i, t in docs:
        data, cover = t.encode(), np.zeros(len(t) + 1, np.int64)
        for a in range(len(data) - 99):
            w = data[a : a + 100]
            if w in seen:
                cover[a] += 1
                cover[a + 100] -= 1
            seen.add(w)
        removed = np.cumsum(cover)[:-1] > 0
        kept = bytes(np.frombuffer(data, np.uint8)[~removed])
        want[i] = (len(data), int(removed.sum()), int((np.diff(np.r_[0, removed.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.repeated_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and want[1][1] > 500


def test_columnwise_orders_like_sorting():
    rng = np.random.default_rng(1)
    rows = rng.integers(97, 100, (60, 12)).astype(np.uint8)
    group = np.sort(rng.integers(0, 4, 60))
    first, last = rng.integers(0, 3, 60), rng.integers(4, 8, 60)
    got = substrings.columnwise(rows, group, first, last, 5)
    for j in range(8):
        seen = set()
        for i in range(60):
            if first[i] <= j <= last[i]:
                key = (group[i], rows[i, j : j + 5].tobytes())
                assert got[i, j] == (key in seen)
                seen.add(key)
            else:
                assert not got[i, j]


def brute_vectors(rows, least):
    groups, links = Groups(), Counter()
    good = lambda v, l: l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    for i, (a, u, l) in enumerate(rows):
        for b, v, m in rows[:i]:
            if good(u, l) and good(v, m) and l == m and len(u) == len(v):
                x, y = np.array(u), np.array(v)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    links[a] += 1
                    links[b] += 1
                    groups.link(a, b)
    return {a: (links[a], groups.find(a), groups.find(a) == a) for a, _, _ in rows}


@pytest.mark.parametrize(("tile", "cell"), [(1 << 14, 64), (30, 2), (1 << 14, 1)])
def test_embeddings(spark, tile, cell):
    rng = np.random.default_rng(cell)
    base = rng.normal(size=(40, 12))
    rows = [(i, (base[rng.integers(40)] + rng.normal(size=12) * rng.choice([0, 0.05, 0.2, 0.5])).tolist(), int(rng.integers(3))) for i in range(300)]
    rows += [(400, None, 1), (401, [0.0] * 12, 1), (402, [float("nan")] + [1.0] * 11, 1), (403, [None] + [1.0] * 11, 1), (404, [1.0] * 12, None), (405, [1.0] * 5, 1), (406, [2.0] * 5, 1), (407, [], 1), (408, [float("inf")] * 12, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("copies", F.lit("mine"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df, 0.9, tile=tile, cell=cell).collect()}
    assert got == brute_vectors(rows, 0.9)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_embeddings_of_single_precision_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 1), (2, [0.99, 0.1, 0.0], 1), (3, [0.0, 1.0, 0.001], 1), (4, [0.0, 1.0, 0.0], 1), (None, [1.0, 0.0, 0.0], 1), (5, [-0.0, 0.0, 1.0], 1), (6, [0.0, 0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in embeddings.near_vectors(df, 0.93).collect())
    assert got == [(0, 0, 0), (1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1), (5, 1, 5), (6, 1, 5)]


def test_pipeline_stages(spark):
    """Each stage on its predecessor's result, against a plain version of it."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    now = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in pipeline.STAGES][1] == "n-gram Jaccard join" and len(pipeline.STAGES) == 5
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, spark.createDataFrame(list(now.values()), docs.schema), DATA)
        after = {r.doc_id: r for r in out.collect()}
        if k < 4:
            assert out.columns == docs.columns
        if k == 0:
            labels = spark.read.parquet(f"{DATA}/labels.parquet")
            model = toxicity.fit(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
            word = lambda t: np.mean([model.word(w) for w in toxicity.alnum_words((t or "").encode())] or [0.0]) + model.bias
            assert set(after) == {i for i, r in now.items() if word(r.text) < 0}
            truth = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
            assert sum((i in after) == (not y) for i, y in truth.items()) >= 0.95 * len(truth)
        elif k == 1:
            want = brute_jaccard([(i, r.text) for i, r in now.items()], 5, 80)
            assert set(after) == {i for i in now if want[i][1] == i}
        elif k == 2:
            items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            want = brute_windows([(i, r.text) for i, r in now.items()], [x for x in items if len(x[1].split()) >= 13])
            assert set(after) == {i for i, x in want.items() if not x[1]} and len(after) < len(now)
        elif k == 3:
            assert set(after) == set(now)
            for i, r in after.items():
                spans = pii.plain_spans(now[i].text)
                assert r.text == pii.masked(now[i].text, spans + pii.disguised_spans(now[i].text, spans)) and r.n_chars == len(r.text)
        else:
            tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
            lib = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
            assert set(after) == set(now)
            assert all(r.ids == lib.encode(now[i].text or "", add_special_tokens=False).ids for i, r in after.items())
        now = after
    ran = {r.doc_id: r.ids for r in pipeline.run(spark, DATA).collect()}
    assert ran == {i: r.ids for i, r in now.items()}


@pytest.mark.parametrize("rows", [0, 9])
def test_pipeline_stages_on_odd_rows(spark, rows):
    """Null, empty, blank and very long texts, repeated rows, names that stages use for their own columns; and an empty table."""
    pipeline = pytest.importorskip("corpus_pipeline")
    long = " ".join(f"u{i}" for i in range(40_000))
    given = [(1, None), (2, ""), (3, " \n"), (4, long), (5, "the same words stand here twice over"), (6, "the same words stand here twice over"), (7, "日本語"), (8, "\x00\x01"), (None, "no id at all for this one")][:rows]
    docs = spark.createDataFrame(given, "doc_id long, text string").withColumns({x: F.lit("mine") for x in ("id", "__id", "__text", "score", "n_words", "hits", "items", "spans", "masked", "found", "c0", "component_id", "n_hit")})
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, DATA)
        got = out.collect()
        gone = {6} if k >= 1 else set()
        assert {r.doc_id for r in got} == {i for i, _ in given} - gone and len(got) == len(given) - len(gone & {i for i, _ in given})
        if k < 4:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(got, docs.schema)


def test_registered(spark):
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in names if x.startswith("op")} and "pipeline" in names
