"""N-gram Jaccard join: all groups of documents whose sets of word n-grams are alike, by size-aware heavy-light search.

Two sets link when 100 * |intersection| >= percent * |union|, that is when they share at least
c(n, m) = ceil(percent * (n + m) / (100 + percent)) elements for sizes n and m.

* Equal sets are one node from the start.
* Light sets (below a boundary) list, for every partner size m, all their subsets of c(n, m) elements.
  Two sets of sizes n and m link exactly when they list a common subset for n + m.
* Heavy sets, and light ones large enough to be their partners, go into inverted lists. Elements are
  ordered from rare to frequent; linked sets share an element among the first n - c + 1, so only those
  have list entries. Lists are scanned from hubs: a list's members are compared with a few of them, links
  are contracted to components, and only lists that still hold several components are scanned again.
  In the end short lists are scanned pair by pair, where only pairs of different components meet. Long
  ones are swept: a task holds a piece of a list, or two, with a bitmap of every set, and returns no pairs
  but a forest over those that the bitmaps leave room for. Its edges are verified; a list with an edge that
  is no link is swept again without it. So no join makes rows by the square of a list.
* The boundary is where the sum of both costs over the sizes that occur is least.

Every link is verified with the whole sets. Element frequencies come from a table of counts of fixed size
over all documents; they only order elements, so collisions cost time and never a result. Hot lists, hubs
and groups of copies meet in joins of two stored tables, which Spark can split, and in sums combined map-side.

Documents without words, null or empty, have an empty set (size 0) and link with nothing. Rows that repeat
an id and a text count as one document; rows that repeat an id with other texts are documents of their own, whose
component is named by an id as all are. A null id takes part as a text; its component is the smallest id it reaches,
or null. A very long text is a slice of its own. Further columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, annotate, bounded, connected_components, few, light, mix64, release, slices, space_words, stash, texts, unstash

#: Cells of the table of element counts.
CELLS = 1 << 20
#: Rows up to which a list of ids is broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: What an entry of an inverted list costs, in subset entries: it is counted, joined and verified.
ENTRY_COST = 4
#: By scan from hubs: comparisons of a set and hubs of a list, about.
HUBS = [(4, 6)]
#: Pairs of different components, per list entry, at which lists are scanned pair by pair.
PAIRS_PER_ENTRY = 4
#: Members up to which a list is scanned pair by pair; longer ones are swept in pieces of about so many, and of so many elements.
SHORT, PIECE, PIECE_ELEMENTS = 32, 2048, 8 << 20
#: Words of bitmaps compared at a time.
SWEEP_WORDS = 1 << 20
#: List entries beyond those that a common element must be among; they tell apart sets with little in common.
MORE_ENTRIES = 4


def shared_least(n: int, m: int, percent: int) -> int:
    """Elements that linked sets of sizes n and m share at least."""
    return -(-percent * (n + m) // (100 + percent))


def partner_sizes(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_plan(n: int, percent: int) -> list[tuple[int, int]]:
    """(n + m, subset size) for the partner sizes m of a set of n, without those that only an equal set can meet."""
    plan = [(n + m, shared_least(n, m, percent)) for m in partner_sizes(n, percent)]
    return [(s, c) for s, c in plan if c <= n and c <= s - n and not (s == 2 * n and c == n)]


def prefix_size(n: int, percent: int) -> int:
    """List entries of a set of n elements: with its smallest partner it shares percent of them."""
    return n - min(shared_least(n, m, percent) for m in partner_sizes(n, percent)) + 1


def choose_boundary(sizes: dict[int, int], percent: int, most: int = 40) -> int:
    """Sets below this size are light."""

    def cost(x: int) -> float:
        light = sum(k * sum(comb(n, c) for _, c in subset_plan(n, percent)) for n, k in sizes.items() if n < x)
        return light + sum(k * prefix_size(n, percent) * ENTRY_COST for n, k in sizes.items() if 100 * n >= percent * x)

    return min(range(1, most + 1), key=cost)


def element_sets(batch: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text."""
    out = []
    for text in batch:
        words = space_words(text)
        ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        k = min(n, len(ids))
        size = len(ids) - k + 1 if k else 0
        h = np.full(size, k, np.uint64)
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + size]
        h = mix64(h)
        h.sort()
        out.append(h[np.r_[True, h[1:] != h[:-1]]] if size else h)
    return out


def parity_bits(elements: np.ndarray) -> bytes:
    """A bitmap of 8 to 16 bits an element, 512 at least: a bit is set if an odd number of elements falls on it.

    Two bitmaps differ in as many bits as the sets have different elements, or in fewer where some of those share a
    bit. Folding a bitmap's halves into one gives the bitmap of half the size.
    """
    size = max(512, 1 << (8 * len(elements) - 1).bit_length())
    counts = np.bincount((elements & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits(counts.astype(np.uint8) & 1).tobytes()


def span(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which of the edges (p, q) join parts of the forest ``root``, which is brought up to date; of edges that join the same parts one."""
    used, at = [], np.arange(len(p))
    while True:
        a, b = root[p[at]], root[q[at]]
        keep = a != b
        at, a, b = at[keep], a[keep], b[keep]
        if not len(at):
            return np.concatenate(used) if used else at
        high, first = np.unique(np.maximum(a, b), return_index=True)
        used.append(at[first])
        root[high] = np.minimum(a, b)[first]
        while (root[root] != root).any():
            root[:] = root[root]


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20) & np.uint64(CELLS - 1)).astype(np.int64)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values as equal small numbers."""
    return column.combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)


class Join:
    """The join over one table of documents. ``members()`` has a row per document row; ``links`` the verified links that hold the groups together."""

    def __init__(self, docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.spark, self.n, self.percent = docs.sparkSession, n, percent
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        self.id_type = self.docs.schema["id"].dataType

    # Sets and copies

    def profile(self) -> DataFrame:
        """Per document its set's size and key; and per task the counts of the elements' cells."""
        n, id_type = self.n, self.id_type
        schema = T.StructType([T.StructField("id", id_type), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("cell", T.IntegerType()), T.StructField("count", T.LongType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, kind = np.zeros(CELLS, np.int64), None
            for batch in slices(batches, "text"):
                sets = element_sets(texts(batch, "text"), n)
                kind = batch.column("id").type
                if sets:
                    counts += np.bincount(_cell(np.concatenate(sets)), minlength=CELLS)
                rows = len(sets)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64())], names=schema.names)
            at = np.flatnonzero(counts)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(at), kind), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=schema.names)

        return self.docs.mapInArrow(run, schema)

    def entries(self, docs: DataFrame, counts: np.ndarray, boundary: int) -> DataFrame:
        """Subset entries (``total`` is n + m) of light sets and list entries (``total`` 0) of heavy ones and their partners."""
        n, percent, shared = self.n, self.percent, self.spark.sparkContext.broadcast(counts)
        schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("node", self.id_type), T.StructField("n", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("total", T.IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = shared.value
            chosen = Memo(lambda k: np.array(list(combinations(range(k[0]), k[1])), np.int64))
            kinds = (np.uint64, np.int32, np.int32, np.int32, np.int32)
            for batch in slices(batches, "text", 1 << 20):
                parts: list[list[np.ndarray]] = [[] for _ in kinds]
                rows = 0

                def flush(parts=parts, batch=batch) -> pa.RecordBatch:
                    h, doc, size, place, total = (np.concatenate(p) for p in parts)
                    for p in parts:
                        p.clear()
                    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("id").take(pa.array(doc)), pa.array(size), pa.array(place), pa.array(total)], names=schema.names)

                for doc, own in enumerate(element_sets(texts(batch, "text"), n)):
                    size, found = len(own), []
                    if 0 < size < boundary:
                        whole = own.sum()
                        for total, c in subset_plan(size, percent):
                            left_out = chosen[size, size - c]
                            found.append((mix64(whole - own[left_out].sum(axis=1, dtype=np.uint64)), 0, total))
                    if size and 100 * size >= percent * boundary:
                        first = np.lexsort((own, counts[_cell(own)]))[: prefix_size(size, percent) + MORE_ENTRIES]
                        found.append((own[first], np.arange(len(first), dtype=np.int32), 0))
                    for h, place, total in found:
                        for p, x, kind in zip(parts, (h, doc, size, place, total), kinds, strict=True):
                            p.append(x if isinstance(x, np.ndarray) else np.full(len(h), x, kind))
                        rows += len(h)
                    if rows > 100_000:
                        yield flush()
                        rows = 0
                if rows:
                    yield flush()

        return docs.mapInArrow(run, schema)

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, elements as bytes) of the nodes."""
        n = self.n
        docs = self.docs.withColumnRenamed("id", "node").join(bounded(nodes, BROADCAST_IDS), "node", "left_semi")

        def make():
            return lambda batch, _valid: [[x.tobytes() for x in element_sets(batch, n)]]

        return annotate(docs, "text", [("elements", T.BinaryType())], make, ["node"])

    # Links

    def possible(self, pairs: DataFrame, heads: DataFrame) -> DataFrame:
        """The pairs whose list entries leave room for a link.

        Of two sets, look at the one whose entries end earlier in the order of elements: what both have in common
        is among both's entries or among that set's elements without an entry.
        """
        side = lambda x: heads.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("rest").alias(f"rest_{x}"), F.col("hs").alias(f"hs_{x}"))
        both = pairs.join(light(heads, side("a")), "a").join(light(heads, side("b")), "b")
        least = self._least("n_a", "n_b")
        return both.where(F.size(F.array_intersect("hs_a", "hs_b")) + F.greatest("rest_a", "rest_b") >= least).select("a", "b")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, by their whole sets."""
        percent, id_type = self.percent, self.id_type
        sets = stash(self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()), "sets")
        x, y = (light(sets, sets.select(F.col("node").alias(a), F.col("elements").alias(v))) for a, v in (("a", "x"), ("b", "y")))
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = []
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                    n, m = len(x) // 8, len(y) // 8
                    good = 100 * min(n, m) >= percent * max(n, m)
                    if good:
                        merged = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                        merged.sort()
                        good = int(np.count_nonzero(merged[1:] == merged[:-1])) >= shared_least(n, m, percent)
                    ok.append(good)
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        found = stash(both.mapInArrow(run, T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])), "links")
        unstash(sets)
        release(self.spark)
        return found

    def light_links(self, entries: DataFrame) -> DataFrame:
        """Members of a subset's list for n + m: those of size n all link with those of size m, so hubs of both sizes hold them together."""
        light = entries.where("total > 0")
        low, high = (F.when(F.col("n") * 2 <= F.col("total"), F.col("node")), F.when(F.col("n") * 2 >= F.col("total"), F.col("node")))
        hubs = stash(light.groupBy("h", "total").agg(F.min(low).alias("low"), F.min(high).alias("high"), F.count("*").alias("k")).where("k > 1 and low is not null and high is not null").drop("k"), "hubs")
        found = light.join(hubs, ["h", "total"]).select(F.explode(F.array(F.when(F.col("n") * 2 <= F.col("total"), F.struct(F.col("high").alias("a"), F.col("node").alias("b"))), F.when(F.col("n") * 2 >= F.col("total"), F.struct(F.col("low").alias("a"), F.col("node").alias("b"))))).alias("p"))
        return found.where("p is not null").select("p.a", "p.b").where("a <> b").distinct()

    def _prefix(self, n: str) -> F.Column:
        """prefix_size as an expression."""
        p, low = self.percent, F.ceil(F.col(n) * self.percent / F.lit(100.0) - 1e-9)
        return F.col(n) - F.ceil((F.col(n) + low) * p / F.lit(100.0 + p) - 1e-9) + 1

    def _least(self, n: str, m: str) -> F.Column:
        """shared_least as an expression."""
        return F.ceil((F.col(n) + F.col(m)) * self.percent / F.lit(100.0 + self.percent) - 1e-9)

    def _fits(self, a: str, b: str, more: int) -> F.Column:
        """Whether two entries of a list are among the first n - c + 1 + more of their sets, for the c that linked sets of their sizes share."""
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        room = F.least(n - F.col(f"{a}.place"), m - F.col(f"{b}.place"))
        return (F.least(n, m) * 100 >= F.greatest(n, m) * self.percent) & (room >= self._least(f"{a}.n", f"{b}.n") - more)

    def heavy_links(self, entries: DataFrame, links: DataFrame) -> DataFrame:
        """Verified links that hold together, with those given, all groups of linked sets."""
        heavy = entries.where("total = 0").drop("total")
        shared = stash(heavy.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "shared")
        release(self.spark)
        rest = F.col("n") - F.least("n", self._prefix("n") + MORE_ENTRIES)
        lists = stash(heavy.join(shared.hint("shuffle_hash"), "h").withColumn("root", F.col("node")), "lists")
        unstash(entries)
        n_entries = lists.count()
        heads = stash(lists.groupBy("node", "n").agg(F.collect_list("h").alias("hs")).withColumn("rest", rest), "heads")
        tested = None
        for scan, (tries, hubs) in enumerate(HUBS):
            release(self.spark)
            if scan:
                lists, cross = self._open(lists, links)
                if cross <= PAIRS_PER_ENTRY * n_entries:  # pair by pair as soon as the pairs of different components are few for the entries
                    break
            # About `hubs` members of a list, the same ones wherever they stand; of long lists an eighth is enough, since like sets share many.
            used = lists.where((F.col("k") <= hubs) | (F.pmod(F.xxhash64("h", F.lit(scan)), F.lit(8)) == 0))
            hub = used.where(F.pmod(F.xxhash64("node", F.lit(scan)), F.lit(1 << 20)) * F.col("k") < hubs << 20)
            pairs = used.alias("a").join(hub.alias("b"), "h").where((F.col("a.root") != F.col("b.root")) & self._fits("a", "b", MORE_ENTRIES))
            pairs = pairs.groupBy(F.col("a.node").alias("x"), F.col("b.node").alias("y")).agg(F.count("*").alias("common"))
            pairs = pairs.select("x", "common", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            # A few comparisons for each set: with the hubs that it shares most entries with.
            pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy("x").orderBy(F.desc("common"), "a", "b"))).where(F.col("rank") <= tries).drop("rank")
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            fresh = stash(pairs.select("a", "b").distinct(), "pairs")
            links = stash(links.unionByName(self.verify(stash(self.possible(fresh, heads), "possible"))), "links")
            tested = fresh if tested is None else tested.unionByName(fresh)
        else:  # not left early
            lists, _ = self._open(lists, links)
        # Two sets meet at the first short list that they share, where there must be room for a link.
        before = F.collect_list("h").over(W.partitionBy("node").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
        short = stash(lists.where(F.col("k") <= SHORT).withColumn("before", before), "short")
        pairs = short.alias("a").join(short.alias("b"), "h").where((F.col("a.root") < F.col("b.root")) & self._fits("a", "b", 0) & ~F.arrays_overlap("a.before", "b.before"))
        pairs = pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))
        fresh = stash(pairs.join(tested, ["a", "b"], "left_anti").distinct(), "pairs")
        links = stash(links.unionByName(self.verify(stash(self.possible(fresh, heads), "possible"))), "links")
        unstash(short)
        return self.sweep(lists.where(F.col("k") > SHORT), links)

    def _open(self, lists: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
        """The lists that hold sets of several components, as they are after the links, and the number of pairs of different components."""
        roots = few(stash(connected_components(links).withColumnRenamed("id", "node"), "roots"), BROADCAST_IDS)
        rooted = stash(lists.drop("k", "size", "root").join(roots, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component"), "rooted")
        by_root = rooted.groupBy("h", "root").agg(F.count("*").alias("k"), F.sum("n").alias("size"))
        still = by_root.groupBy("h").agg(F.count("*").alias("roots"), F.sum("k").alias("k"), F.sum("size").alias("size"), F.sum(F.col("k") * F.col("k")).alias("kk"))
        still = stash(still.where("roots > 1").select("h", "k", "size", ((F.col("k") * F.col("k") - F.col("kk")) / 2).alias("cross")), "open")
        out = stash(rooted.join(still.select("h", "k", "size"), "h"), "lists")
        unstash(lists)
        unstash(rooted)
        return out, still.agg(F.sum("cross")).first()[0] or 0

    def marks(self, nodes: DataFrame) -> DataFrame:
        """(node, bitmap) of the nodes."""
        n = self.n
        docs = self.docs.withColumnRenamed("id", "node").join(bounded(nodes, BROADCAST_IDS), "node", "left_semi")

        def make():
            return lambda batch, _valid: [[parity_bits(x) for x in element_sets(batch, n)]]

        return annotate(docs, "text", [("bits", T.BinaryType())], make, ["node"]).dropDuplicates(["node"])

    def sweep(self, lists: DataFrame, links: DataFrame) -> DataFrame:
        """The links with those that hold together the linked sets of long lists."""
        lists = stash(lists, "long")
        if lists.isEmpty():
            return links
        percent, id_type = self.percent, self.id_type
        marks = stash(self.marks(lists.select("node").distinct()), "marks")
        schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("a", id_type), T.StructField("b", id_type)])

        def forest(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            nodes, side = table.column("node").combine_chunks(), table.column("side").to_numpy()
            n, place = table.column("n").to_numpy().astype(np.int64), table.column("place").to_numpy().astype(np.int64)
            same = int(table.column("i")[0].as_py()) == int(table.column("j")[0].as_py())
            root = _numbers(table.column("root"))
            parts = np.arange(int(root.max()) + 1)
            false = {}
            for row, x in enumerate(table.column("false").to_pylist()):
                if x:
                    false[row] = set(x)
            bits = table.column("bits").to_pylist()
            width = np.array([len(x) for x in bits], np.int64)
            a, b = [], []
            for w in np.unique(width):
                # Sets with bitmaps of this size meet each other and, folded, those with the next larger ones.
                own, next_ = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
                rows = np.concatenate([own, next_])
                maps = np.empty((len(rows), w // 8), np.uint64)
                for k, r in enumerate(rows.tolist()):
                    x = np.frombuffer(bits[r], np.uint64)
                    maps[k] = x if len(x) * 8 == w else x[: len(x) // 2] ^ x[len(x) // 2 :]
                kind = np.r_[np.zeros(len(own), bool), np.ones(len(next_), bool)]
                left = np.arange(len(rows)) if same else np.flatnonzero(side[rows] == 0)
                right = np.arange(len(rows)) if same else np.flatnonzero(side[rows] == 1)
                step = max(1, SWEEP_WORDS // max(1, len(right) * (w // 8)))
                for at in range(0, len(left), step):
                    x = left[at : at + step]
                    r, t = rows[x][:, None], rows[right][None, :]
                    both = n[r] + n[t]
                    least = -(-percent * both // (100 + percent))
                    room = np.minimum(n[r] - place[r], n[t] - place[t])
                    ok = (root[r] != root[t]) & (room >= least) & ~(kind[x][:, None] & kind[right][None, :])
                    if same:
                        ok &= r < t
                    i, j = np.nonzero(ok)
                    for lo in range(0, len(i), step * len(right) or 1):
                        p, q = i[lo : lo + step * len(right)], j[lo : lo + step * len(right)]
                        apart = np.bitwise_count(maps[x[p]] ^ maps[right[q]]).sum(axis=1, dtype=np.int64)
                        close = apart <= (both - 2 * least)[p, q]
                        p, q = rows[x[p[close]]], rows[right[q[close]]]
                        if false:
                            known = np.fromiter((u in false and nodes[v].as_py() in false[u] or v in false and nodes[u].as_py() in false[v] for u, v in zip(p.tolist(), q.tolist(), strict=True)), bool, len(p))
                            p, q = p[~known], q[~known]
                        edges = span(parts, root[p], root[q])
                        a.append(p[edges])
                        b.append(q[edges])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
            return pa.table({"h": table.column("h").combine_chunks().take(pa.array(a)), "a": nodes.take(pa.array(a)), "b": nodes.take(pa.array(b))})

        false, wrong = None, None
        while True:
            rows = lists.join(marks, "node")
            if false is None:
                rows = rows.withColumn("false", F.array().cast(T.ArrayType(id_type)))
            else:
                rows = rows.join(false, "node", "left")
            pieces = F.ceil(F.greatest(F.col("k") / PIECE, F.col("size") / PIECE_ELEMENTS)).cast("int")
            own = F.pmod(F.xxhash64("node", F.lit("piece")), pieces).cast("int")
            rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1)))
            rows = rows.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "n", "place", "root", "bits", "false")
            found = stash(rows.groupBy("h", "i", "j").applyInArrow(forest, schema), "found")
            release(self.spark)
            found = stash(found.select("h", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "found")
            fresh = stash(found.select("a", "b").distinct(), "pairs")
            if fresh.isEmpty():
                return links
            good = self.verify(fresh)
            links = stash(links.unionByName(good), "links")
            bad = stash(found.join(good, ["a", "b"], "left_anti"), "bad")
            if bad.isEmpty():
                return links
            wrong = bad if wrong is None else stash(wrong.unionByName(bad), "wrong")
            false = stash(wrong.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("false")), "false")
            lists, _ = self._open(lists.join(bad.select("h").distinct(), "h", "left_semi"), links)

    def run(self) -> DataFrame:
        profile = stash(self.profile(), "profile")
        own = profile.where("cell is null").drop("cell", "count")
        cells = profile.where("cell is not null").groupBy("cell").agg(F.sum("count").alias("n")).toArrow()
        counts = np.zeros(CELLS, np.int64)
        counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
        counts = np.minimum(counts, 2**31 - 1).astype(np.int32)
        nodes = stash(own.where("n > 0").groupBy("key").agg(F.min("id").alias("node"), F.first("n").alias("n")), "nodes")
        sizes = {r.n: r["count"] for r in nodes.where("n < 64").groupBy("n").count().collect()}
        boundary = choose_boundary(sizes, self.percent)
        copies = own.where("n > 0").join(nodes.select("key", "node"), "key").where("id <> node or id is null").select("id").where("id is not null").distinct()
        # A null id has no entries of its own unless its text has no other id, and then it can't be named in a link.
        docs = self.docs.where("id is not null").join(bounded(stash(copies, "copies"), BROADCAST_IDS), "id", "left_anti")
        entries = stash(self.entries(docs, counts, boundary), "entries")
        if any(n < boundary for n in sizes):
            links = stash(self.light_links(entries), "links")
        else:  # no set is light
            links = docs.sparkSession.createDataFrame([], T.StructType([T.StructField("a", self.id_type), T.StructField("b", self.id_type)]))
        self.links = self.heavy_links(entries, links)
        roots = stash(connected_components(self.links).withColumnRenamed("id", "node"), "roots")
        self.nodes = nodes
        full = stash(nodes.select("key", "node").join(roots, "node", "left").select("key", F.coalesce("component", "node").alias("component_id")), "classes")
        return own.join(full, "key", "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"))


def _repeats(docs: DataFrame, id_col: str) -> bool:
    return not docs.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`")).count().where("count > 1").isEmpty()


def _told_apart(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The documents with ``__node``, a number by id and text in the order of ids, and (__node, __id)."""
    text = F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    keyed = docs.withColumn("__id", F.col(f"`{id_col}`")).withColumn("__hash", text)
    names = keyed.where("__id is not null").select("__id", "__hash").distinct().orderBy("__id", "__hash")
    names = stash(names.withColumn("__node", F.monotonically_increasing_id()), "names")
    return keyed.join(names, ["__id", "__hash"], "left").drop("__id", "__hash"), names.select("__node", "__id")


def jaccard_groups(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every document row; see the module's text."""
    docs = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(text_col))
    if not _repeats(docs, id_col):
        return Join(docs, n, percent, id_col, text_col).run().withColumnRenamed("id", id_col)
    apart, names = _told_apart(docs, id_col, text_col)
    found = Join(apart, n, percent, "__node", text_col).run().withColumnRenamed("id", "__node")
    found = found.join(names, "__node", "left").drop("__node").withColumnRenamed("component_id", "__node").withColumnRenamed("__id", "__own").join(names, "__node", "left")
    return found.select(F.col("__own").alias(id_col), "n_shingles", F.col("__id").alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, column for column, with the one of smallest id of each group. Rows without an id stay; of rows that repeat an id and text one stays."""
    plain = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # names that clash with none made here
    own, text = plain[id_col], plain[text_col]
    rows = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in plain.items()])
    again = _repeats(rows, own)
    if again:
        rows, node = _told_apart(rows, own, text)[0], "__node"
        rows = rows.where("__node is null").unionByName(rows.where("__node is not null").dropDuplicates(["__node"]))
    else:
        node = own
    groups = Join(rows, n, percent, node, text).run()
    gone = bounded(stash(groups.where("id <> component_id").select(F.col("id").alias("__gone")).distinct(), "gone"), BROADCAST_IDS)
    left = rows.join(gone, F.col(node) == F.col("__gone"), "left_anti")
    return left.select(*[F.col(x).alias(c) for c, x in plain.items()])
