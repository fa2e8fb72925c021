"""Embedding near-dedup: a subspace pigeonhole join on cosine similarity.

For unit vectors, cosine >= c means a squared distance of at most 2 - 2c. A fixed rotation spreads that
distance evenly over blocks of dimensions; if it is at most 2 - 2c in all, then it is at most its
proportional share, (2 - 2c) * width / dimensions, in some block. Each block is range-joined under its share:
its first dimensions are cut into cells as wide as the radius, and a cell's vectors meet those of the same and the
adjacent cells only. How many dimensions are cut follows from the number of vectors, from a few hundred on.
A pair counts in the first block whose share it keeps, and is verified there by cosine in double
precision on the vectors as given; so the union of the blocks' candidates needs no further step.

Vectors travel whole and once for all blocks: a label's vectors are dealt into tiles of ``TILE`` at most, and
a task has one tile or two, range-joins all blocks, and returns numbers of links and a spanning set of
links instead of pairs. A label of one tile is not replicated at all; one of k tiles is sent k times, since at such a
similarity the balls of most vectors reach into most cells, and sending them cell by cell would be more.

Equal vectors of a label are one representative that counts for all of them. Vectors of different labels
or with a null label, null or zero vectors, and vectors with null or non-finite components link with
nothing; vectors of different lengths don't link with each other. Rows that repeat a vec_id are vectors of
their own, with links of their own, but share their component. A row without a vec_id links with nothing. An
empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Forest, connected_components, stash

BLOCKS = 8
#: Vectors of a tile, and of a cell, about; pairs compared at a time.
TILE, CELL, PAIRS = 1 << 14, 64, 1 << 18
#: Room for rounding in block distances, which are in single precision and only choose candidates.
SLACK = 4e-6


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x.astype(np.float64), y.astype(np.float64)
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def block_edges(dims: int, blocks: int) -> np.ndarray:
    return np.unique(np.round(np.linspace(0, dims, min(blocks, dims) + 1)).astype(int))


def shares(dims: int, edges: np.ndarray, least: float) -> np.ndarray:
    """The squared distance that each block may have."""
    return (2 - 2 * least) * np.diff(edges) / dims + SLACK


def cut(count: int, width: int, cell: int = CELL) -> int:
    """Dimensions to cut for so many vectors; a dimension has about five cells."""
    n = 0
    while n < width and count >= cell * 5 ** (n + 1):
        n += 1
    return n


def adjacent(x: np.ndarray, y: np.ndarray, radius: float, depth: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Cell by cell over the first ``depth`` dimensions: rows of x in it, rows of y in the same and the adjacent cells, and how many of these are those of x.

    If y is x (``same``), those come first, and of two adjacent cells only the first one meets the other.
    """
    if not depth:
        yield np.arange(len(x)), np.arange(len(y)), len(x) if same else 0
        return
    wide = radius * 1.00001
    own, other = (np.floor(v[:, :depth] / wide).astype(np.int64) for v in (x, y))
    base = np.minimum(own.min(axis=0), other.min(axis=0)) - 1
    span = np.maximum(own.max(axis=0), other.max(axis=0)) + 2 - base
    weight = np.cumprod(np.r_[1, span[::-1]])[:-1][::-1]
    own, other = (own - base) @ weight, (other - base) @ weight
    # The last dimension's three cells follow each other; the others' neighbours are so many ranges.
    steps = [0]
    for w in weight[:-1].tolist():
        steps = [s + k * w for s in steps for k in (-1, 0, 1)]
    steps = np.array(sorted((s for s in steps if s >= 0), key=abs) if same else steps)
    order_x, order_y = np.argsort(own, kind="stable"), np.argsort(other, kind="stable")
    own, other = own[order_x], other[order_y]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    low = np.searchsorted(other, own[first][:, None] + steps - np.where(same & (steps == 0), 0, 1), "left")
    high = np.searchsorted(other, own[first][:, None] + steps + 1, "right")
    for k, (a, b) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(own)], strict=True)):
        parts = [order_y[i:j] for i, j in zip(low[k].tolist(), high[k].tolist(), strict=True) if i < j]
        if parts:
            yield order_x[a:b], np.concatenate(parts), b - a if same else 0


def compare(x: np.ndarray, y: np.ndarray, least: float, blocks: int = BLOCKS, same: bool = False, cell: int = CELL) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of linked pairs of rows of x and y, each pair once; ``same``: y is x."""
    dims = x.shape[1]
    edges = block_edges(dims, blocks)
    share, turn = shares(dims, edges, least), rotation(dims)
    u = (unit(x) @ turn).astype(np.float32)
    v = u if same else (unit(y) @ turn).astype(np.float32)
    for block in range(len(edges) - 1):
        a, b = u[:, edges[block] : edges[block + 1]], v[:, edges[block] : edges[block + 1]]
        one = np.float32(1)
        # One product gives |a|^2 + |b|^2 - 2ab.
        left = np.column_stack([a, (a * a).sum(axis=1), np.full(len(a), one)])
        right = np.column_stack([-2 * b, np.full(len(b), one), (b * b).sum(axis=1)])
        for rows, cols, mine in adjacent(a, b, float(np.sqrt(share[block])), cut(max(len(x), len(y)), a.shape[1], cell), same):
            there = np.ascontiguousarray(right[cols].T)
            step = max(1, PAIRS // len(cols))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                near = np.flatnonzero(left[part] @ there <= np.float32(share[block] + SLACK))
                if not len(near):
                    continue
                i, j = np.divmod(near, len(cols))
                p, q = part[i], cols[j]
                if mine:
                    keep = (j >= mine) | (p < q)
                    p, q = p[keep], q[keep]
                for lo in range(0, len(p), 1 << 16):
                    s, t = p[lo : lo + (1 << 16)], q[lo : lo + (1 << 16)]
                    for e in range(block + 1):  # in this block, and in no earlier one
                        d = (u[s, edges[e] : edges[e + 1]] - v[t, edges[e] : edges[e + 1]]).astype(np.float64)
                        inside = (d * d).sum(axis=1) <= share[e]
                        s, t = (s[inside], t[inside]) if e == block else (s[~inside], t[~inside])
                    linked = cosines(x[s], y[t]) >= least
                    yield s[linked], t[linked]


def near_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", blocks: int = BLOCKS, tile: int = TILE, cell: int = CELL) -> DataFrame:
    """One row per vector row: id, ``n_links``, ``component_id`` and ``kept``."""
    kind = vectors.schema[vector_col].dataType
    wide = "float" if isinstance(getattr(kind, "elementType", None), T.FloatType) else "double"  # nothing is lost by keeping single precision as it is
    rows = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vector_col).cast(f"array<{wide}>"), lambda x: x + F.lit(0).cast(wide)).alias("v"), F.col(label_col).cast("string").alias("label"))
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    # Two hashes name a vector where rows find their representative; which vectors are equal is told by the vectors.
    names = [F.when(F.col("good"), F.xxhash64(F.lit(seed), "label", "v")).alias(h) for seed, h in ((1, "h1"), (2, "h2"))]
    rows = rows.select("id", "label", "v", *names)
    nodes = stash(rows.where("h1 is not null").groupBy("h1", "h2", "label", "v").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "vectors")
    sizes = nodes.groupBy("label", F.size("v").alias("dims")).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("h1", "h2", F.lit("tile")), F.col("tiles")).cast("int")
    dealt = nodes.withColumn("dims", F.size("v")).join(sizes, ["label", "dims"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tasks = dealt.select("label", "dims", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "h1", "h2", "node", "copies", "v")
    id_type = rows.schema["id"].dataType
    result = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("links", T.LongType()), T.StructField("a", id_type), T.StructField("b", id_type)])

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, copies = table.column("node").combine_chunks(), table.column("copies").to_numpy()
        lists = table.column("v").combine_chunks()
        v = lists.flatten().to_numpy().reshape(len(ids), -1)
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        side = table.column("side").to_numpy()
        x, y = (np.arange(len(v)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        links, forest = np.zeros(len(v), np.int64), Forest(len(v))
        if len(x) and len(y):
            for p, q in compare(v[x], v[y], least, blocks, same, cell):
                p, q = x[p], y[q]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                forest.add(p, q)
        moved, some = np.flatnonzero(forest.root != np.arange(len(v))), np.flatnonzero(links)
        at = pa.array(some)
        h1, h2 = (pa.concat_arrays([table.column(h).combine_chunks().take(at), pa.nulls(len(moved), pa.int64())]) for h in ("h1", "h2"))
        a, b = (pa.concat_arrays([pa.nulls(len(some), ids.type), ids.take(pa.array(k))]) for k in (moved, forest.root[moved]))
        return pa.table({"h1": h1, "h2": h2, "links": pa.concat_arrays([pa.array(links[some]), pa.nulls(len(moved), pa.int64())]), "a": a, "b": b})

    found = stash(tasks.groupBy("label", "dims", "i", "j").applyInArrow(join, result), "found")
    roots = stash(connected_components(found.where("b is not null")).withColumnRenamed("id", "node"), "roots")
    degree = found.where("links is not null").groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    full = nodes.drop("v", "label").join(degree, ["h1", "h2"], "left").join(roots, "node", "left")
    full = stash(full.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "classes")
    out = rows.select("id", "h1", "h2").join(full, ["h1", "h2"], "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
