"""Shared pieces of the training-data operators: words, hashes, shared folders, bounded broadcasts."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns every byte that is not [0-9a-z] or non-ASCII into a space: words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
_alnum = bytearray(b" " * 128 + bytes(range(128, 256)))
for _i in range(128):
    if chr(_i).isalnum():
        _alnum[_i] = ord(chr(_i).lower())
ALNUM_TABLE = bytes(_alnum)

#: Bytes of text that one slice of an Arrow batch may hold while it is worked on.
SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch; with long texts the default of Spark takes much memory on both sides.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

#: Nodes up to which a round's lowest neighbours are broadcast, and links up to which one task finds the components.
BROADCAST_NODES, FEW_LINKS = 300_000, 1 << 16
#: Bytes of files up to which a stashed table is broadcast.
BROADCAST_BYTES = 16 << 20


def alnum_words(data: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and any non-ASCII characters."""
    return data.translate(ALNUM_TABLE).split()


def space_words(data: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs between ASCII blanks (space, tab to carriage return)."""
    return data.lower().split()


class Memo(dict):
    """A dict that computes missing values; ``trim`` empties it beyond ``limit`` entries, so that memory stays bounded."""

    def __init__(self, make, limit: int = 100_000) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` (text or binary) holds at most ``limit`` bytes in each, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where it is unset and Spark runs in this process, as in tests, a folder of it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: its lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Returns freed memory of a Python worker to the system, where that is possible; idle workers stay for a while."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def unstash(df: DataFrame) -> None:
    """Deletes a stashed table that nothing reads any more."""
    path = getattr(df, "stash_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of queries that are over."""
    gc.collect()
    spark._jvm.System.gc()


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Marks ``df`` for broadcasting only if it has at most ``rows`` rows; otherwise Spark joins by a shuffle."""
    few = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df


def few(table: DataFrame, rows: int) -> DataFrame:
    """Marks a stored table for broadcasting if it has at most ``rows`` rows; its count is in its files' footers."""
    return F.broadcast(table) if table.count() <= rows else table


def light(table: DataFrame, view: DataFrame, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a view of a stashed table for broadcasting if the table's files have at most ``size`` bytes."""
    path = table.stash_path
    p = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return F.broadcast(view) if there <= size else view


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in ``links``: the smallest id that it reaches.

    In a round every id goes over to the smallest one among itself and its neighbours, and from there twice to
    where that one goes; links between ids that are one now are dropped, and the others join what the ids have become. The
    smallest id of a component never changes, so in the end all have become it. A round costs one sum, combined map-side, and
    equi-joins of stored tables. As soon as no more than ``FEW_LINKS`` links are left, one task unites their ends.
    Null ends are left out; an empty table gives an empty table.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = stash(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    moves: list[DataFrame] = []
    for _ in range(max_rounds):
        left = edges.count()
        if moves and not left:
            break
        if left <= FEW_LINKS and edges.schema["u"].dataType.simpleString() in ("bigint", "int", "string"):
            moves.append(few(stash(_united(edges), "low"), BROADCAST_NODES))
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = few(stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low"), BROADCAST_NODES)
        step = low.select(F.col("u").alias("m"), F.col("m").alias("n"))
        far = low.join(step, "m").select("u", F.col("n").alias("m")).join(step, "m").select("u", F.col("n").alias("m"))
        far = few(stash(far, "low"), BROADCAST_NODES)
        moves.append(far)
        new = edges.join(far, "u").select("v", F.col("m").alias("a")).join(far.withColumnRenamed("u", "v"), "v").select(F.col("a").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = stash(new, "edges")
        unstash(edges)
        edges = new
    else:
        raise RuntimeError("components did not settle")
    out = moves[0].select(F.col("u").alias("id"), F.col("m").alias("component"))
    for more in moves[1:]:
        out = out.join(more.select(F.col("u").alias("component"), "m"), "component", "left").select("id", F.coalesce("m", "component").alias("component"))
    return out


class Forest:
    """Connected parts among numbers, from batches of links; a part's root is its smallest number."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        while len(p):
            a, b = self.root[p], self.root[q]
            keep = a != b
            p, q, a, b = p[keep], q[keep], a[keep], b[keep]
            low = np.minimum(a, b)
            np.minimum.at(self.root, a, low)
            np.minimum.at(self.root, b, low)
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def _united(edges: DataFrame) -> DataFrame:
    """(u, m): the ends of a few links with the smallest id they reach, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        u, v = table.column("u").combine_chunks(), table.column("v").combine_chunks()
        coded = pa.concat_arrays([u, v]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        ids = coded.dictionary.take(pa.array(order))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        at = number[coded.indices.to_numpy()]
        forest = Forest(len(ids))
        forest.add(at[: len(u)], at[len(u) :])
        yield pa.RecordBatch.from_arrays([ids, ids.take(pa.array(forest.root))], names=["u", "m"])

    from pyspark.sql import types as T

    kind = edges.schema["u"].dataType
    return edges.coalesce(1).mapInArrow(run, T.StructType([T.StructField("u", kind), T.StructField("m", kind)]))


def annotate(docs: DataFrame, text_col: str, fields: list[tuple[str, object]], make, carry: list[str] | None = None) -> DataFrame:
    """Appends columns computed from the text alone, without a shuffle.

    ``make`` is called once in a Python worker and gives a function from the UTF-8 texts of a slice to a list
    of columns. ``carry`` names the columns to keep, all by default; one with the name of a new column gives way to it.
    """
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    new = {n.lower() for n, _ in fields}
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
    text = "__text"
    while text in {c.lower() for c in keep}:
        text += "_"
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(text))
    schema = T.StructType([*(source.schema[c] for c in keep), *(T.StructField(n, t) for n, t in fields)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        kinds = None
        for batch in slices(batches, text):
            if kinds is None:
                from pyspark.sql.pandas.types import to_arrow_type

                kinds = [to_arrow_type(t) for _, t in fields]
            out = work(texts(batch, text), batch.column(text).is_valid())
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)

    return source.mapInArrow(run, schema)


def with_plain_names(docs: DataFrame, column: str, fn) -> DataFrame:
    """``fn`` of the documents under names that can't clash with those it adds; of its result, the documents' own columns under their names.

    ``fn`` gets the frame and the new name of ``column``.
    """
    plain = {c: f"__c{k}" for k, c in enumerate(docs.columns)}
    out = fn(docs.select(*[F.col(f"`{c}`").alias(x) for c, x in plain.items()]), plain[column])
    return out.select(*[F.col(x).alias(c) for c, x in plain.items()])
