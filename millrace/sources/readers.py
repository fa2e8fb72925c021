"""Sources: rows in memory, generated rows, files, Kafka, HTTP, and several of them together."""

from __future__ import annotations

import json
import os
import re
import threading
import uuid
from functools import reduce
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.specs import duration


def memory(spark: SparkSession, rows, schema: T.StructType | str | None = None) -> DataFrame:
    """A bounded frame of the given rows (tuples, dicts, pandas or Arrow); no rows need a schema."""
    if not isinstance(rows, list):
        return spark.createDataFrame(rows, schema) if schema is not None else spark.createDataFrame(rows)
    if not rows and schema is None:
        raise ValueError("no rows: a schema is needed")
    if rows and schema is None and isinstance(rows[0], dict):
        names = sorted({k for r in rows for k in r})
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], names)
    return spark.createDataFrame(rows, schema)


def template(text, seq: Column, seed: int = 0) -> Column:
    """A field of generated rows: ``seq``, text with ``${seq}``, ``rand:int:a:b`` (both included), ``rand:float:a:b``, ``choice:a|b``, or the value itself."""
    if not isinstance(text, str):
        return F.lit(text)
    if text == "seq":
        return seq.cast("bigint")
    if m := re.fullmatch(r"rand:int:(-?\d+):(-?\d+)", text):
        a, b = int(m[1]), int(m[2])
        if b < a:
            raise ValueError(f"empty range: {text}")
        return (F.floor(F.rand(seed) * (b - a + 1)) + a).cast("bigint")
    if m := re.fullmatch(r"rand:float:(-?[\d.]+):(-?[\d.]+)", text):
        a, b = float(m[1]), float(m[2])
        return F.rand(seed) * (b - a) + a
    if text.startswith("choice:"):
        options = text[7:].split("|")
        return F.element_at(F.array(*map(F.lit, options)), (F.floor(F.rand(seed) * len(options)) + 1).cast("int"))
    if "${seq}" in text:
        parts = text.split("${seq}")
        return F.concat(*[x for k, p in enumerate(parts) for x in ((seq.cast("string"),) if k else ()) + (F.lit(p),)])
    return F.lit(text)


def generator(spark: SparkSession, fields: dict, rows: int | None = None, rate: str | float | None = None, seed: int = 42) -> DataFrame:
    """Generated rows with ``_seq`` from 0: ``rows`` of them, or a stream at one row per ``rate`` (as fast as Spark's rate source goes for 0)."""
    if rows is not None:
        base = spark.range(rows).withColumnRenamed("id", "_seq")
    else:
        micros = int(duration(rate or 0).split()[0])
        base = spark.readStream.format("rate").option("rowsPerSecond", max(1, round(1_000_000 / micros)) if micros else 1_000_000).load().select(F.col("value").alias("_seq"), F.col("timestamp").alias("_event_time"))
    return base.select("*", *[template(v, F.col("_seq"), seed + k).alias(n) for k, (n, v) in enumerate(sorted((fields or {}).items()))])


def read_files(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | str | None = None, stream: bool = False, **options) -> DataFrame:
    """Parquet, ORC, CSV, JSON or text files. Streams and CSV or JSON need a schema, so that nothing is inferred by an extra pass."""
    if schema is None and (stream or format in ("csv", "json")):
        raise ValueError(f"a schema is needed for {'streams' if stream else format}")
    reader = (spark.readStream if stream else spark.read).format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def parallel(*frames: DataFrame) -> DataFrame:
    """Several sources as one, in no order across them."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def kafka_options(brokers: str | list[str], topic: str, group: str | None = None, partitions: list[int] | None = None, start: str = "earliest") -> dict[str, str]:
    """Options of Spark's Kafka source: a whole topic, or pinned partitions."""
    out = {"kafka.bootstrap.servers": brokers if isinstance(brokers, str) else ",".join(brokers), "startingOffsets": start}
    out |= {"assign": json.dumps({topic: partitions})} if partitions is not None else {"subscribe": topic}
    return out | ({"kafka.group.id": group} if group else {})


def read_kafka(spark: SparkSession, schema: T.StructType, **options) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON messages; rejects hold what could not be parsed. Needs Spark's Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").options(**kafka_options(**options)).load()
    return parse_json(raw.select(F.col("value").cast("string").alias("value")), "value", schema)


def parse_json(df: DataFrame, column: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Parsed rows, and the texts that are no JSON of the schema (for quarantine)."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = df.withColumn("_row", F.from_json(column, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_row").isNull() | F.col("_row._corrupt").isNotNull()
    return parsed.where(~bad).select(*[F.col(f"_row.{f.name}") for f in schema.fields]), parsed.where(bad).select(F.col(column).alias("raw"))


def read_frames(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """The rows of Arrow IPC streams that stand in a binary column, as messages of a topic or whole files do; a frame that can't be read is left out.

    Columns are taken by name and cast; one that a frame lacks is null.
    """
    import pyarrow as pa

    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            for frame in batch.column(0).to_pylist():
                try:
                    with pa.ipc.open_stream(frame or b"") as reader:
                        got = reader.read_all()
                    there = [got.column(f.name).cast(f.type) if f.name in got.column_names else pa.chunked_array([pa.nulls(got.num_rows, f.type)]) for f in kinds]
                except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
                    continue
                yield from pa.table(there, names=schema.names).combine_chunks().to_batches()

    return df.select(column).mapInArrow(run, schema)


def frame_files(spark: SparkSession, path: str, schema: T.StructType | str, stream: bool = False) -> DataFrame:
    """Files of one Arrow IPC stream each."""
    reader = (spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary") if stream else spark.read).format("binaryFile")
    return read_frames(reader.load(path), "content", schema)


def read_kafka_frames(spark: SparkSession, schema: T.StructType, **options) -> DataFrame:
    """Rows of columnar messages: every value is an Arrow IPC stream. Needs Spark's Kafka connector on the class path."""
    return read_frames(spark.readStream.format("kafka").options(**kafka_options(**options)).load(), "value", schema)


class http_landing:
    """Accepts ``POST /ingest`` with a JSON array and lands it as NDJSON files, which a JSON file stream reads.

    405 for other methods, 400 for other bodies, 503 when closing. A file appears whole, by a rename.
    """

    def __init__(self, folder: str, port: int = 0, host: str = "127.0.0.1") -> None:
        os.makedirs(folder, exist_ok=True)
        outer = self
        self.folder, self.closing = folder, False

        class Handler(BaseHTTPRequestHandler):
            def _say(self, code: int) -> None:
                self.send_response(code)
                self.send_header("Content-Length", "0")
                self.end_headers()

            def do_GET(self) -> None:
                self._say(405)

            do_PUT = do_DELETE = do_GET

            def do_POST(self) -> None:
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                if self.path != "/ingest":
                    return self._say(404)
                if outer.closing:
                    return self._say(503)
                try:
                    rows = json.loads(body)
                except ValueError:
                    rows = None
                if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
                    return self._say(400)
                outer.land(rows)
                self._say(202)

            def log_message(self, *args) -> None:
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def land(self, rows: list[dict]) -> None:
        name = f"{uuid.uuid4().hex}.json"
        with open(f"{self.folder}/.{name}", "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        os.rename(f"{self.folder}/.{name}", f"{self.folder}/{name}")

    def stream(self, spark: SparkSession, schema: T.StructType | str, **options) -> DataFrame:
        return read_files(spark, self.folder, "json", schema, stream=True, **options)

    def close(self) -> None:
        self.closing = True
        self.server.shutdown()
        self.server.server_close()
