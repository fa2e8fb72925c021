"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _residue(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_groups

    return jaccard_groups(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lmscore import fit, score

    docs = _table(spark, sf_dir, "documents")
    wanted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score(docs, fit(docs, wanted), carry=["doc_id"])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import repeated_substrings

    return repeated_substrings(_table(spark, sf_dir, "documents")).drop("removed")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(_residue("doc_id", 3) == 1, F.lit(False))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), docs.where(~held), carry=["doc_id", "held_out"])


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(_residue("doc_id", 5) != 0))
    held = F.coalesce(_residue("doc_id", 5) == 0, F.lit(False))
    out = score(docs.select("doc_id", held.alias("held_out"), "text"), model, carry=["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_benchmark

    out = find_benchmark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), least=0.93)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(_table(spark, sf_dir, "documents"), carry=["doc_id"], mask=False)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_ngram_jaccard": op1_ngram_jaccard, "op2_lm_scoring": op2_lm_scoring, "op3_substring_dedup": op3_substring_dedup, "op4_language": op4_language, "op5_bpe": op5_bpe, "op6_toxicity": op6_toxicity, "op7_decontamination": op7_decontamination, "op8_embeddings": op8_embeddings, "op9_pii": op9_pii, "op10_licenses": op10_licenses}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_COMPONENTS = """reach AS (SELECT id, id AS r FROM nodes UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.id),
component AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"""

OP1_SQL = rf"""WITH RECURSIVE words AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i : i + 3]) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * k >= 85 * (s.n + t.n - k)),
nodes AS (SELECT doc_id AS id FROM documents),
{_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN component ON id = d.doc_id"""

OP7_SQL = rf"""WITH words AS (SELECT doc_id, coalesce({_ALNUM.format(_LOWER)}, []) AS w FROM documents),
items AS (SELECT item_id, {_ALNUM.format(_LOWER)} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: w[i : i + least(13, len(w)) - 1])) AS g FROM items WHERE len(w) > 0),
lengths AS (SELECT DISTINCT len(g) AS n FROM windows),
places AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'pos': i, 'g': w[i : i + n - 1]}})) AS p FROM words, lengths WHERE len(w) >= n),
found AS (SELECT doc_id, n, p.pos AS pos, item_id FROM places JOIN windows ON p.g = g),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS x FROM found) GROUP BY 1),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS i FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(i, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)"""

OP8_SQL = rf"""WITH RECURSIVE good AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.93),
nodes AS (SELECT vec_id AS id FROM embeddings),
{_COMPONENTS}
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN component ON id = e.vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1_SQL, "op7_decontamination": OP7_SQL, "op8_embeddings": OP8_SQL}
