"""The registered queries of the training-data operators: thin, whole tables, whole results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, mixing, packing, pii, quality, sharding, simhash_dedup, topk_search, vector_dedup, warc
from .common import new_path

SHARDS = 24
TRAP = "\\### Assistant: </turn> ok"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archive(_read(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, _read(spark, sf_dir, "labels")))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    out = chat_format.format_conversations(talk.union(trap))
    out = out.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.dedup_vectors(_read(spark, sf_dir, "embeddings")).drop("recall")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "_mix.*")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(_read(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", *pii.counts(F.col("spans")), F.sha2(pii.listed(pii.base_only(F.col("spans"))), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), pii.scores(F.col("spans")).alias("scores"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_chat_format": op4_chat_format,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_mixing": op6_mixing,
    "op7_topk_search": op7_topk_search,
    "op8_sharding": op8_sharding,
    "op9_pii": op9_pii,
    "op10_simhash_dedup": op10_simhash_dedup,
}

_ESC = "replace(replace(replace(replace({t}, chr(92), chr(92) || 'b'), '###', chr(92) || 'h'), '</turn>', chr(92) || 't'), '<|+|>', chr(92) || 'n')"

#: Equal payloads have equal digests; five hex digits are four base 32 letters.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {s}) & 31)::INTEGER, 1)" for i in range(8) for s in (15, 10, 5, 0)
)

ORACLE_SQL: dict[str, str] = {
    "op1_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first, sha1(body) AS h FROM p)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f""",
    "op4_chat_format": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'),
l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS opens FROM c),
m AS (SELECT *, length({_ESC.format(t='text')}) + CASE WHEN opens THEN 4 + length(replace({_ESC.format(t='role')}, ':', chr(92) || 'c')) + 2 + 8 ELSE 5 END AS n FROM l)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars FROM m GROUP BY conv_id""",
    "op5_vector_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x != 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id != b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
r AS (SELECT vec_id AS v, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.v), c AS (SELECT v, min(root) AS root FROM r GROUP BY 1)
SELECT c.v AS vec_id, (SELECT count(*) FROM l WHERE l.a = c.v) AS n_links, root AS component_id, root = c.v AS kept FROM c""",
    "op7_topk_search": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id != c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10""",
}
