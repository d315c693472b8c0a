"""The registered queries of the numbered operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm import bpe, fingerprints, languages, near, negatives, oracle, packing, personal, phrases, sharding, substrings, topk, urls, warc
from narrata.plans.registry import table
from narrata.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query()
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, "text", ranks, public_tokenizers.PATTERN)
    decode = bpe.decoder(docs, ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(decode("ids"), 256).alias("decoded_sha256"),
    )


@query()
def op8_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = packing.pieces(docs, "text", public_tokenizers.path("word_bpe_49k.json"), 2048, 0)
    light = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(light, 2048, ["doc_id", "piece"])


@query()
def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("digest"))
    placed = sharding.shard(docs, "doc_id", F.col("digest"), F.col("size"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


URL_RULES = [
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("allow", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
]


@query(oracle.URLS)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    edges = urls.links(pages, "url", "html")
    judged = urls.judge(pages.select("page_id", "url"), "url", URL_RULES, edges)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query(
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS m FROM p),
    g AS (SELECT page_id, n, m, list_transform(range(8), lambda i: CAST('0x' || substr(x, CAST(5 * i + 1 AS INT), 5) AS INT)) AS parts FROM d)
    SELECT page_id, n AS payload_bytes,
      array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0],
        lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> s) % 32 + 1, 1)), '')), '') AS payload_digest,
      CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> m THEN m END AS refers_to
    FROM g
    """
)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder, index = warc.write(pages, "page_id", "url", F.encode("html", "UTF-8"), 0, Workspace(spark, "warc"))
    records = warc.read(folder, index, payload=False)
    return records.select(F.col("record").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
    SELECT query_id, CAST(n AS INT) AS rank, vec_id, score FROM r WHERE n <= 5
    """
)
def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5)


@query(oracle.NEAR)
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near.near_duplicates(docs, "doc_id", "text", words=4).withColumnRenamed("id", "doc_id")


@query()
def op2_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints.compared(docs, "doc_id", "text").withColumnRenamed("id", "doc_id")


@query(oracle.REPEATS)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = substrings.remove_repeats(docs, "doc_id", "text", 13)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op4_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = languages.held_out(F.col("doc_id"))
    trees = languages.learn(docs.where(~out & F.col("doc_id").isNotNull()), "doc_id", "text", "lang")
    predicted = languages.predict(docs.select("doc_id", "text"), "text", trees)
    return predicted.select("doc_id", out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query()
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(personal.written(F.col("base")), 256).alias("base_sha256"), personal.written(F.col("spans")).alias("spans"), "n_added")


@query(oracle.PHRASES)
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), "text", "lang", 5, 100, 100, 2000)


@query(oracle.NEGATIVES)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors, "vec_id", "embedding", label, F.col("vec_id") % 50 == 0, positives=5, negatives=3)
