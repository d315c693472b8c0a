"""From raw documents to packed training sequences.

Each stage takes the documents that the one before it kept, as Parquet, and
returns documents with the same columns; the last one returns packed pieces.

- language: documents without a letter, or whose language is less likely than
  all others together, go.
- near_dedup: of near-duplicates (five-word shingles, Jaccard 0.8) the one
  with the smallest doc_id stays. Rows without an id stay.
- substring_dedup: words in passages of 50 words and more that an earlier
  document has go; texts that lose nothing stay as they are.
- packing: sequences of at most 2048 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm import languages, near, packing, substrings
from narrata.workspace import Workspace

PASSAGE_WORDS = 50
SEQUENCE_TOKENS = 2048
END_ID = 0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = docs.where(~languages.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    trees = languages.learn(known, "doc_id", "text", "lang")
    whole = docs.select(F.struct("*").alias("row"), "text")
    judged = languages.predict(whole, "text", trees)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near.near_duplicates(docs, "doc_id", "text", words=5)
    kept = found.where("kept and id is not null").select(F.col("id").alias("doc_id")).distinct()
    # Rows that repeat an id are one document; the minimum is taken before the shuffle too.
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    one = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *others)).alias("row"))
    named = one.select(*(F.col("doc_id") if c == "doc_id" else F.col("row").getField(c).alias(c) for c in docs.columns))
    return named.unionByName(docs.where(F.col("doc_id").isNull()))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    done = substrings.remove_repeats(whole, "doc_id", "text", PASSAGE_WORDS)
    cut = F.col("n_removed") > 0
    changed = {"text": F.when(cut, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(cut, F.char_length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return done.select(*(changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = packing.pieces(docs.select("doc_id", "text"), "text", public_tokenizers.path("word_bpe_49k.json"), SEQUENCE_TOKENS, END_ID)
    light = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(light, SEQUENCE_TOKENS, ["doc_id", "piece"])


STAGES = [("language", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", pack)]

#: No stage but the last can be told from its rows alone in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
