"""Corpora in, results out: files of texts, catalogs, pages, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.functions import text as X
from narrata.operators.corpus import content_id

TEXT_RECORD = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("title", T.StringType()), ("author", T.StringType()), ("source", T.StringType()), ("language", T.StringType()), ("genre", T.StringType()), ("text", T.StringType()), ("content", T.StringType()), ("windows", T.ArrayType(T.StringType())), ("year", T.IntegerType()), ("subjects", T.ArrayType(T.StringType())), ("_damaged", T.StringType()))])
#: Summaries that lie beside the texts.
NOT_TEXTS = ("manifest.json", "metadata.json", "index.json")


def json_texts(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON file per text; files that don't parse are left out. ``content`` and ``windows`` stand in for a missing text."""
    rows = spark.read.schema(TEXT_RECORD).option("multiLine", True).option("columnNameOfCorruptRecord", "_damaged").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder).withColumn("_file", F.col("_metadata.file_name"))
    kept = rows.where(~F.col("_file").isin(*NOT_TEXTS)).where(F.col("_damaged").isNull())
    return kept.withColumn("text", F.coalesce("text", "content", F.array_join("windows", " "))).where("text is not null").drop("_damaged", "_file", "content", "windows")


def plain_texts(spark: SparkSession, folder: str, least_chars: int = 1000) -> DataFrame:
    """(id, title, text) of .txt and .html files of a folder; the id comes from the content."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,html}").text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    body = F.when(F.endswith("name", F.lit(".html")), X.html_text(F.col("value"))).otherwise(F.col("value"))
    return rows.select(F.regexp_replace("name", r"\.[a-z]+$", "").alias("title"), body.alias("text")).where(F.length("text") >= least_chars).select(content_id(F.col("text")).alias("id"), "title", "text")


CATALOG = "`Text#` STRING, Type STRING, Issued STRING, Title STRING, Language STRING, Authors STRING, Subjects STRING, LoCC STRING, Bookshelves STRING"


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A library's CSV catalog: year from the author's dates, subjects as a list, first class."""
    rows = spark.read.schema(CATALOG).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    year = F.regexp_extract("Authors", r"(\d{4})", 1)
    return rows.select(F.col("`Text#`").alias("id"), F.col("Title").alias("title"), F.col("Authors").alias("author"), F.col("Language").alias("language"), F.when(year != "", year.cast("int")).alias("year"), F.transform(F.split("Subjects", ";"), lambda s: F.trim(s)).alias("subjects"), F.get(F.split(F.trim("LoCC"), r"[; ]+"), F.lit(0)).alias("class"))


def select_books(df: DataFrame, language: str | None = None, years: tuple[int, int] | None = None, subject: str | None = None, author: str | None = None, class_: str | None = None, words: tuple[int, int] | None = None, limit: int | None = None) -> DataFrame:
    """Filters of a catalog or corpus, which reach the scan."""
    tests: list[Column] = []
    if language:
        tests.append(F.col("language") == language)
    if years:
        tests.append(F.col("year").between(*years))
    if subject:
        tests.append(F.exists("subjects", lambda s: F.contains(F.lower(s), F.lit(subject.lower()))))
    if author:
        tests.append(F.contains(F.lower("author"), F.lit(author.lower())))
    if class_:
        tests.append(F.startswith("class", F.lit(class_)))
    if words:
        tests.append(F.size(X.words(F.col("text"))).between(*words))
    for test in tests:
        df = df.where(test)
    return df.limit(limit) if limit else df


def json_lines(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """JSON lines with a column for each (name, source field), as strings."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in sorted(set(fields.values()))])
    return spark.read.schema(schema).json(path).select(*(F.col(f).alias(n) for n, f in fields.items()))


def marked_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, title, author, text) of texts with ``#META#`` headers and marked pages, as open archives of old texts have them."""
    rows = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    meta = lambda key: F.trim(F.regexp_extract("value", rf"(?m)^#META#.*{key}[^:]*:+ *([^\n]*)", 1))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", r"(?s)^.*#META#Header#End#", ""), r"(?m)^(###? ?[|$]*|# |~~)", ""), r"PageV\d+P\d+|ms\d+", "")
    return rows.select("file", meta("Title").alias("title"), meta("Author").alias("author"), F.trim(body).alias("text"))


def write_series(long: DataFrame, path: str) -> None:
    """(id, functor, win_idx, t, value), a folder for each functor: readers of one functor skip the others."""
    long.write.mode("overwrite").partitionBy("functor").parquet(path)


def read_series(spark: SparkSession, path: str, functor: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(F.col("functor") == functor) if functor else rows


def write_corpus(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("source").parquet(path)


def manifest(long: DataFrame, id: str = "doc_id") -> DataFrame:
    """What a folder of series holds: always derived, never kept by hand."""
    return long.groupBy("functor").agg(F.count_distinct(id).alias("texts"), F.count("*").alias("windows"), F.avg("value").alias("mean"))


def as_json(df: DataFrame, column: str, out: str = "json") -> DataFrame:
    return df.withColumn(out, F.to_json(column))
