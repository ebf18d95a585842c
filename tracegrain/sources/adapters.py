"""The model's tables from the synthetic ones, by projection alone, and from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a hunk: its source is the file, the event of its number the commit."""
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("hunk_id"), F.col("doc_id").alias("commit_id"), F.col("text").alias("diff_text"), F.col("lang").alias("language"), F.concat(F.col("source"), F.lit(".rs")).alias("file_path"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a commit; a user's events are a line of first parents."""
    events = read(spark, sf_dir, "events")
    ts = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = events.select(F.col("event_id").alias("commit_id"), F.col("event_id").cast("string").alias("commit_sha"), ts.alias("ts"), F.col("user_id").cast("string").alias("author"), F.col("event_type").alias("change_kind"), F.coalesce("props", F.lit("")).alias("message"))
    return rows.withColumn("parent_sha", F.lag("commit_sha").over(Window.partitionBy("author").orderBy("ts", "commit_id")))


def plain_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit_id, ts, author, message without parents, and so without a shuffle."""
    ts = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("commit_id"), F.col("event_id").cast("string").alias("commit_sha"), ts.alias("ts"), F.col("user_id").cast("string").alias("author"), F.col("event_type").alias("change_kind"), F.coalesce("props", F.lit("")).alias("message"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("hunk_id"), F.col("embedding").alias("vector"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is a symbol at HEAD; its file is one of ten by number."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.col("p_brand").alias("sibling_names"), F.concat(F.lit("src"), (F.col("p_partkey") % 20).cast("string"), F.lit(".rs")).alias("file_path"))


def hunk_symbols(spark: SparkSession, sf_dir: str, order: bool = False) -> DataFrame:
    """The parts of a line item's order are the symbols of the hunk of that number; with their order (ord) if asked for."""
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hunk_id"), F.col("l_partkey").alias("symbol_id"), F.col("l_linenumber"))
    kind = F.when(F.col("l_linenumber") % 3 == 1, "exact_span").when(F.col("l_linenumber") % 3 == 2, "hunk_header").otherwise("file_fallback")
    return items.join(symbols(spark, sf_dir), "symbol_id").select("hunk_id", F.col("name").alias("symbol_name"), F.col("kind").alias("symbol_kind"), kind.alias("attribution_kind"), *([F.col("l_linenumber").alias("ord")] if order else []))


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as diffs: a header that names a function, then lines that are added, kept and removed in turn."""
    docs = read(spark, sf_dir, "documents")
    rows = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    signed = F.transform(rows, lambda x, i: F.concat(F.element_at(F.array(F.lit("+"), F.lit(" "), F.lit("-")), i % 3 + 1), x))
    header = F.concat(F.lit("@@ -1,3 +"), (F.col("doc_id") % 50 + 1).cast("string"), F.lit(","), F.size(rows).cast("string"), F.lit(" @@ fn name"), (F.col("doc_id") % 7).cast("string"), F.lit("()"))
    return docs.select(F.col("doc_id").alias("hunk_id"), F.concat(F.col("source"), F.lit(".rs")).alias("file_path"), F.col("lang").alias("language"), F.concat(header, F.lit("\n+++ b/"), F.col("source"), F.lit("\n"), F.array_join(signed, "\n")).alias("diff_text"))


def blame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a file, its turns are lines, the commit of a line follows from both."""
    return read(spark, sf_dir, "conversations").select(F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("file"), (F.col("turn") + 1).cast("int").alias("line"), ((F.col("conv_id") * 7 + F.col("turn")) % 40).cast("string").alias("commit_sha"))


def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is a commit that changes the path of its address."""
    return read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("commit_sha"), F.regexp_replace(F.col("url"), r"^[a-z]+://|[?#].*$", "").alias("path"))


GOLDEN = "id string, query string, language string, since_unix long, expected_commit_labels array<string>, expected_paths array<string>, expected_profile string, notes string"


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Cases of an evaluation, one JSON object a line."""
    return spark.read.schema(GOLDEN).json(path)
