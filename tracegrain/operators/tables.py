"""Keyed writes as DataFrame functions: what a table is after new rows have come."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose key new doesn't have, and all of new: delete, then insert."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All of old, and the first row of new for each key that old lacks."""
    fresh = new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return old.unionByName(fresh.select(*old.columns))


def latest_wins(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row of each key that comes last."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).where("__n = 1").drop("__n")


def put_hunk_symbols(rows: DataFrame, order: str, old: DataFrame | None = None) -> DataFrame:
    """hunk_id, symbol_kind, symbol_name, attribution_kind: a hunk's rows replace what old has of it, the last of duplicates stays."""
    last = rows.groupBy("hunk_id", "symbol_kind", "symbol_name").agg(F.max_by("attribution_kind", order).alias("attribution_kind"))
    return last if old is None else replace_by_key(old, last, ["hunk_id"])


def last_known(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Each key with its last value that is not null; null if there is none."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def missing(candidates: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.join(table.select(*keys), keys, "left_anti")


def cache_lookup(inputs: DataFrame, cache: DataFrame, model: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Inputs with their cached vector or null, and the distinct (content_hash, text) still to embed.

    cache: content_hash, embed_model, diff_emb.
    """
    hashed = inputs.withColumn("content_hash", F.sha2(text_col, 256))
    own = cache.where(F.col("embed_model") == model).select("content_hash", "diff_emb")
    met = hashed.join(own, "content_hash", "left")
    return met, met.where("diff_emb is null").select("content_hash", F.col(text_col).alias("text")).dropDuplicates(["content_hash"])


def cache_stats(cache: DataFrame) -> DataFrame:
    """rows and bytes (four for each component)."""
    return cache.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("diff_emb").cast("long") * 4), F.lit(0)).alias("bytes"))


def method_metrics(snapshots: DataFrame) -> DataFrame:
    """calls, elapsed_us and rows by method, over the snapshots (the same columns) of all drivers."""
    return snapshots.groupBy("method").agg(*[F.sum(c).alias(c) for c in ("calls", "elapsed_us", "rows")])


def metadata_map(rows: DataFrame) -> DataFrame:
    """repo_id and a map of its components."""
    return rows.groupBy("repo_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("component", "version")))).alias("components"))


def total_bytes(diffs: DataFrame, by: list[str]) -> DataFrame:
    from tracegrain.functions.text import added_line_count

    return diffs.groupBy(*by).agg(F.sum(F.octet_length("diff_text").cast("long")).alias("diff_bytes"), F.sum(added_line_count(F.col("diff_text")).cast("long")).alias("added_lines"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
