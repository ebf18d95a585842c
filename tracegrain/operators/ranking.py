"""Fusion and ranking of candidate hits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.functions.text import tokens

DAY = 86400


def lane(hits: DataFrame, ordinal: int, order: list[Column], similarity: Column, id_col: str = "hunk_id") -> DataFrame:
    """lane, rank, hunk_id, similarity of a lane's few hits, ranked from 1."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.select(F.lit(ordinal).alias("lane"), "rank", F.col(id_col).alias("hunk_id"), similarity.cast("double").alias("similarity"))


def fuse(lanes: DataFrame, k: int = 60, by: list[str] | None = None) -> DataFrame:
    """hunk_id, rrf, similarity, first: reciprocal rank fusion of lane rows (lane, rank, hunk_id, similarity).

    An id that a lane repeats counts each time.  similarity is the first
    lane's, first is where the id appears first; ties are broken by it.
    """
    place = F.struct("lane", "rank")
    return lanes.groupBy(*(by or []), "hunk_id").agg(
        F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))).alias("rrf"),
        F.min_by("similarity", place).alias("similarity"),
        F.min(place).alias("first"),
    )


def pool(fused: DataFrame, size: int) -> DataFrame:
    """The best of the fused, with their order."""
    top = fused.orderBy(F.desc("rrf"), "first.lane", "first.rank", "hunk_id").limit(size)
    return top.withColumn("pool_rank", F.row_number().over(Window.orderBy(F.desc("rrf"), "first.lane", "first.rank", "hunk_id")))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-x))).otherwise(F.exp(x) / (F.lit(1.0) + F.exp(x)))


def recency(ts: Column, now: int, half_life_days: float) -> Column:
    age = F.greatest(F.lit(now) - ts, F.lit(0)) / F.lit(float(DAY))
    return F.exp(-age / F.lit(float(half_life_days)))


def weigh_by_age(hits: DataFrame, now: int, weight: float, half_life_days: float) -> DataFrame:
    """recency and combined_score = similarity * (1 + weight * recency)."""
    found = hits.withColumn("recency", recency(F.col("ts"), now, half_life_days))
    return found.withColumn("combined_score", F.col("similarity") * (1 + F.lit(float(weight)) * F.col("recency")))


#: Logits of a query and a batch of texts, higher for a better match.
Scorer = Callable[[str, pd.Series], "pd.Series | np.ndarray | list[float]"]


def rerank_scores(hits: DataFrame, query: str, text_col: str = "diff_text", scorer: Scorer | None = None) -> DataFrame:
    """similarity from a scorer's logits, through a sigmoid, as the hits' texts are few.

    Without a scorer it is lexical: the share of the query's terms that a text has.
    """
    if scorer is not None:

        @F.pandas_udf("double")
        def logits(texts: pd.Series) -> pd.Series:
            return pd.Series(np.asarray(scorer(query, texts.fillna("")), float), index=texts.index)

        return hits.withColumn("similarity", sigmoid(logits(F.col(text_col))))
    terms = tokens(F.lit(query))
    share = F.size(F.array_intersect(terms, tokens(F.col(text_col)))) / F.greatest(F.size(F.array_distinct(terms)), F.lit(1))
    return hits.withColumn("similarity", sigmoid(share * 6.0 - 3.0))


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def quality(ranks: DataFrame) -> DataFrame:
    """cases, recall_at_1, recall_at_5, mrr, ndcg_lite, p50_ms, p95_ms of (id, rank or null, ms).

    Percentiles are nearest-rank, by counting how often each latency occurs.
    """
    hit = F.col("rank").isNotNull()
    agg = ranks.agg(
        F.count("*").alias("cases"),
        F.avg(F.when(hit & (F.col("rank") <= 1), 1.0).otherwise(0.0)).alias("recall_at_1"),
        F.avg(F.when(hit & (F.col("rank") <= 5), 1.0).otherwise(0.0)).alias("recall_at_5"),
        F.avg(F.when(hit, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"),
        F.avg(F.when(hit, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("ndcg_lite"),
        F.expr("percentile_disc(0.5) within group (order by ms)").alias("p50_ms"),
        F.expr("percentile_disc(0.95) within group (order by ms)").alias("p95_ms"),
    )
    return agg.select("cases", "recall_at_1", "recall_at_5", "mrr", "ndcg_lite", F.col("p50_ms").cast("long"), F.col("p95_ms").cast("long"))
