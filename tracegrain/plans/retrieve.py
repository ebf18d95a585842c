"""How was something like this done before: hybrid retrieval as one plan.

Up to five lanes rank hunks on narrow rows, each with a top-k, at the same time;
reciprocal rank fusion of their few hundred rows makes the pool; only the pool
meets texts, commits and symbols.  What leaves a lane is bounded by its top-k, so
the driver holds LANES times that many narrow rows, whatever the corpus.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.functions import intent
from tracegrain.functions import text as T
from tracegrain.functions import vectors as V
from tracegrain.functions.counters import Counters
from tracegrain.operators import cells, fulltext, knn, ranking, symbols, trigrams
from tracegrain.operators.fulltext import TextIndex

LANES = ("vec", "text", "semantic", "historical_symbol", "head_symbol")
MOST_HITS = 20


@dataclass
class Corpus:
    """hunks: hunk_id, commit_id, file_path, language, diff_text; commits: commit_id, commit_sha, ts, author, change_kind, message."""

    hunks: DataFrame
    commits: DataFrame
    vectors: DataFrame
    text: TextIndex
    semantic: TextIndex
    head: TextIndex
    symbols: DataFrame
    hunk_symbols: DataFrame
    #: hunk_id, file_path, language, ts: what lanes filter by; joined here if not stored
    facts: DataFrame | None = None
    #: the vectors by cell; without it they are all read for each question
    cells: cells.CellIndex | None = None
    #: trigrams of the names of hunk_symbols; without them all names are read
    grams: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.facts is None:
            self.facts = self.hunks.select("hunk_id", "commit_id", "file_path", "language").join(self.commits.select("commit_id", "ts"), "commit_id").drop("commit_id")


class RebuildNeeded(RuntimeError):
    """The index was made by an incompatible version."""


_TABLES = ("hunks", "commits", "vectors", "symbols", "hunk_symbols", "facts")
_INDEXES = ("text", "semantic", "head")


def save(corpus: Corpus, path: str) -> None:
    """Write a corpus: each table, postings sorted by term, and vectors sorted by cell."""
    spark = corpus.hunks.sparkSession
    for name in _TABLES:
        getattr(corpus, name).write.mode("overwrite").parquet(f"{path}/{name}")
    for name in _INDEXES:
        getattr(corpus, name).write(f"{path}/{name}")
    trigrams.write(corpus.hunk_symbols, f"{path}/grams")
    state = cells.build(spark, f"{path}/cells", spark.read.parquet(f"{path}/vectors"))
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/cells-state")


def load(spark: SparkSession, path: str) -> Corpus:
    state = json.loads(spark.read.text(f"{path}/cells-state").first().value)
    return Corpus(**{n: spark.read.parquet(f"{path}/{n}") for n in _TABLES}, **{n: TextIndex.read(spark, f"{path}/{n}") for n in _INDEXES}, cells=cells.view(spark, f"{path}/cells", state), grams=spark.read.schema(trigrams.GRAMS).parquet(f"{path}/grams"))


def lanes(corpus: Corpus, query: str, vector: list[float] | None, enabled: tuple[str, ...], k: int, language: str | None = None, since: int | None = None, lenient: bool = True, strict: bool = True) -> dict[str, Callable[[], DataFrame]]:
    """What makes each lane's ranked hits.  Full-text and symbol lanes filter before their top-k, the vector lane after.

    strict: similarities of full-text lanes as the engine we match has them,
    falling with the strength of a match; otherwise they rise.
    """
    fit = corpus.facts.where(knn.passes(language, since))
    unfiltered = language is None and since is None
    by_score = [F.col("score"), F.col("hunk_id")]

    def vec() -> DataFrame:
        found = cells.nearest(corpus.cells, vector, k) if corpus.cells else knn.nearest(corpus.vectors, vector, k)
        near = F.broadcast(found)  # k rows
        near = corpus.facts.join(near, "hunk_id")
        return ranking.lane(knn.filtered(near, language, since), 0, [F.col("distance"), F.col("hunk_id")], F.col("similarity"))

    def text(index: TextIndex, ordinal: int) -> DataFrame:
        hits = fulltext.search(index, query, lenient).withColumnRenamed("doc_id", "hunk_id")
        if not unfiltered:
            hits = hits.join(fit.select("hunk_id"), "hunk_id", "left_semi")
        return ranking.lane(hits.orderBy("score", "hunk_id").limit(k), ordinal, by_score, V.bm25_similarity(F.col("score"), strict))

    def historical() -> DataFrame:
        hits = symbols.historical_symbol_hunks(corpus.hunk_symbols, fit.select("hunk_id", "ts"), query, k, corpus.grams)
        return ranking.lane(hits, 3, [F.col("ord")], F.col("similarity"))

    def head() -> DataFrame:
        hits = symbols.head_symbol_hunks(corpus.head, corpus.symbols, fit, query, k, lenient)
        return ranking.lane(hits, 4, by_score, V.bm25_similarity(F.col("score"), strict))

    made = {"vec": vec, "text": lambda: text(corpus.text, 1), "semantic": lambda: text(corpus.semantic, 2), "historical_symbol": historical, "head_symbol": head}
    return {name: made[name] for name in LANES if name in enabled and (name != "vec" or vector is not None)}


def _gathered(spark: SparkSession, made: dict[str, Callable[[], DataFrame]], counters: Counters, k: int) -> DataFrame:
    """The lanes' rows, made at the same time; the first k of each."""

    schema = pa.schema([("lane", pa.int32()), ("rank", pa.int32()), ("hunk_id", pa.int64()), ("similarity", pa.float64())])

    def rows(named: tuple[str, Callable[[], DataFrame]]) -> pa.Table:
        name, lane = named
        with counters.timed(f"lane_{name}") as n:
            found = lane().select(*schema.names).orderBy("rank", "hunk_id").limit(k).toArrow().cast(schema)
            n.append(found.num_rows)
        return found

    with ThreadPoolExecutor(len(made)) as pool:
        found = list(pool.map(rows, made.items()))
    return spark.createDataFrame(pa.concat_tables(found).combine_chunks()).coalesce(1)  # an empty chunk would end the rows


def find_pattern(
    corpus: Corpus,
    query: str,
    now: int,
    vector: list[float] | None = None,
    k: int = 5,
    language: str | None = None,
    since: int | None = None,
    rerank: bool = False,
    by_fusion: bool = False,
    scorer: ranking.Scorer | None = None,
    strict: bool = True,
    verdict: str = "compatible",
    extra: dict[str, Callable[[], DataFrame]] | None = None,
    counters: Counters | None = None,
) -> DataFrame:
    """The k best hits, with their place.

    By default hits are ordered as the engine we match does, by the first
    lane's similarity weighed by age; with by_fusion by their fused score,
    weighed alike.  A language must be given to filter by it; a time named in the
    query filters if none is given.  scorer gives logits of (query, texts) in place of the
    lexical one; strict is as for lanes(); extra are lanes beside the profile's, each making
    rows of lane, rank, hunk_id and similarity, of which the first lane_top_k count.  A verdict of needs_rebuild is refused.
    counters get the calls, the time and the rows of each lane and of the pool.
    """
    if verdict == "needs_rebuild":
        raise RebuildNeeded("the index has to be built again before it can be searched")
    parsed = intent.parse_query(query, now)
    profile = intent.PROFILES[parsed.intent]
    weights = profile.weights()
    since = parsed.since_unix if since is None else since
    made = lanes(corpus, query, vector, profile.lanes, weights.lane_top_k, language, since, strict=strict) | (extra or {})
    if not made:
        raise ValueError("no lane is enabled")
    spark = corpus.hunks.sparkSession
    counters = counters or Counters()
    pool = ranking.pool(ranking.fuse(_gathered(spark, made, counters, weights.lane_top_k), weights.rrf_k), weights.rerank_top_k)
    with counters.timed("pool") as n:
        few = pool.select("hunk_id", "rrf", "similarity", "pool_rank").toArrow().combine_chunks()  # 40 rows at most
        n.append(few.num_rows)
    ids, pool = few.column("hunk_id").to_pylist(), spark.createDataFrame(few).coalesce(1)
    own = corpus.hunks.where(F.col("hunk_id").isin(ids))
    wide = F.broadcast(F.broadcast(pool).join(own, "hunk_id")).join(corpus.commits, "commit_id")
    if rerank:
        wide = ranking.rerank_scores(wide, query, scorer=scorer)
    elif by_fusion:
        wide = wide.withColumn("similarity", F.col("rrf"))
    scored = ranking.weigh_by_age(wide, now, weights.recency_weight, weights.recency_half_life_days)
    top = scored.orderBy(F.desc("combined_score"), "pool_rank").limit(max(1, min(k, MOST_HITS)))
    excerpt, truncated = T.truncate_diff(F.col("diff_text"))
    named = symbols.symbols_by_hunk(top, corpus.hunk_symbols.where(F.col("hunk_id").isin(ids)))
    return named.select(
        "hunk_id",
        "commit_sha",
        F.col("message").alias("commit_message"),
        F.col("author").alias("commit_author"),
        T.rfc3339(F.col("ts")).alias("commit_date"),
        "file_path",
        "change_kind",
        excerpt.alias("diff_excerpt"),
        truncated.alias("diff_truncated"),
        "related_head_symbols",
        "similarity",
        F.col("recency").alias("recency_weight"),
        "combined_score",
        F.lit("INFERRED").alias("provenance"),
    )


def envelope(hits: DataFrame, status: dict, hint: str | None, verdict: str, profile: str) -> dict:
    """The few hits of an answer as plain data, best first, with what is known about the index."""
    rows = [r.asDict(recursive=True) for r in hits.orderBy(F.desc("combined_score")).collect()]
    return {"hits": rows, "_meta": {"index_status": status, "hint": hint, "compatibility": verdict, "query_profile": profile}}
