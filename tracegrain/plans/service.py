"""Asking one index many times: what is held between questions, and what they have cost."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from tracegrain.functions.counters import Counters
from tracegrain.functions.held import Held
from tracegrain.operators import chunking
from tracegrain.plans import explain, retrieve
from tracegrain.plans.index import DIM, Index
from tracegrain.sources import gitlog

#: Seconds that what is known about an index is held, and how many vectors of queries and blames are.
META_SECONDS, MOST_VECTORS, MOST_BLAMES = 5.0, 256, 64


class Service:
    """Answers from an index.

    Held are the state of the index for META_SECONDS, the vectors of queries,
    the blames of files at a commit, and the corpus of the tables' last state.
    """

    def __init__(self, index: Index, embedder: Callable = chunking.hashing_embedder, counters: Counters | None = None, clock: Callable[[], float] | None = None):
        self.index, self.embedder, self.counters = index, embedder, counters or Counters()
        self._meta = Held(16, META_SECONDS, **({"clock": clock} if clock else {}))
        self._vectors = Held(MOST_VECTORS)
        self._blames = Held(MOST_BLAMES, gone=DataFrame.unpersist)
        self._corpus = Held(1)

    def _vector(self, query: str) -> list[float]:
        return self._vectors.get(query, lambda: [float(x) for x in self.embedder(pd.Series([query]), DIM)[0]])

    def find_pattern(self, query: str, now: int, **options) -> DataFrame:
        """As retrieve.find_pattern, with the query's vector; lanes and the pool are counted."""
        state = json.dumps(self.index.state(), sort_keys=True)
        with self.counters.timed("corpus"):
            corpus = self._corpus.get(state, self.index.corpus)
        with self.counters.timed("embed_query"):
            vector = self._vector(query)
        return retrieve.find_pattern(corpus, query, now, vector, counters=self.counters, **options)

    def blame(self, repo: str, file: str) -> DataFrame:
        """The lines of a file at the head of a repository, and the commits that own them."""
        spark = self.index.spark
        spark.dataSource.register(gitlog.GitLog)
        key = (repo, gitlog.head_sha(repo), file)
        return self._blames.get(key, lambda: spark.read.format("gitlog").options(repo=repo, table="blame", file=file).load().cache())

    def explain_change(self, repo: str, file: str, start: int, end: int, k: int = 5, include_diff: bool = True) -> tuple[DataFrame, DataFrame]:
        """The commits behind a range of lines, and the row of what is known about the answer."""
        with self.counters.timed("blame"):
            blame = self.blame(repo, file)
        commits, hunks = self.index.commits(), self.index.hunks()
        return explain.explain_change(blame, commits, hunks, file, start, end, k, include_diff), explain.explain_meta(blame, commits, file, start, end)

    def status(self, commits: DataFrame) -> dict[str, object]:
        """As Index.status, at most META_SECONDS old."""

        def read() -> dict[str, object]:
            with self.counters.timed("get_index_status") as rows:
                rows.append(1)
                return self.index.status(commits)

        return self._meta.get("status", read)

    def metadata(self, repo: str) -> dict[str, str]:
        """As Index.metadata, at most META_SECONDS old."""

        def read() -> dict[str, str]:
            with self.counters.timed("get_index_metadata") as rows:
                found = self.index.metadata(repo)
                rows.append(len(found))
                return found

        return self._meta.get(("metadata", repo), read)

    def changed(self) -> None:
        """Forget what is known about the index, as after an ingest."""
        self._meta = Held(self._meta.most, self._meta.seconds, clock=self._meta.clock)
