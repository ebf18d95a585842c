"""Resampling of documents by importance: how much likelier a target's word runs make a text than the corpus does.

Features are the runs of 1 to `longest` consecutive words, hashed by CRC-32 into
`buckets`.  Each task holds the runs it meets in a trie of words: a node has how
often its run came and the CRC of the run's bytes, so that a longer run takes up
its parent's CRC and hashes its last word alone.  A trie that has MOST_NODES is
emptied into the task's bucket totals, which is all that leaves a task; they are
added up into a row a bucket.  Scoring walks the same paths in tries whose nodes
hold the gain of their bucket in place of a count.

A document's score is its weight and a Gumbel number that its id alone decides, so
the highest scores are a draw without replacement by exp(weight).  Ranks are made
by a scan over ranges of the order (common.running), not in one task.

Defined cases: a null text has no words and so no features and weight 0; a null
doc_id is hashed as an empty one and comes last among ties; rows that repeat an id
are drawn each for itself, those with the same text in any order; texts are taken
whole, however long; an empty target or corpus has totals of zero; an empty table
gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LONGEST, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Nodes that a task's trie holds before it is emptied, and texts are cut into words so many bytes at a time.
MOST_NODES, SLICE = 500_000, 1 << 20

#: A-Z become a-z; whatever is no digit, letter or byte of a longer character becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a slice of it at a time; no word is cut."""
    start = 0
    while start < len(text):
        stop = min(start + SLICE, len(text))
        piece = text[start:stop].translate(_FOLD)
        if stop < len(text):
            cut = piece.rfind(b" ")
            while cut < 0 and stop < len(text):  # a word longer than a slice
                more = text[stop : stop + SLICE].translate(_FOLD)
                cut = more.find(b" ")
                cut = cut + len(piece) if cut >= 0 else cut
                piece, stop = piece + more, min(stop + SLICE, len(text))
            if cut >= 0:
                stop, piece = start + cut, piece[:cut]
        yield piece.split()
        start = stop


class Node(dict):
    """A run of words: the nodes of the runs that go on from it, the CRC of its bytes, and a count or a gain."""

    __slots__ = ("trie", "crc", "value")

    def __missing__(self, word: bytes) -> Node:
        trie = self.trie
        node = self[word] = Node()
        node.trie, node.crc = trie, zlib.crc32(word if self is trie.root else b" " + word, self.crc)
        node.value = 0 if trie.gains is None else trie.gains[node.crc % len(trie.gains)]
        trie.nodes += 1
        return node


class Trie:
    """The runs that a task has met, by their words."""

    def __init__(self, longest: int, gains: np.ndarray | None = None):
        self.longest, self.gains = longest, None if gains is None else gains.tolist()
        self.clear()

    def clear(self) -> None:
        self.root, self.nodes = Node(), 0
        self.root.trie, self.root.crc, self.root.value = self, 0, 0

    def walk(self, text: bytes) -> Iterator[tuple[int, list[Node]]]:
        """For each slice of a text the number of its words, and the nodes of all runs that end in it."""
        open_: list[Node] = []
        for found in words(text):
            if self.longest == 1:
                yield len(found), list(map(self.root.__getitem__, found))
                continue
            met: list[Node] = []
            for w in found:
                open_ = [run[w] for run in (*open_[1 - self.longest :], self.root)]
                met += open_
            yield len(found), met

    def add(self, text: bytes) -> None:
        for _, met in self.walk(text):
            for node in met:
                node.value += 1

    def totals(self, buckets: int) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        todo = list(self.root.values())
        while todo:
            node = todo.pop()
            out[node.crc % buckets] += node.value
            todo += node.values()
        return out


def bucket_totals(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, text_col: str = "text", most_nodes: int = MOST_NODES) -> DataFrame:
    """bucket, n: how often features of all texts fall into each bucket that is met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(longest), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in common.values(batch.column(0)):
                if text:
                    trie.add(text)
                    if trie.nodes >= most_nodes:
                        out += trie.totals(buckets)
                        trie.clear()
        out += trie.totals(buckets)
        have = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(out[have])], ["bucket", "n"])

    return texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket, from (bucket, n) of both, a row a bucket at most."""
    totals = []
    for df in (corpus, target):
        counts = np.zeros(buckets, np.int64)
        for r in df.collect():
            counts[r.bucket] = r.n
        totals.append((counts.tolist(), int(counts.sum())))
    (s, s_all), (t, t_all) = totals
    return np.array([math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)], np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", most_nodes: int = MOST_NODES) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # a long a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(longest, sent.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: tuple[list, ...] = ([], [], [], [])
            for doc_id, text in zip(ids, common.values(batch.column(1)), strict=True):
                n_words = n = total = 0
                for k, met in trie.walk(text or b""):
                    n_words, n, total = n_words + k, n + len(met), total + sum([node.value for node in met])
                weight = total // n if n else 0
                for column, value in zip(out, (n_words, n, weight, weight + gumbel(doc_id, seed)), strict=True):
                    column.append(value)
                if trie.nodes >= most_nodes:
                    trie.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in out]], ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def draw(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """scored with rank: 1, 2, 3 ... of the floor(percent * N / 100) highest scores among the N rows with enough words, else null."""
    enough = F.col("n_words") >= least_words
    # a row's place in what is written splits rows that are alike
    rows = common.stage(scored, "scored").withColumn("__row", F.monotonically_increasing_id())
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("__row")]
    ranked = common.running(rows.where(enough), order)
    drawn = percent * (ranked.agg(F.max("number").alias("n")).first().n or 0) // 100
    rank = F.when(F.col("number") <= drawn, F.col("number"))
    return ranked.withColumn("rank", rank).drop("number", "__row").unionByName(rows.where(~enough).drop("__row").withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row of docs; rank is null where a row is not drawn."""
    gain = gains(bucket_totals(docs, longest, buckets), bucket_totals(target, longest, buckets), buckets)
    return draw(score(docs, gain, longest, seed), least_words, percent)
