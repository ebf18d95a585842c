"""The k best matches of many queries without reading all postings of common words.

Documents of like length form blocks of BLOCK_DOCS at most, and the postings of a
term in a block are one row, a chunk, with the most occurrences and the shortest
document beside them.  From these follows the most that any document of a block can
score for a query.  The FIRST most promising blocks of a query give a k-th score; then
only blocks are read whose bound is not below it.  What is found is what scoring all finds.

A block is made of documents that come one after the other in a partition, so postings are
grouped and sorted where their documents are, and are not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracegrain.functions.session import arrow_batches, cut
from tracegrain.functions.text import tokens

BLOCK_DOCS, FIRST = 256, 4
#: Tokens of a block at most, or those of a single document.
BLOCK_TOKENS = 250_000
MADE = "term string, block long, n long, cf long, max_tf int, min_length long, hits array<struct<doc_id: bigint, length: bigint, positions: array<int>>>"
CHUNKS = f"segment string, {MADE}"
#: Bytes of a row group, about, so that a query's terms prune what is read.
GROUP_BYTES = 16 << 20
#: Bounds are taken to be as far off as this, of one, as sums are made in any order.
SLACK = 1e-9


def by_block() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What makes rows of MADE from batches (doc_id, term, positions, length) in which a document's rows stand together, a block at a time."""
    most_docs, most_tokens = BLOCK_DOCS, BLOCK_TOKENS

    def chunks(parts: list[pa.RecordBatch], block: int) -> pa.RecordBatch:
        doc_id, term, positions, length = (pa.concat_arrays([p.column(i) for p in parts]) for i in range(4))
        coded = term.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        n = np.bincount(code, minlength=len(coded.dictionary))
        ends = np.append(0, np.cumsum(n))
        tf = positions.value_lengths().to_numpy(zero_copy_only=False)[order]
        shortest = np.minimum.reduceat(length.to_numpy(zero_copy_only=False)[order], ends[:-1])
        at = pa.array(order)
        hits = pa.StructArray.from_arrays([doc_id.take(at), length.take(at), positions.take(at)], ["doc_id", "length", "positions"])
        made = [coded.dictionary, np.full(len(n), block), n, np.add.reduceat(tf.astype(np.int64), ends[:-1]), np.maximum.reduceat(tf, ends[:-1]), shortest, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), hits)]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in made], ["term", "block", "n", "cf", "max_tf", "min_length", "hits"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, docs, size, last = TaskContext.get().partitionId() << 32, [], 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            lengths, begin = batch.column(3).to_numpy(zero_copy_only=False)[starts], 0
            for own, start, more in zip(ids[starts].tolist(), starts.tolist(), lengths.tolist(), strict=True):
                if own != last:  # a document may go on in the next batch
                    if docs and (docs == most_docs or size + more > most_tokens):
                        yield chunks([*held, batch.slice(begin, start - begin)], block)
                        block, held, docs, size, begin = block + 1, [], 0, 0, start
                    docs, size, last = docs + 1, size + more, own
            held.append(batch.slice(begin))
        if held:
            yield chunks(held, block)

    return group


def write(spark: SparkSession, made: DataFrame, segment: str, path: str) -> DataFrame:
    """CHUNKS, written from rows of MADE, each file sorted by term and block."""
    rows = made.select(F.lit(segment).alias("segment"), *[F.col(c) for c in made.columns]).sortWithinPartitions("term", "block")
    with arrow_batches(spark):
        rows.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(CHUNKS).parquet(path)


def postings(chunks: DataFrame, *kept: str) -> DataFrame:
    """segment, term, block, kept, doc_id, length, positions: a row for each term of a document."""
    return chunks.select("segment", "term", "block", *kept, F.inline("hits"))


def term_counts(chunks: DataFrame) -> DataFrame:
    """What fulltext.term_counts has of the postings, from how many there are in each chunk."""
    return chunks.groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))


def visits(index, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """asked (qid, term, idf), the blocks that may hold matches, the k best of the first of them, and which others must be read."""
    from . import fulltext

    n_docs, avg_length = map(F.lit, index.known())
    words = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    need = words.groupBy("qid").agg(F.count("*").alias("need"))
    asked = cut(words.join(index.terms.select("term", "df"), "term").join(need, "qid").select("qid", "term", "need", fulltext.idf(n_docs, F.col("df")).alias("idf")))
    most = F.col("idf") * fulltext.saturation(F.col("max_tf"), F.col("min_length"), avg_length)
    bounds = index.blocks.drop("hits").join(asked, "term").groupBy("qid", "segment", "block").agg(F.sum(most).alias("bound"), F.count("*").alias("got"), F.first("need").alias("need"))
    may = cut(bounds.where("got = need").select("qid", "segment", "block", "bound"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "segment", "block"))
    first = may.withColumn("place", place).where(F.col("place") <= FIRST).drop("place")
    best = cut(_top(_scored(index, asked, first, avg_length), k))
    limit = best.where(F.col("rank") == k).select("qid", (-F.col("score")).alias("least"))
    rest = may.join(first.select("qid", "segment", "block"), ["qid", "segment", "block"], "left_anti").join(limit, "qid", "left")
    more = rest.where(F.col("least").isNull() | (F.col("bound") * (1 + SLACK) >= F.col("least"))).select("qid", "segment", "block")
    return asked, may, best, more


def _scored(index, asked: DataFrame, blocks: DataFrame, avg_length: Column) -> DataFrame:
    from . import fulltext

    wanted = cut(asked.join(blocks.select("qid", "segment", "block"), "qid"))  # or its size would be guessed, and chunks be shuffled
    found = postings(index.blocks.join(wanted, ["term", "segment", "block"]), "qid", "idf", "need")
    if index.dead is not None:
        found = found.join(index.dead, ["segment", "doc_id"], "left_anti")
    part = F.col("idf") * fulltext.saturation(F.size("positions"), F.col("length"), avg_length)
    hits = found.groupBy("qid", "doc_id").agg((-F.sum(part)).alias("score"), F.count("*").alias("got"), F.first("need").alias("need"))
    return hits.where("got = need").select("qid", "doc_id", "score")


def _top(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("score", "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index, queries: DataFrame, k: int) -> DataFrame:
    """qid, doc_id, score, rank: as fulltext.search_batch has them, over an index that has blocks."""
    asked, _, best, more = visits(index, queries, k)
    found = best.select("qid", "doc_id", "score").unionByName(_scored(index, asked, more, F.lit(index.known()[1])))
    return _top(found, k).select("qid", "doc_id", "score", "rank")
