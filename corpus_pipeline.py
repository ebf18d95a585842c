"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one
before has kept.  A stage's decisions about documents are found on narrow rows
and then meet the whole documents once, by id and text; texts are not shuffled
while the decisions are few enough to be broadcast.

For all stages: other columns go along, whatever their names; an empty table gives
an empty table; texts count as a whole, however long.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.llm import common, exact_dedup, language_id, mixing, packing, simhash
from tracegrain.llm.queries import TOKENIZER

#: The pipeline has stages that SQL cannot express.
ORACLE_SQL = None
#: A language is accepted if its chance among all is so high at least.
LEAST_CHANCE = 0.3
#: Bytes of texts that go to Python at a time, about.  Spark's own 64 MB are held by each task as a
#: buffer that doubles as it grows, and by its Python worker, beside all that earlier stages have left.
BATCH_BYTES = 4 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    """The stage with Arrow batches of BATCH_BYTES; all its jobs that hand texts to Python run before it returns."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with common.arrow_batches(spark, BATCH_BYTES):
            return stage(spark, docs, sf_dir)

    return run


def _known(docs: DataFrame) -> DataFrame:
    """doc (the whole row), doc_id, row_key."""
    return docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), common.row_key().alias("row_key"))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents whose doc_id and row_key are not in rejected, with docs' columns."""
    rejected = common.stage(rejected.select("doc_id", "row_key").distinct(), "rejected")
    return common.with_facts(_known(docs), rejected, "left_anti", broadcast=True).select("doc.*")


@_in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known; those without a letter, or of no language in particular, go.

    The chance among the languages says which fits best, the code length whether any fits.  Null and
    empty texts have no letter and go; a null lang teaches nothing; a null doc_id is judged like any
    other; rows that repeat are judged alike; a tie goes to the language first in order.
    """
    found = language_id.score(docs, language_id.train(docs))
    return _without(docs, found.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_CHANCE) | F.col("foreign")))


@_in_small_batches
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one document: that with the largest doc_id, and one row where rows share this id.

    A null text equals the empty one; a null doc_id ranks below all others.  Of rows that share the id the
    one with the smallest hash of id and text stays, and of those that tie in this too, the smallest row.
    """
    found = common.stage(exact_dedup.exact_dedup(docs), "copies")
    same = found.where("kept and group_size > 1").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"), F.min("row_key").alias("first")).where("n > 1")
    same = common.stage(same, "same-id")
    spare = common.with_facts(
        found.where("kept and group_size > 1"), same.select("doc_id", F.col("first").alias("row_key"), F.lit(True).alias("stays")), "left", broadcast=True
    ).where("stays is null").join(same.select("doc_id", "text_sha256").withColumnRenamed("doc_id", "same_id"), ["text_sha256"]).where(F.col("doc_id").eqNullSafe(F.col("same_id")))
    left = _without(docs, found.where(~F.col("kept")).select("doc_id", "row_key").unionByName(spare.select("doc_id", "row_key")))
    if not same.limit(1).count():
        return left
    twice = same.select("doc_id", F.col("first").alias("row_key"))
    once = common.with_facts(_known(left), twice, "left_semi", broadcast=True).groupBy("doc_id", "row_key").agg(F.min("doc").alias("doc")).select("doc.*")
    return common.with_facts(_known(left), twice, "left_anti", broadcast=True).select("doc.*").unionByName(once)


@_in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their fingerprints, the one with the smallest doc_id.

    The stage goes by the operator's contract: shingles of four words, four differing bits.  Texts without
    words link like any other; a null doc_id stays only where all of a group are null; rows that share the
    smallest doc_id all stay, as the stage before leaves one of each text.
    """
    return _without(docs, simhash.near_duplicates(docs).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))))


@_in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows that repeat id and text share their copies, rounded down.

    A null source is a source of its own; a document without words is taken like any other of its source,
    none of a source that has no words at all; ties in size go by hash.
    """
    taken = mixing.mix(docs).groupBy("doc_id", "row_key").agg(F.floor(F.avg("copies")).cast("int").alias("copies"))
    met = common.with_facts(_known(docs), common.stage(taken.where("copies > 0"), "taken"), "inner", broadcast=True)
    return met.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


@_in_small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes.

    A null or empty text is the end token alone; a long one is cut into full pieces; rows that repeat are packed each.
    """
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the table of documents; every stage but the last is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
