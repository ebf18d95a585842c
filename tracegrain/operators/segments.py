"""A full-text index in immutable segments, which grows and shrinks without being built again.

A batch of documents becomes one segment: `forward` (doc_id, length, terms,
positions; a row a document), `chunks` (the same by term and block, sorted; operators.topk; what has
died can only make their bounds too large) and `terms` (term, df, cf).  Deleting writes a tombstone part: the ids, and what they take
away from the counts of terms.  Counts are summed over segments when a query asks for
its terms, so results are those of an index that was built at once.  Segments of like size are merged
when FANOUT of them have come together, without their dead.

What is there is a plain dictionary, `segments` with their sizes and `dead` with what
each part takes from them, which the caller keeps in its manifest.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.functions.session import arrow_batches
from tracegrain.functions.text import tokens

from . import topk
from .fulltext import COLUMN_GAP, TextIndex, few_tokens

FORWARD = "segment string, doc_id long, length long, terms array<string>, positions array<array<int>>"
TERMS = "term string, df long, cf long"
DEAD = "segment string, doc_id long"
DEAD_TERMS = "segment string, term string, df long, cf long"
#: Segments of like size, within a power of it, that are merged into one.
FANOUT = 8


def empty() -> dict:
    return {"segments": [], "dead": []}


def forward(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """doc_id, length, terms, positions of every document, one without tokens too; nothing is shuffled."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[tokens(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_tokens(batches):
            n_docs = batch.num_rows
            words, doc, pos, length = [], [], [], np.zeros(n_docs, np.int64)
            for i in range(1, batch.num_columns):
                lists = batch.column(i)
                n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                words.append(lists.flatten())
                doc.append(np.repeat(np.arange(n_docs), n))
                pos.append(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (i - 1) * COLUMN_GAP)
                length += n
            coded = pa.concat_arrays(words).dictionary_encode()
            code, at, place = coded.indices.to_numpy(zero_copy_only=False), np.concatenate(doc), np.concatenate(pos).astype(np.int32)
            order = np.lexsort((place, code, at))
            at, code = at[order], code[order]
            first = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(code) != 0))) if len(at) else np.zeros(0, np.int64)
            per_doc = np.append(0, np.cumsum(np.bincount(at[first], minlength=n_docs))).astype(np.int32)
            terms = coded.dictionary.take(pa.array(code[first])).cast(pa.string()) if len(first) else pa.array([], pa.string())
            positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(place[order]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length), pa.ListArray.from_arrays(pa.array(per_doc), terms), pa.ListArray.from_arrays(pa.array(per_doc), positions)], ["doc_id", "length", "terms", "positions"])

    return rows.mapInArrow(group, "doc_id long, length long, terms array<string>, positions array<array<int>>")


def chunked(held: DataFrame) -> DataFrame:
    """Rows of topk.MADE from forward rows; nothing is shuffled."""
    block = topk.by_block()

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, length, terms, positions = batch.columns
            at = pa.array(np.repeat(np.arange(batch.num_rows), terms.value_lengths().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([doc_id.take(at), terms.flatten(), positions.flatten(), length.take(at)], ["doc_id", "term", "positions", "length"])

    rows = held.select("doc_id", "length", "terms", "positions").sortWithinPartitions("length", "doc_id")
    return rows.mapInArrow(lambda batches: block(flat(batches)), topk.MADE)


def _write(spark: SparkSession, root: str, rows: DataFrame) -> dict:
    """Write a segment of forward rows (doc_id, length, terms, positions); its name and size."""
    name = uuid.uuid4().hex
    here = f"{root}/{name}"
    columns = [c.split()[0] for c in FORWARD.split(", ")]
    with arrow_batches(spark):
        rows.withColumn("segment", F.lit(name)).select(columns).write.option("parquet.block.size", topk.GROUP_BYTES).parquet(f"{here}/forward")
    held = spark.read.schema(FORWARD).parquet(f"{here}/forward")
    size = held.agg(F.count("*").alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    chunks = topk.write(spark, chunked(held), name, f"{here}/chunks")
    topk.term_counts(chunks).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{here}/terms")
    return {"id": name, "docs": size.docs, "length": size.length}


def add(spark: SparkSession, root: str, state: dict, docs: DataFrame, id_col: str, columns: list[str]) -> dict:
    """The state with one segment more, of docs; ids must be new or deleted."""
    made = _write(spark, root, forward(docs, id_col, columns))
    return state | {"segments": [*state["segments"], made]} if made["docs"] else state


def _read(spark: SparkSession, root: str, state: dict, table: str, schema: str, only: list[str] | None = None) -> DataFrame:
    names = [s["id"] for s in state["segments"] if only is None or s["id"] in only]
    return spark.read.schema(schema).parquet(*[f"{root}/{n}/{table}" for n in names]) if names else spark.createDataFrame([], schema)


def _dead(spark: SparkSession, root: str, state: dict, table: str, schema: str) -> DataFrame | None:
    """Rows of tombstone parts about segments that are still there."""
    if not state["dead"]:
        return None
    found = spark.read.schema(schema).parquet(*[f"{root}/{d['id']}/{table}" for d in state["dead"]])
    return found.where(F.col("segment").isin([s["id"] for s in state["segments"]]))


def _living(rows: DataFrame, dead: DataFrame | None) -> DataFrame:
    return rows if dead is None else rows.join(dead, ["segment", "doc_id"], "left_anti")


def delete(spark: SparkSession, root: str, state: dict, ids: DataFrame) -> dict:
    """The state without the documents of ids (doc_id); those that aren't there are passed over."""
    gone = _living(_read(spark, root, state, "forward", FORWARD), _dead(spark, root, state, "dead", DEAD)).join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    name = uuid.uuid4().hex
    gone.select("segment", "doc_id", "length", "terms", F.transform("positions", F.size).alias("counts")).write.parquet(f"{root}/{name}/gone")
    held = spark.read.parquet(f"{root}/{name}/gone")
    sizes = held.groupBy("segment").agg(F.count("*").alias("docs"), F.sum("length").alias("length")).collect()  # a row a segment
    if not sizes:
        return state
    held.select("segment", "doc_id").write.parquet(f"{root}/{name}/dead")
    each = held.select("segment", F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    taken = each.groupBy("segment", F.col("t.terms").alias("term")).agg(F.count("*").alias("df"), F.sum(F.col("t.counts").cast("long")).alias("cf"))
    taken.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{root}/{name}/dead_terms")
    return state | {"dead": [*state["dead"], {"id": name, "of": {r.segment: [r.docs, r.length] for r in sizes}}]}


def size(state: dict) -> tuple[int, int]:
    """Documents and tokens that live."""
    there = {s["id"] for s in state["segments"]}
    away = [x for d in state["dead"] for segment, x in d["of"].items() if segment in there]
    return tuple(sum(s[key] for s in state["segments"]) - sum(x[i] for x in away) for i, key in enumerate(("docs", "length")))


def view(spark: SparkSession, root: str, state: dict) -> TextIndex:
    """The living documents as one index to search."""
    chunks, dead = _read(spark, root, state, "chunks", topk.CHUNKS), _dead(spark, root, state, "dead", DEAD)
    terms = _read(spark, root, state, "terms", TERMS)
    taken = _dead(spark, root, state, "dead_terms", DEAD_TERMS)
    if taken is not None:
        terms = terms.unionByName(taken.select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf")))
    if len(state["segments"]) != 1 or taken is not None:
        terms = terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
    n, total = size(state)
    stats = spark.range(1).select(F.lit(n).cast("long").alias("n_docs"), F.lit(total / n if n else 0.0).alias("avg_length"))
    return TextIndex(_living(topk.postings(chunks), dead), stats, terms, blocks=chunks, dead=dead, _known=(n, total / n if n else 0.0))


def _tier(docs: int) -> int:
    return int(math.log(max(docs, 1), FANOUT))


def to_merge(state: dict, fanout: int = FANOUT) -> list[str]:
    """The segments of the smallest tier that has enough of them."""
    tiers: dict[int, list[str]] = {}
    for s in state["segments"]:
        tiers.setdefault(_tier(s["docs"]), []).append(s["id"])
    return next((names for _, names in sorted(tiers.items()) if len(names) >= fanout), [])


def merge(spark: SparkSession, root: str, state: dict, names: list[str]) -> dict:
    """The state with one segment in place of those named, without their dead."""
    rows = _living(_read(spark, root, state, "forward", FORWARD, names), _dead(spark, root, state, "dead", DEAD))
    made = _write(spark, root, rows.drop("segment"))
    kept = [s for s in state["segments"] if s["id"] not in names]
    there = {s["id"] for s in kept}
    dead = [d | {"of": {k: x for k, x in d["of"].items() if k in there}} for d in state["dead"]]
    return {"segments": [*kept, *([made] if made["docs"] else [])], "dead": [d for d in dead if d["of"]]}


def folders(state: dict) -> list[str]:
    return [x["id"] for x in (*state["segments"], *state["dead"])]
