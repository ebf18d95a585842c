"""Nearest neighbours by Euclidean distance over vectors that stand sorted by cell, exact and without a scan of all.

Vectors are dealt to the nearest of some centroids and written by cell and by their
distance r to its centroid.  By the triangle inequality a vector is at least |d - r|
from a query that is d from the centroid, so once k candidates are known, all that can
be nearer lie in rings d - t <= r <= d + t of a few cells, t being the distance of
the k-th.  The nearest cells give the first candidates, the rings the rest: the
result is that of a scan, and row groups outside the rings are not read.

Centroids are fitted on a sample of SAMPLE rows at most; every row is dealt and
searched.  Vectors that are null, or hold null or what is not finite, are left out.  The state is a plain dictionary for the
caller's manifest: parts, with the rows and the radius of each cell.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracegrain.functions.session import cut
from tracegrain.functions.vectors import distance_similarity, l2_distance, literal

CELL_ROWS, MOST_CELLS, SAMPLE, ROUNDS = 512, 1024, 16_384, 8
#: A table is dealt anew when it has grown by this factor since its centroids were fitted.
GROWTH = 4
#: Distances of floats are taken to be as far off as this, of one.
SLACK = 1e-6
#: Cells that a filter names one by one; more are told by a join alone.
MOST_NAMED = 64
#: Bytes of a row group, so that a few cells' rows can be read without the rest.
BLOCK = 4 << 20
#: Rows of a cell that stand in one place, about, and queries that meet them at a time.
UNIT_ROWS, AT_ONCE = 16_384, 256
ROWS = "cell int, r double, id long, vector array<float>"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def fit(sample: np.ndarray, cells: int, seed: int = 1) -> np.ndarray:
    """Centroids of a sample: rows drawn by the square of their distance to those before, then Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    few = sample[rng.choice(len(sample), min(4 * cells, len(sample)), replace=False)]
    centres = few[:1].copy()
    left = ((few - centres[0]) ** 2).sum(1)
    while len(centres) < cells and left.sum() > 0:
        centres = np.append(centres, few[rng.choice(len(few), 1, p=left / left.sum())], 0)
        left = np.minimum(left, ((few - centres[-1]) ** 2).sum(1))
    for _ in range(ROUNDS):
        own = _nearest(sample, centres)[0]
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)
    return np.sqrt(np.maximum(square, 0))


def _exact(query: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(((centres - query) ** 2).sum(1))


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = np.concatenate([_distances(rows[i : i + 4096], centres).argmin(1) for i in range(0, len(rows), 4096)]) if len(rows) else np.zeros(0, np.int64)
    return own, np.sqrt(((rows - centres[own]) ** 2).sum(1))


@dataclass
class CellIndex:
    rows: DataFrame
    centres: np.ndarray
    #: rows and largest r of each cell
    counts: np.ndarray
    radii: np.ndarray


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull() & ~odd).select(F.col(id_col).cast("long").alias("id"), v.cast("array<float>").alias("vector"))


def _part(spark: SparkSession, root: str, rows: DataFrame, centres: np.ndarray) -> dict:
    sent, dim = spark.sparkContext.broadcast(centres), centres.shape[1]  # MOST_CELLS rows at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, r = _nearest(_matrix(batch.column(1), dim), sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(r), *batch.columns], ["cell", "r", "id", "vector"])

    return _sorted(spark, root, rows.mapInArrow(deal, ROWS))


def _sorted(spark: SparkSession, root: str, dealt: DataFrame) -> dict:
    """Write rows that are dealt, by cell and r; the part's name, rows and radii."""
    name = uuid.uuid4().hex
    dealt.repartitionByRange("cell", "r").sortWithinPartitions("cell", "r").write.option("parquet.block.size", BLOCK).parquet(f"{root}/{name}")
    sizes = spark.read.schema(ROWS).parquet(f"{root}/{name}").groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("radius")).collect()  # a row a cell
    return {"id": name, "cells": {str(s.cell): [s.n, s.radius] for s in sizes}}


def build(spark: SparkSession, root: str, vectors: DataFrame, id_col: str = "hunk_id", vector_col: str = "vector") -> dict:
    """The state of an index of all vectors."""
    rows = _usable(vectors, id_col, vector_col)
    n = rows.count()
    if not n:
        return {"parts": [], "centres": None, "fitted": 0}
    share = min(1.0, 1.2 * SAMPLE / n)
    drawn = (rows.sample(False, share, 42) if share < 1 else rows).select("vector").limit(SAMPLE).toArrow()["vector"]
    held = drawn.combine_chunks() if drawn.num_chunks != 1 else drawn.chunk(0)
    sample = np.array(held.to_pylist(), np.float64)
    centres = fit(sample, max(1, min(MOST_CELLS, n // CELL_ROWS)))
    name = f"centres-{uuid.uuid4().hex}"
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{root}/{name}")
    return {"parts": [_part(spark, root, rows, centres)], "centres": name, "fitted": n}


def _centres(spark: SparkSession, root: str, state: dict) -> np.ndarray:
    return np.array([r.centre for r in spark.read.parquet(f"{root}/{state['centres']}").orderBy("cell").collect()])


def size(state: dict) -> int:
    return sum(n for p in state["parts"] for n, _ in p["cells"].values())


def add(spark: SparkSession, root: str, state: dict, vectors: DataFrame, id_col: str = "hunk_id", vector_col: str = "vector") -> dict:
    """The state with vectors dealt to the cells there are; without cells they are fitted to these."""
    if not state or not state["parts"]:
        return build(spark, root, vectors, id_col, vector_col)
    made = _part(spark, root, _usable(vectors, id_col, vector_col), _centres(spark, root, state))
    return state | {"parts": [*state["parts"], made]} if made["cells"] else state


def delete(spark: SparkSession, root: str, state: dict, ids: DataFrame) -> dict:
    """The state without the vectors of ids (id); parts that hold some are written again."""
    parts, changed = [], False
    for p in state["parts"]:
        rows = spark.read.schema(ROWS).parquet(f"{root}/{p['id']}")
        if not rows.join(ids.select("id"), "id", "left_semi").limit(1).count():
            parts.append(p)
            continue
        changed = True
        made = _sorted(spark, root, rows.join(ids.select("id"), "id", "left_anti").select("cell", "r", "id", "vector"))
        parts += [made] if made["cells"] else []
    return state | {"parts": parts} if changed else state


def merge(spark: SparkSession, root: str, state: dict) -> dict:
    """The state with one part in place of all."""
    return state | {"parts": [_sorted(spark, root, spark.read.schema(ROWS).parquet(*[f"{root}/{p['id']}" for p in state["parts"]]))]}


def folders(state: dict) -> list[str]:
    return [*[p["id"] for p in state["parts"]], *([state["centres"]] if state["centres"] else [])]


def view(spark: SparkSession, root: str, state: dict) -> CellIndex | None:
    """What is searched; None if there is nothing."""
    if not state or not state["parts"]:
        return None
    centres = _centres(spark, root, state)
    counts, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for part in state["parts"]:
        for cell, (n, radius) in part["cells"].items():
            counts[int(cell)] += n
            radii[int(cell)] = max(radii[int(cell)], radius)
    return CellIndex(spark.read.schema(ROWS).parquet(*[f"{root}/{p['id']}" for p in state["parts"]]), centres, counts, radii)


def _first_cells(index: CellIndex, d: np.ndarray, k: int) -> np.ndarray:
    """The nearest cells that hold k rows together."""
    order = np.argsort(d, kind="stable")
    order = order[index.counts[order] > 0]
    return order[: int(np.searchsorted(np.cumsum(index.counts[order]), k)) + 1]


def _named(cells: list[int]) -> Column:
    return F.col("cell").isin(cells) if len(cells) <= MOST_NAMED else F.lit(True)


def nearest(index: CellIndex, query: list[float], k: int, id_col: str = "hunk_id") -> DataFrame:
    """The k nearest of one query: id, distance, similarity; rows outside the rings are not read."""
    spark = index.rows.sparkSession
    d = _exact(np.array(query, np.float64), index.centres)
    distance = l2_distance(F.col("vector"), literal(query)).alias("distance")
    first = _first_cells(index, d, k).tolist()
    near = index.rows.where(F.col("cell").isin(first)).select("id", distance).orderBy("distance", "id").limit(k)
    got = near.toArrow().combine_chunks()  # k rows
    t = got["distance"][-1].as_py() * (1 + SLACK) if got.num_rows == k else float("inf")
    rest = [c for c in np.flatnonzero((index.counts > 0) & (d - index.radii <= t + SLACK)).tolist() if c not in set(first)]
    found = spark.createDataFrame(got)
    if rest:
        rings = spark.createDataFrame(pa.table({"c": pa.array(rest, pa.int32()), "lo": d[rest] - t - SLACK, "hi": d[rest] + t + SLACK}))
        ring = index.rows.where(_named(rest) & F.col("r").between(float((d[rest] - t).min() - SLACK), float((d[rest] + t).max() + SLACK)))
        more = ring.join(F.broadcast(rings), F.col("cell") == F.col("c")).where("r between lo and hi")  # MOST_CELLS rows at most
        found = found.unionByName(more.select("id", distance))
    top = found.orderBy("distance", "id").limit(k)
    return top.select(F.col("id").alias(id_col), "distance", distance_similarity(F.col("distance")).alias("similarity"))


def _best(ids: np.ndarray, rows: np.ndarray, qids: np.ndarray, queries: np.ndarray, most: np.ndarray, k: int) -> pa.RecordBatch:
    """qid, id, distance: of each query the k nearest rows, none of them farther than most."""
    scale = (rows**2).sum(1)
    square = scale - 2 * queries @ rows.T + (queries**2).sum(1)[:, None]
    out: list[list[np.ndarray]] = [[], [], []]
    for i, q in enumerate(queries):
        # products may be off by rounding, more so far from the origin: what is as near as the k-th but for that is computed exactly
        off = 1e-12 * len(q) * (scale.max() + (q**2).sum())
        cut = np.partition(square[i], k - 1)[k - 1] + 2 * off if len(ids) > k else np.inf
        at = np.flatnonzero(~(square[i] > cut))
        distance = np.sqrt(np.add.accumulate((rows[at] - q) ** 2, 1)[:, -1])  # from the first component to the last, as l2_distance adds them
        near = distance <= most[i] + SLACK
        at, distance = at[near], distance[near]
        top = np.lexsort((ids[at], distance))[:k]
        for held, x in zip(out, (np.full(len(top), qids[i]), ids[at][top], distance[top]), strict=True):
            held.append(x)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["qid", "id", "distance"])


def nearest_batch(index: CellIndex, queries: DataFrame, k: int, id_col: str = "hunk_id") -> DataFrame:
    """qid, id, distance, rank: the k nearest of each of any number of queries (qid, once each, and query).

    A query goes to the cells that it must see and meets their rows there, many
    queries at a time; k rows of a query leave a cell before they are shuffled.
    """
    spark = index.rows.sparkSession
    sent = spark.sparkContext.broadcast((index.centres, index.counts, index.radii))  # MOST_CELLS rows at most
    dim = index.centres.shape[1]

    def visits(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, counts, radii = sent.value
            held = CellIndex(None, centres, counts, radii)
            for batch in batches:
                d = np.array([_exact(q, centres) for q in _matrix(batch.column(1), dim)]).reshape(-1, len(centres))
                most = batch.column(2).to_numpy(zero_copy_only=False)
                at, cells = [], []
                for i in range(len(d)):
                    own = _first_cells(held, d[i], k)
                    if not first:
                        wanted = (counts > 0) & (d[i] - radii <= most[i] + SLACK)
                        wanted[own] = False
                        own = np.flatnonzero(wanted)
                    at.append(np.full(len(own), i))
                    cells.append(own)
                row, cell = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (at, cells))
                t = most[row]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(t)], ["qid", "query", "cell", "t"])

        return run

    asked = queries.where(F.col("query").isNotNull()).select(F.col("qid").cast("long").alias("qid"), F.col("query").cast("array<double>").alias("query"))
    schema = "qid long, query array<double>, cell int, t double"
    wide = [x for c in np.flatnonzero(index.counts > UNIT_ROWS).tolist() for x in (F.lit(c), F.lit(-(-int(index.counts[c]) // UNIT_ROWS)))]
    units = F.coalesce(F.element_at(F.create_map(*wide), F.col("cell")), F.lit(1)) if wide else F.lit(1)

    def met(visited: DataFrame) -> DataFrame:
        """The rows of each unit of a cell, and behind them the queries that visit it."""
        rows = index.rows.join(F.broadcast(visited.select("cell").distinct()), "cell", "left_semi")  # MOST_CELLS rows at most
        held = rows.select("cell", F.pmod(F.xxhash64("id"), units).cast("int").alias("unit"), F.lit(0).alias("kind"), "id", F.col("vector").cast("array<double>").alias("vector"), F.lit(None).cast("double").alias("t"))
        asks = visited.select("cell", F.explode(F.sequence(F.lit(0), units - 1)).alias("unit"), F.lit(1).alias("kind"), F.col("qid").alias("id"), F.col("query").alias("vector"), "t")
        return held.unionByName(asks).repartition("cell", "unit").sortWithinPartitions("cell", "unit", "kind").mapInArrow(scan, "qid long, id long, distance double")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                *own, kind = keys[a].tolist()
                if own != unit:
                    unit, held = own, []
                part = batch.slice(a, b - a)
                if kind == 0:
                    held.append((part.column(3).to_numpy(), _matrix(part.column(4), dim)))
                    continue
                if not held:
                    continue
                if len(held) > 1:
                    held = [tuple(np.concatenate(x) for x in zip(*held, strict=True))]
                for i in range(0, b - a, AT_ONCE):
                    some = part.slice(i, AT_ONCE)
                    yield _best(*held[0], some.column(3).to_numpy(), _matrix(some.column(4), dim), some.column(5).to_numpy(), k)

    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    near = cut(met(asked.withColumn("t", F.lit(float("inf"))).mapInArrow(visits(True), schema)).withColumn("rank", rank).where(F.col("rank") <= k))
    limit = near.groupBy("qid").agg(F.when(F.count("*") == k, F.max("distance") * (1 + SLACK)).otherwise(F.lit(float("inf"))).alias("t"))
    more = met(asked.join(limit, "qid").select("qid", "query", "t").mapInArrow(visits(False), schema))
    whole = near.drop("rank").unionByName(more).withColumn("rank", rank).where(F.col("rank") <= k)
    return whole.select("qid", F.col("id").alias(id_col), "distance", "rank")
