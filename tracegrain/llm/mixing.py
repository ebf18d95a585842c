"""Mixing sources to target weights by the cube method (Deville and Tille, 2004).

A source whose target is r times its size takes every document floor(r) times
and, with inclusion probability r - floor(r), once more.  Which documents these
are is drawn by the cube method, balanced on two totals of each source: its
documents and its words.  The flight phase moves the vector of probabilities
along directions that leave both totals as they are, until a bound stops it;
steps one way or the other have chances that keep every probability's mean.  It
runs in blocks of a source; the two or fewer fractional documents of each meet,
with a few that it keeps back, in blocks of blocks, until a source's documents fit
one.  There the flight takes the largest document first and lets all others make
up for it, so that the last to be settled are small ones.  The landing phase gives
up the balance of documents, then that of words, for the last two.  So a document
is included as often as its probability says, and a source's words miss the
target by less than the last document's.

Defined cases: a null text has no words; a null source is a source of its own,
ordered last; rows that repeat a document, all of it too, are drawn on their own;
equal sizes are taken by hash of id and text; sources without words have target 0;
a very long text is one document of its size; other columns are not read, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3.0, 1.0, 2.0)
#: Documents that one task moves at a time, about.
BLOCK = 2000
#: Documents that a block keeps fractional for the next group, which they help to balance.
RESERVE = 12


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, row_key, source, size (words) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(text.split()) if text else 0 for text in common.values(batch.column(3))]  # splits at ASCII white space
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], ["doc_id", "row_key", "source", "size"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.row_key(id_col, text_col).alias("row_key"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, row_key long, source string, size long")


def targets(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, n, target: a row a source.

    Sharing the excess of capped sources among the others by weight, until none
    is above its cap, ends where every uncapped target is the same level times
    its weight; sources reach their caps in the order of cap / weight.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    own = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    own = own.withColumn("reached", F.col("cap") / F.col("weight"))
    below = Window.orderBy("reached", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    own = own.withColumn("capped_before", F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
    own = own.withColumn("weight_from", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    # the level if all before this source are capped and it is not; the largest that stays within its own cap is right
    own = own.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("capped_before")) / F.col("weight_from"))
    level = F.max(F.when(F.col("level") <= F.col("reached"), F.col("level"))).over(everything)
    return own.withColumn("found", level).select(
        "source", "source_size", "n", F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("found") * F.col("weight"))).alias("target")
    )


def flight(p: np.ndarray, size: np.ndarray, rng: random.Random) -> np.ndarray:
    """Probabilities at 0 or 1 but for two at most, with the sums of p and of p * size unchanged.

    Up to three documents are held at a time.  A direction u of theirs with
    sum(u) = 0 and sum(u * size) = 0 is followed one way or the other, with
    chances that keep each probability's mean, to the first bound.
    """
    p = p.astype(float).tolist()
    size = size.tolist()
    held: list[int] = []
    for i in [k for k in range(len(p)) if 0.0 < p[k] < 1.0]:
        held.append(i)
        while len(held) > 1:
            s = [size[k] for k in held]
            pair = next(((a, b) for a in range(len(s)) for b in range(a + 1, len(s)) if s[a] == s[b]), None)
            if pair:
                u = [0.0] * len(s)
                u[pair[0]], u[pair[1]] = 1.0, -1.0
            elif len(s) == 3:
                u = [float(s[2] - s[1]), float(s[0] - s[2]), float(s[1] - s[0])]
            else:
                break
            up = min((1.0 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(held, u, strict=True) if x)
            down = min(p[k] / x if x > 0 else (1.0 - p[k]) / -x for k, x in zip(held, u, strict=True) if x)
            step = up if rng.random() < down / (up + down) else -down
            for k, x in zip(held, u, strict=True):
                p[k] += step * x
                if p[k] < 1e-9:
                    p[k] = 0.0
                elif p[k] > 1 - 1e-9:
                    p[k] = 1.0
            held = [k for k in held if 0.0 < p[k] < 1.0]
    return np.array(p)


def reserve(n: int) -> np.ndarray:
    """The ranks, by falling size, of the documents that a block keeps back: evenly spread below the largest."""
    return np.unique(np.linspace(n // 10, n - 1, min(RESERVE, n)).astype(int)) if n else np.zeros(0, int)


def _direction(size: np.ndarray, p: np.ndarray, totals: int) -> np.ndarray:
    """A move that leaves the first so many of words and documents as they are, and moves the largest document it can.

    It is what the totals leave of that document's own move, weighed by
    p * (1 - p), so that the others share in it as far as they are from a bound.
    """
    weight = p * (1 - p)
    kept = np.array([size / max(size.max(), 1.0), np.ones(len(size))])[:totals]
    weighed = kept * weight
    for k in np.argsort(-size, kind="stable"):
        own = np.zeros(len(size))
        own[k] = 1.0
        if totals:
            own -= kept.T @ np.linalg.lstsq(weighed @ kept.T, weighed[:, k], rcond=None)[0]
        move = weight * own
        if np.abs(kept @ move).max(initial=0.0) < 1e-9 * np.abs(move).max() and abs(move[k]) > 1e-9 * weight[k]:
            return np.where(np.abs(move) < 1e-12 * np.abs(move).max(), 0.0, move)
    return np.zeros(len(size))


def settle(p: np.ndarray, size: np.ndarray, rng: random.Random) -> np.ndarray:
    """All probabilities at 0 or 1, each with its mean kept: flight and landing of one group."""
    p, size = p.astype(float), size.astype(float)
    for totals in (2, 1, 0):
        while True:
            left = np.flatnonzero((p > 0) & (p < 1))
            move = _direction(size[left], p[left], totals) if len(left) > totals else np.zeros(0)
            if not move.any():
                break
            held, move = left[move != 0], move[move != 0]
            up = np.where(move > 0, (1 - p[held]) / np.abs(move), p[held] / np.abs(move)).min()
            down = np.where(move > 0, p[held] / np.abs(move), (1 - p[held]) / np.abs(move)).min()
            now = p[held] + (up if rng.random() < down / (up + down) else -down) * move
            p[held] = np.where(now < 1e-9, 0.0, np.where(now > 1 - 1e-9, 1.0, now))
    return p


def _seed(*names: object) -> random.Random:
    return random.Random(xxhash.xxh64_intdigest(repr(names).encode()))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, row_key, source, size, source_size, target, copies for every row."""
    # rows that are the same in all that counts are numbered, so that they fall into different blocks
    alike = sizes(docs, id_col, text_col, source_col).groupBy("doc_id", "row_key", "source", "size").agg(F.count("*").alias("times"))
    sized = common.stage(alike.withColumn("twin", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times"), "sizes")
    aims = targets(sized, share, most, weights)
    aims = aims.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    aims = aims.withColumn("base", F.floor("ratio").cast("int")).withColumn("p", F.col("ratio") - F.col("base"))
    aims = common.stage(aims.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none"), "source_size", "n", "target", "base", "p"), "targets")
    named = sized.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none"), "*")
    rows = common.attach(named, aims, ["name", "none"], "inner").drop("name", "none")
    rows = rows.withColumn("home", F.xxhash64("doc_id", "row_key", "twin", F.lit(seed))).drop("twin")

    fields = "doc_id long, row_key long, source string, size long, source_size long, n long, target double, base int, p double, home long"

    def fly(last: bool):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "home", "doc_id", "row_key"], ascending=[False, True, True, True], kind="stable")
            p, size, rng = pdf["p"].to_numpy(float).copy(), pdf["size"].to_numpy(), _seed(seed, *key, last, len(pdf))
            if last:
                p = settle(p, size, rng)
            else:
                flying = np.setdiff1d(np.arange(len(p)), reserve(len(p)))
                p[flying] = flight(p[flying], size[flying], rng)
            return pdf.assign(p=p)[[f.split()[0] for f in fields.split(", ")]]

        return run

    done, left = rows.where("p = 0"), rows.where("p > 0")
    most_left = aims.agg(F.max("n")).first()[0] or 0
    while most_left > BLOCK:
        block = F.expr(f"pmod(home, greatest(1L, cast(ceil(n / {BLOCK}D) as long)))")
        flown = common.stage(left.groupBy(F.col("source"), block.alias("block")).applyInPandas(fly(False), fields), "flight")
        done = done.unionByName(flown.where("p = 0 or p = 1"))
        left = flown.where("p > 0 and p < 1").withColumn("n", F.expr(f"cast(ceil(n / {BLOCK}D) * {RESERVE + 2} as long)"))
        most_left = -(-most_left // BLOCK) * (RESERVE + 2)
    landed = left.groupBy("source").applyInPandas(fly(True), fields)
    return done.unionByName(landed).select("doc_id", "row_key", "source", "size", "source_size", "target", (F.col("base") + F.col("p").cast("int")).alias("copies"))
