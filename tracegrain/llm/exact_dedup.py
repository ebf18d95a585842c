"""Exact deduplication through counting quotient filters.

Each partition of the documents builds a counting quotient filter (Pandey et
al., 2017) of its texts' fingerprints: a fingerprint's quotient is its place,
its remainder is stored there, sorted within the quotient's run, with a count.
As the stored order is the fingerprints' order, filters of the same range merge
losslessly by one pass over sorted remainders.  Fingerprints whose merged count
is one belong to documents without a copy, which are done; the texts of all
others are compared byte by byte.

Defined cases: a null text equals the empty one; texts are equal if identical
after lower-casing A-Z, very long ones by all their bytes; a null doc_id ranks
below all others; rows that tie with the row that stays, in doc_id and text, are
kept with it, as the same document; other columns are not read, whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


class CountingQuotientFilter:
    """The multiset of 64-bit fingerprints that start with the same `skip` bits.

    `occupied` has a bit for each of the 2**q quotients, `run_end` one for each
    stored remainder; `remainders` and `counts` are aligned and hold the runs
    one after the other.
    """

    def __init__(self, skip: int, prefix: int, fingerprints: np.ndarray, counts: np.ndarray):
        """fingerprints: uint64, ascending and distinct."""
        n = len(fingerprints)
        self.skip, self.prefix = skip, prefix
        self.q = max(3, int(n - 1).bit_length() if n > 1 else 3)
        self.r = 64 - skip - self.q
        body = fingerprints & np.uint64((1 << (64 - skip)) - 1)
        quotient = (body >> np.uint64(self.r)).astype(np.int64)
        self.remainders = body & np.uint64((1 << self.r) - 1)
        self.counts = counts.astype(np.uint64)
        occupied = np.zeros(1 << self.q, np.uint8)
        occupied[quotient] = 1
        self.occupied = np.packbits(occupied)
        self.run_end = np.packbits(np.append(quotient[1:] != quotient[:-1], True).astype(np.uint8)) if n else np.zeros(0, np.uint8)

    @classmethod
    def of(cls, skip: int, prefix: int, fingerprints: np.ndarray, weights: np.ndarray | None = None) -> CountingQuotientFilter:
        """Of fingerprints in any order, repeats included."""
        order = np.argsort(fingerprints, kind="stable")  # merges runs that are sorted already
        ordered = fingerprints[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
        counts = np.add.reduceat(weights[order], first) if weights is not None and len(first) else np.diff(np.append(first, len(ordered)))
        return cls(skip, prefix, ordered[first], counts)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct fingerprints, ascending, and their counts."""
        n = len(self.remainders)
        ends = np.unpackbits(self.run_end, count=n)
        run = np.cumsum(np.append(0, ends[:-1])) if n else np.zeros(0, np.int64)
        quotient = np.flatnonzero(np.unpackbits(self.occupied))[run].astype(np.uint64)
        head = np.uint64(self.prefix << (64 - self.skip)) if self.skip else np.uint64(0)
        return head | (quotient << np.uint64(self.r)) | self.remainders, self.counts

    def count(self, fingerprint: int) -> int:
        body = fingerprint & ((1 << (64 - self.skip)) - 1)
        quotient, remainder = body >> self.r, body & ((1 << self.r) - 1)
        occupied = np.unpackbits(self.occupied)
        if not occupied[quotient]:
            return 0
        run = int(occupied[:quotient].sum())
        ends = np.flatnonzero(np.unpackbits(self.run_end, count=len(self.remainders)))
        first, last = (int(ends[run - 1]) + 1 if run else 0), int(ends[run]) + 1
        at = first + int(np.searchsorted(self.remainders[first:last], np.uint64(remainder)))
        return int(self.counts[at]) if at < last and int(self.remainders[at]) == remainder else 0

    def to_bytes(self) -> bytes:
        """Remainders in as many bytes as they need; counts in one byte each, or all in eight."""
        width = (self.r + 7) // 8
        narrow = np.ascontiguousarray(self.remainders.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
        wide = bool(len(self.counts) and self.counts.max() > 255)
        head = np.array([self.skip, self.prefix, self.q, len(self.remainders), wide], "<i8").tobytes()
        return head + self.occupied.tobytes() + self.run_end.tobytes() + narrow.tobytes() + self.counts.astype("<u8" if wide else "u1").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        self = cls.__new__(cls)
        skip, prefix, q, n, wide = np.frombuffer(data, "<i8", 5).tolist()
        self.skip, self.prefix, self.q, self.r = skip, prefix, q, 64 - skip - q
        at, width = 40, (self.r + 7) // 8
        self.occupied = np.frombuffer(data, np.uint8, (1 << q) // 8, at)
        at += len(self.occupied)
        self.run_end = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
        at += len(self.run_end)
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        self.remainders = full.reshape(-1).view("<u8").astype(np.uint64)
        self.counts = np.frombuffer(data, "<u8" if wide else "u1", n, at + n * width).astype(np.uint64)
        return self


def merge(filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
    """The filter of all that any of the filters, which share a prefix, has counted."""
    parts = [f.entries() for f in filters]
    return CountingQuotientFilter.of(filters[0].skip, filters[0].prefix, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, fp (64-bit fingerprint) and sha (SHA-256) of each normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, shas = np.empty(batch.num_rows, np.uint64), []
            for i, text in enumerate(common.values(batch.column(2))):
                normal = (text or b"").lower()  # bytes.lower() touches A-Z only
                fps[i] = xxhash.xxh3_64_intdigest(normal)
                shas.append(hashlib.sha256(normal).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64)), pa.array(shas, pa.binary())], ["doc_id", "row_key", "fp", "sha"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, row_key long, fp long, sha binary")


def filters(fingerprints: DataFrame, skip: int) -> DataFrame:
    """block int, filter binary: a counting quotient filter for each partition and each prefix of `skip` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for batch in batches]
        ordered = np.sort(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
        block = (ordered >> np.uint64(64 - skip)).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
        blocks, payloads = [], []
        for a, b in zip(cuts, np.append(cuts, len(block))[1:], strict=True):
            blocks.append(int(block[a]))
            payloads.append(CountingQuotientFilter.of(skip, int(block[a]), ordered[a:b]).to_bytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(payloads, pa.binary())], ["block", "filter"])

    return fingerprints.select("fp").mapInArrow(run, "block int, filter binary")


#: Fingerprints of a block of merged filters, about.
BLOCK_ROWS = 1_000_000


def repeated(fingerprints: DataFrame, skip: int | None = None) -> DataFrame:
    """fp, n: the fingerprints that the merged filters count more than once.

    skip: bits that share out the filters; unless given, as many as make blocks
    of BLOCK_ROWS fingerprints, and 4 blocks to a shuffle partition.
    """
    blocks = max(4 * common.parallelism(fingerprints.sparkSession), -(-fingerprints.count() // BLOCK_ROWS))
    skip = skip or max(4, (blocks - 1).bit_length())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, counts = merge([CountingQuotientFilter.from_bytes(x) for x in pdf["filter"]]).entries()
        many = counts > 1
        return pd.DataFrame({"fp": fps[many].view(np.int64), "n": counts[many].astype(np.int64)})

    return filters(fingerprints, skip).groupBy("block").applyInPandas(run, "fp long, n long")


def candidates(docs: DataFrame, fps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sha, normal: the normalised texts of the documents whose fingerprint is in fps.

    Up to BROADCAST_ROWS fingerprints, counted first, go to every worker, and
    no text is moved for a document without a copy; more of them meet the
    documents in a shuffled semi-join.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    few = fps.select("fp").limit(common.BROADCAST_ROWS + 1)
    wanted = None
    if few.count() <= common.BROADCAST_ROWS:
        wanted = spark.sparkContext.broadcast(np.sort(few.toArrow().column(0).to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None if wanted is None else wanted.value
        for batch in batches:
            ids, fp, sha, normal, size = [], [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), common.values(batch.column(1)), strict=True):
                low = (text or b"").lower()
                key = int(np.uint64(xxhash.xxh3_64_intdigest(low)).view(np.int64))
                if found is not None:
                    at = int(np.searchsorted(found, key))
                    if at == len(found) or found[at] != key:
                        continue
                ids.append(doc_id), fp.append(key), sha.append(hashlib.sha256(low).digest()), normal.append(low)
                size += len(low)
                if size > 16 << 20:
                    yield pack(ids, fp, sha, normal)
                    ids, fp, sha, normal, size = [], [], [], [], 0
            yield pack(ids, fp, sha, normal)

    def pack(ids: list, fp: list, sha: list, normal: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fp, pa.int64()), pa.array(sha, pa.binary()), pa.array(normal, pa.binary())], ["doc_id", "fp", "sha", "normal"])

    out = rows.mapInArrow(run, "doc_id long, fp long, sha binary, normal binary")
    return out if wanted is not None else out.join(fps.select("fp"), "fp", "left_semi")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, row_key for every row.

    Copies are grouped by their bytes; equal texts of a partition meet there,
    so a group of any size sends one row a partition.  The groups come back to
    the documents by SHA-256, in a join that Spark splits where it is skewed.
    """
    marks = common.stage(digests(docs, id_col, text_col), "digests")
    again = common.stage(repeated(marks), "repeated")
    groups = (
        candidates(docs, again, id_col, text_col)
        .groupBy("sha", "normal")  # the digest is a key too, as a buffer of bytes would rule out hash aggregation
        .agg(F.max("doc_id").alias("largest"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("sha", "largest", "copies", F.lit(True).alias("found"))
    )
    keep = F.when(F.col("found"), F.col("largest")).otherwise(F.col("doc_id"))
    return (
        marks.join(groups, "sha", "left")
        .withColumn("keep_id", keep)
        .select(
            "doc_id",
            "keep_id",
            F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
            "row_key",
        )
    )
