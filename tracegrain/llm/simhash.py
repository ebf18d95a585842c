"""SimHash near-duplicates, with candidates found by pigeonring filtering (Qin and Xiao, 2018).

The 64 bits of a fingerprint lie on a ring of five segments.  Two fingerprints
that differ in four bits or fewer differ in 4/5 of a bit a segment on average,
so there is a segment from where on, all around the ring, the differences up to
each segment stay within their share: none in the first segment, one in the
first two, two in the first three, three in four, four in five.

The first three segments of such a chain are found by equality.  The second and
third are cut into halves; with one difference at most in the second and two in
both, at least one of five pairs of halves is free of differences.  A
fingerprint thus has 5 starts times 5 pairs = 25 keys of about 26 bits.  Among
the fingerprints of a key, the rest of the chain prunes pairs before the full
Hamming distance is looked at.

Only distinct fingerprints are compared, and only links that connect something
new within a key are kept, so a group of copies or near-copies of any size gives
no more links than members.  A key with very many fingerprints is cut into
chunks, and each two chunks meet in a task of their own.

Defined cases: a null text has no words; a text without words has fingerprint
zero, which links like any other; a null doc_id has a fingerprint and links, and
is never the smallest of a component unless all are null; rows that repeat share
their component; a bit set in exactly half of the shingles is zero; a very long
text counts with all its shingles; other columns are not read, whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Widths of the ring's half-segments, from the lowest bit; two make a segment.
HALVES = (7, 6, 7, 6, 7, 6, 7, 6, 6, 6)
#: Pairs of the four halves of the second and third segment.
PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3))
#: Fingerprints of a key that one task compares with each other.
CHUNK = 2048


def simhash(text: bytes | None, k: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's shingles of k words, hashed by XXH64."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    flat = b" ".join(words)
    xxh = xxhash.xxh64_intdigest
    if len(words) <= k:
        return xxh(flat, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = len(words) - k + 1
    hashes = np.fromiter([xxh(flat[i:j], SEED) for i, j in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 255 * 256):  # sums of 255 bits fit a byte
        bits = np.unpackbits(hashes[at : at + 255 * 256].view(np.uint8), bitorder="little").reshape(-1, 64)
        whole = len(bits) // 255 * 255
        if whole:
            ones += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
        ones += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, fp (the fingerprint as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(text, k) for text in common.values(batch.column(2))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "row_key", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, row_key long, fp long")


def _mask(halves: list[int]) -> int:
    """The bits of the given half-segments."""
    mask = 0
    for h in halves:
        low = sum(HALVES[:h])
        mask |= ((1 << HALVES[h]) - 1) << low
    return mask


def _key_masks() -> list[int]:
    """For each of the 25 keys, the bits that must be equal."""
    found = []
    for start in range(5):
        second, third = (start + 1) % 5, (start + 2) % 5
        own = [2 * second, 2 * second + 1, 2 * third, 2 * third + 1]
        found += [_mask([2 * start, 2 * start + 1, own[a], own[b]]) for a, b in PAIRS]
    return found


def _chain_masks(start: int) -> list[tuple[np.uint64, int]]:
    """The bits of the first 2, 3, 4 and 5 segments of a chain, and the differences they may have."""
    return [(np.uint64(_mask([h for s in range(n) for h in (2 * ((start + s) % 5), 2 * ((start + s) % 5) + 1)])), n * DISTANCE // 5) for n in (2, 3, 4, 5)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def keys(fp: Column) -> Column:
    """A fingerprint's 25 keys: structs of the key's number and the bits it fixes."""
    return F.array(*[F.struct(F.lit(i).cast("byte").alias("k"), fp.bitwiseAND(F.lit(_signed(mask))).alias("bits")) for i, mask in enumerate(_key_masks())])


def spanning(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links that connect what chains from `start` connect among fps, at most one a fingerprint."""
    masks = _chain_masks(start)
    rest, links = np.arange(len(fps)), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            differ = fps[rest] ^ fps[at]
            near = np.arange(len(rest))
            for mask, budget in masks:  # the chain's prefixes prune; the last is the whole distance
                near = near[np.bitwise_count(differ[near] & mask) <= budget]
            if len(near):
                met = rest[near]
                links += [(at, int(m)) for m in met]
                queue += met.tolist()
                rest = np.delete(rest, near)
    return links


def links(distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """u, v: links between fingerprints of distance DISTANCE or less that connect all that such links connect."""
    keyed = distinct.select("fp", F.explode(keys(F.col("fp"))).alias("key")).select("key.k", "key.bits", "fp")
    shared = keyed.groupBy("k", "bits").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(common.by_shuffle(shared), ["k", "bits"])
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    met = met.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    units = met.groupBy("k", "bits", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(F.collect_list("fp").alias("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            begin = 0
            for k, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                fps = flat[begin:end]
                begin = end
                for a, b in spanning(fps.view(np.uint64), k // len(PAIRS)):
                    us.append(int(fps[a])), vs.append(int(fps[b]))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return units.select("k", "fps").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id (the smallest doc_id reachable), row_key for every row."""
    marks = common.stage(fingerprints(docs, k, id_col, text_col), "simhash")
    classes = common.stage(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = connected_components(links(classes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = classes.join(common.by_shuffle(roots), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = common.stage(rooted.join(least, "root").select("fp", "component_id"), "simhash-named")
    return marks.join(common.by_shuffle(named), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "row_key")
