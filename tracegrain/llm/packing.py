"""Packing token sequences by best-two-fit.

Only lengths decide what goes together, and a piece has one of `room` lengths at
most, so the packing is made of the histogram of lengths.  A bin takes the
largest length left and then, greedily, the largest that fits the gap.  Then its
smallest piece is taken out if two pieces left over, neither in the bin, fill
the gap that this leaves more tightly.  The pattern found is used as often as
the histogram allows, so the work depends on the number of patterns and not on
that of pieces.  Pieces of a length are numbered, and a piece's number says
which bin of which pattern it goes to.

A full piece is a sequence of its own and needs no number.

Defined cases: a null text is empty and has the end token alone; documents
longer than a sequence, however long, are cut from their end into full pieces, so
that the first piece may be shorter; rows that repeat a document are packed each;
pieces of one length are taken in the order of doc_id, piece, start and CRC, and of
two pairs that fill a gap alike the one with the smaller piece; other columns are
not read, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

ROOM, END_ID = 2048, 0
#: Pieces of one length that are numbered in a task, about.
PART_ROWS = 100_000
WORDS_KEPT = 200_000
#: Bytes of texts that go to Python at a time, about, or a single text; Spark's own 64 MB are held by each task and by its worker.
BATCH_BYTES = 4 << 20
#: A space that doesn't start a word.
_LOOSE = re.compile(r" (?:\s|\Z)")


class WordTokenizer:
    """Token ids of a byte-level BPE vocabulary, encoded word by word with the words seen kept.

    In this vocabulary's pre-tokenisation a space before a non-space always
    starts a token, so the pieces between such spaces are independent.  A text
    that names a special token is encoded whole.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        ranks_path = path.rsplit(".", 1)[0] + ".tiktoken"
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        import public_tokenizers

        fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = fast.encode_ordinary

        class Kept(dict):
            def __missing__(self, word: str) -> bytes:
                ids = array("I", encode(" " + word)).tobytes()  # as np.array(..., "<u4"), in half the time
                if len(self) >= WORDS_KEPT:
                    self.clear()
                self[word] = ids
                return ids

        self.encode_ordinary, self.kept = encode, Kept()

    @functools.cached_property
    def exact(self):
        """For texts that name a special token, which few tasks meet."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *words = text.split(" ")
        if _LOOSE.search(text):
            joined, merged = [first], []
            for w in words:  # a space before white space or the end doesn't start a word
                if w and not w[0].isspace():
                    joined.append(w)
                else:
                    joined[-1] += " " + w
            first, words = joined[0], joined[1:]
        return np.array(self.encode_ordinary(first), "<u4").tobytes() + b"".join(map(self.kept.__getitem__, words))


def pieces(docs: DataFrame, tokenizer_path: str, room: int = ROOM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's token ids and the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), common.values(batch.column(1)), strict=True):
                ids = (tokenizer.ids(text.decode("utf-8", "replace")) if text else b"") + end
                n = len(ids) // 4
                start, stop, piece = 0, n % room or min(n, room), 0
                while start < n:
                    for column, value in zip(out, (doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])), strict=True):
                        column.append(value)
                    start, stop, piece = stop, stop + room, piece + 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(histogram: dict[int, int], room: int = ROOM) -> list[tuple[list[int], int]]:
    """Patterns (lengths, in order) and how many bins have each, by best-two-fit on a histogram of lengths."""
    left = np.zeros(room + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    patterns: list[tuple[list[int], int]] = []
    while left.any():
        free = left.copy()
        bin_: list[int] = []
        gap = room
        while gap:
            fits = np.flatnonzero(free[1 : gap + 1])
            if not len(fits):
                break
            length = int(fits[-1]) + 1
            many = int(min(free[length], gap // length))
            bin_ += [length] * many
            free[length] -= many
            gap -= many * length
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            two = _best_two(free, gap + smallest, smallest)
            if two:
                bin_[-1:] = two
        need = np.bincount(bin_, minlength=room + 1)
        used = np.flatnonzero(need)
        times = int((left[used] // need[used]).min())
        left[used] -= times * need[used]
        patterns.append((bin_, times))
    return patterns


def _best_two(free: np.ndarray, gap: int, smallest: int) -> list[int] | None:
    """Two free lengths with the largest sum within gap, if above smallest."""
    have = np.flatnonzero(free[: gap + 1])
    have = have[have > 0]
    if not len(have):
        return None
    best: tuple[int, int, int] | None = None
    at = np.searchsorted(have, gap - have, side="right") - 1
    for a, j in zip(have.tolist(), at.tolist(), strict=True):
        while j >= 0:
            b = int(have[j])
            if a != b or free[a] > 1:
                if a + b > (best[0] if best else smallest):
                    best = (a + b, max(a, b), min(a, b))
                break
            j -= 1
    return [best[1], best[2]] if best else None


def layout(patterns: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first number, copies in a bin, first bin, offset in the bin), ordered, that place numbered pieces."""
    rows, first_bin, numbered = [], 0, {}
    for lengths, times in patterns:
        offset, k = 0, 0
        while k < len(lengths):
            length = lengths[k]
            copies = 1
            while k + copies < len(lengths) and lengths[k + copies] == length:
                copies += 1
            rows.append((length, numbered.get(length, 0), copies, first_bin, offset))
            numbered[length] = numbered.get(length, 0) + copies * times
            offset, k = offset + copies * length, k + copies
        first_bin += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, room: int = ROOM, id_col: str = "doc_id", text_col: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row.

    The driver sees the histogram of lengths alone, room numbers at most.
    Pieces of a length are numbered in as many parts as they need.
    """
    spark = docs.sparkSession
    with common.arrow_batches(spark, BATCH_BYTES):
        cut = common.stage(pieces(docs, tokenizer_path, room, id_col, text_col), "pieces")
    histogram = {r.length: r["count"] for r in cut.where(F.col("length") < room).groupBy("length").count().collect()}
    plan = layout(best_two_fit(histogram, room))
    sent = spark.sparkContext.broadcast(plan)
    lengths = sorted(histogram)
    # a table becomes a local relation; a list would be an RDD, for which every executor starts Python workers of another kind
    parts = spark.createDataFrame(pa.table({"length": pa.array(lengths, pa.int64()), "parts": pa.array([-(-histogram[k] // part_rows) for k in lengths], pa.int64())}))
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts")).alias("part")
    short = cut.join(F.broadcast(parts), "length").select(*cut.columns, part)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = common.stage(short.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")), "parts")
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32"))
    numbered = common.attach(short.withColumn("rank", rank), first, ["length", "part"], "inner").select(*cut.columns, (F.col("first") + F.col("rank") - 1).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sent.value
        keys = plan[:, 0] << 44 | plan[:, 1]
        for batch in batches:
            length, number = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
            row = plan[np.searchsorted(keys, length << 44 | number, side="right") - 1]
            turn = number - row[:, 1]
            sequence = row[:, 3] + turn // np.maximum(row[:, 2], 1)
            offset = row[:, 4] + turn % np.maximum(row[:, 2], 1) * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    # full pieces come after all sequences of the plan; the rows' places in what was written make their numbers
    full = cut.where(F.col("length") == room).withColumn("sequence_id", F.monotonically_increasing_id() + sum(histogram.values())).withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(full)
