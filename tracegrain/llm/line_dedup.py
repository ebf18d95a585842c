"""Reversible line deduplication: sharded cuckoo filters backed by exact reference counts.

A line's key (stripped of ASCII white space, A-Z lower-cased) refers to every
document that holds it.  The reference table has one row for each key of a
document, the count table one for each key: in how many documents it stands and
the largest doc_id among them.  A cuckoo filter (Fan et al., 2014) for each shard
of the keys holds exactly those that stand in enough documents to be dropped.  It
answers most lines of a document with "no", before anything is shuffled; what it
lets through is looked up in the exact counts, so its false positives change
nothing.

Inserting and deleting documents writes a layer of references and a layer of the
counts that have changed, and moves the keys that have crossed the threshold into
their filters or out of them.  What no document touched is not written again;
layers are merged when there are many.  So the state after any series of
insertions and deletions is that of the documents that are left.  A filter that
is full is made again from the exact counts of its shard, and the number of
shards doubles with the keys.

Keys are held as 128-bit XXH3 hashes.

Defined cases: a null or empty text is one empty line; each row counts as a
document of its own, also where rows repeat an id or all; a null doc_id ranks
below all others, and if every holder's is null, all of them keep the line;
deleting an id, null too, takes all rows that have it; a tie between rows that
share the largest doc_id leaves the line in each; a very long text is read whole,
a batch's output is cut by size; other columns are not read, whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = b" \t\n\x0b\x0c\r"
#: Keys have so many code points at least, and stand in so many documents before they are dropped.
MIN_CHARS, MIN_DOCS = 20, 3
SLOTS = 4
#: Keys of a shard, about, and the least number of shards; the number doubles as keys are added.
SHARD_KEYS, LEAST_SHARDS = 65_536, 16
#: Bytes of filters that are broadcast at most; more are dealt to tasks by shard.
FILTER_BYTES = 128 << 20
#: Lines of a shard that one task probes, about.
PROBE_ROWS = 2_000_000
#: Layers of references and counts before they are merged into one.
MOST_LAYERS = 8


class CuckooFilter:
    """15-bit fingerprints in buckets of four; a key has two buckets, either of which tells the other."""

    def __init__(self, capacity: int):
        self.buckets = 1 << max(2, int(np.ceil(capacity / SLOTS / 0.8)) - 1).bit_length()
        self.table = np.zeros((self.buckets, SLOTS), np.uint16)

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> CuckooFilter:
        """A filter of the keys, as large as they need."""
        capacity = len(h1)
        while True:
            made = cls(capacity)
            if made.insert(h1, h2):
                return made
            capacity = made.capacity + 1

    @property
    def capacity(self) -> int:
        return int(self.buckets * SLOTS * 0.8)

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = ((h2 >> np.uint64(48)).astype(np.uint16) | np.uint16(1)).astype(np.uint16)
        first = (h1 & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, first, first ^ self._turn(mark)

    def _turn(self, mark: np.ndarray | np.uint16) -> np.ndarray:
        return ((mark.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """Whether all keys have found a place; if not, the filter has to be made again, and larger."""
        mark, first, second = self._places(h1, h2)
        pending = np.arange(len(mark))
        for at in (first, second):
            pending = self._fill(mark, at, pending)
        return all(self._push(mark[i], int(second[i])) for i in pending.tolist())

    def _fill(self, mark: np.ndarray, at: np.ndarray, pending: np.ndarray) -> np.ndarray:
        """Put the pending keys into the free slots of their buckets; those that find none are left."""
        order = pending[np.argsort(at[pending], kind="stable")]
        bucket = at[order]
        start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        turn = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        free = self.table[bucket] == 0
        slot = np.argsort(~free, axis=1, kind="stable")  # free ones first
        fits = turn < free.sum(1)
        self.table[bucket[fits], slot[fits, turn[fits]]] = mark[order[fits]]
        return order[~fits]

    def _push(self, mark: np.uint16, at: int) -> bool:
        """Put a key into a full bucket, whose others move to their own second bucket."""
        for n in range(500):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
            slot = (n * 7 + at) % SLOTS
            mark, self.table[at, slot] = self.table[at, slot], mark
            at ^= int(self._turn(np.asarray(mark)))
        return False

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Of keys that were inserted."""
        for mark, first, second in zip(*self._places(h1, h2), strict=True):
            for at in (int(first), int(second)):
                held = np.flatnonzero(self.table[at] == mark)
                if len(held):
                    self.table[at, held[0]] = 0
                    break

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        mark, first, second = self._places(h1, h2)
        return (self.table[first] == mark[:, None]).any(1) | (self.table[second] == mark[:, None]).any(1)

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        self = cls.__new__(cls)
        self.table = np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy()
        self.buckets = len(self.table)
        return self


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode("utf-8", "replace"))


def keys_of(text: bytes | None, min_chars: int) -> tuple[list[bytes], list[int], list[int]]:
    """A text's lines, the places of those with a key long enough, and these keys' 128-bit hashes."""
    lines = (text or b"").split(b"\n")
    at, hashes = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(SPACE).lower()
            if len(key) >= min_chars and code_points(key) >= min_chars:
                at.append(i)
                hashes.append(xxhash.xxh3_128_intdigest(key))
    return lines, at, hashes


def halves(hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    mask = (1 << 64) - 1
    return np.fromiter((h >> 64 for h in hashes), np.uint64, len(hashes)), np.fromiter((h & mask for h in hashes), np.uint64, len(hashes))


def shards_for(n_keys: int) -> int:
    """A power of two, so that more keys double it."""
    return max(LEAST_SHARDS, 1 << max(0, -(-n_keys // SHARD_KEYS) - 1).bit_length())


def shard_of(h2: np.ndarray, shards: int) -> np.ndarray:
    return ((h2 >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def shard_column(shards: int) -> Column:
    return F.expr(f"cast(shiftrightunsigned(h2, 20) % {shards} as int)").alias("shard")


KEYS = ["h1", "h2"]


def occurrences(rows: DataFrame, min_chars: int, filters: Broadcast | None = None) -> DataFrame:
    """h1, h2, doc_id, row_key: each row's distinct keys.  rows: doc_id, text, row_key.

    filters: a broadcast dict of all shards' filters; keys that these don't know are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = None if filters is None else Filters(filters.value)
        for batch in batches:
            ids, keys, hashes = [], [], []
            for doc_id, text, key in zip(batch.column(0).to_pylist(), common.values(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                own = set(keys_of(text, min_chars)[2])
                hashes.extend(own), ids.extend([doc_id] * len(own)), keys.extend([key] * len(own))
            h1, h2 = halves(hashes)
            out = pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids, pa.int64()), pa.array(keys, pa.int64())], ["h1", "h2", "doc_id", "row_key"])
            yield out if probe is None else out.filter(pa.array(probe.maybe(h1, h2)))

    return rows.select("doc_id", "text", "row_key").mapInArrow(run, "h1 long, h2 long, doc_id long, row_key long")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), common.row_key(id_col, text_col).alias("row_key"))


def references(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """h1, h2, doc_id, n (1): one row for each document and each of its distinct keys."""
    return occurrences(keyed(docs, id_col, text_col), min_chars).select("h1", "h2", "doc_id", F.lit(1).cast("long").alias("n"))


def counts(refs: DataFrame) -> DataFrame:
    """h1, h2, n_docs, last_doc: the exact reference counts.  A key's rows of a partition meet there."""
    return refs.groupBy(*KEYS).agg(F.sum("n").alias("n_docs"), F.max("doc_id").alias("last_doc"))


FILTERS = "shard int, n_keys long, filter binary"


def build_filters(shared: DataFrame, shards: int) -> DataFrame:
    """shard, n_keys, filter: a cuckoo filter of the keys h1, h2 of each shard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = pdf["h1"].to_numpy().view(np.uint64), pdf["h2"].to_numpy().view(np.uint64)
        return pd.DataFrame({"shard": [int(shard_of(h2[:1], shards)[0])], "n_keys": [len(h1)], "filter": [CuckooFilter.of(h1, h2).to_bytes()]})

    return shared.select("h1", "h2", shard_column(shards)).groupBy("shard").applyInPandas(run, FILTERS)


def move_keys(filters: DataFrame, turned: DataFrame, shards: int) -> DataFrame:
    """The filters after the keys of turned (h1, h2, enters) have entered or left; null where a filter is full."""

    def run(held: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
        if not len(moved):
            return held
        enters = moved["enters"].to_numpy(bool)
        h1, h2 = moved["h1"].to_numpy().view(np.uint64), moved["h2"].to_numpy().view(np.uint64)
        n = (int(held["n_keys"].iloc[0]) if len(held) else 0) + int(enters.sum()) - int((~enters).sum())
        if len(held):
            made = CuckooFilter.from_bytes(held["filter"].iloc[0])
            made.delete(h1[~enters], h2[~enters])
            fits = n <= made.capacity and made.insert(h1[enters], h2[enters])
        else:
            made, fits = CuckooFilter.of(h1[enters], h2[enters]), True
        return pd.DataFrame({"shard": [int(shard_of(h2[:1], shards)[0])], "n_keys": [n], "filter": [made.to_bytes() if fits else None]})

    by_shard = turned.select("h1", "h2", "enters", shard_column(shards)).groupBy("shard")
    return filters.groupBy("shard").cogroup(by_shard).applyInPandas(run, FILTERS)


def _union(layers: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, layers)


@dataclass
class LineIndex:
    """Layers of references (n is -1 where a document has gone) and of counts (the last one of a key holds), and the filters."""

    refs: list[DataFrame]
    counts: list[DataFrame]
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS
    _shared: DataFrame | None = field(default=None, repr=False)

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        refs = common.stage(references(docs, min_chars, id_col, text_col), "line-refs")
        made = cls([refs], [common.stage(counts(refs), "line-counts")], refs, LEAST_SHARDS, min_chars, min_docs)
        return made._filtered(made.shared().count())

    def current(self) -> DataFrame:
        """h1, h2, n_docs, last_doc of every key that was ever held."""
        if len(self.counts) == 1:
            return self.counts[0]
        layered = _union([layer.withColumn("layer", F.lit(i)) for i, layer in enumerate(self.counts)])
        return layered.groupBy(*KEYS).agg(F.max_by(F.struct("n_docs", "last_doc"), "layer").alias("held")).select(*KEYS, "held.*")

    def shared(self) -> DataFrame:
        """h1, h2, last_doc of the keys in min_docs documents or more."""
        if self._shared is None:
            self._shared = common.stage(self.current().where(F.col("n_docs") >= self.min_docs).select(*KEYS, "last_doc"), "line-shared")
        return self._shared

    def _filtered(self, n_shared: int) -> LineIndex:
        self.shards = shards_for(n_shared)
        self.filters = common.stage(build_filters(self.shared(), self.shards), "line-filters")
        return self

    def insert(self, docs: DataFrame) -> LineIndex:
        new = common.stage(references(docs, self.min_chars), "line-refs")
        delta = counts(new).select(*KEYS, F.col("n_docs").alias("more"), F.col("last_doc").alias("last_new"))
        held = self.current().select(*KEYS, F.col("n_docs").alias("n_before"), "last_doc")
        before = F.coalesce("n_before", F.lit(0))
        last = F.when(before > 0, F.greatest("last_doc", "last_new")).otherwise(F.col("last_new"))
        return self._moved(new, delta.join(held, KEYS, "left").select(*KEYS, (before + F.col("more")).alias("n_docs"), last.alias("last_doc"), before.alias("n_before")))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents whose doc_id is in doc_ids."""
        ids = doc_ids.select(F.col("doc_id").cast("long").alias("gone_id")).distinct()
        refs = _union(self.refs)
        gone = refs.join(ids, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_semi").groupBy(*KEYS, "doc_id").agg((-F.sum("n")).alias("n")).where("n < 0")
        gone = common.stage(gone.select("h1", "h2", "doc_id", "n"), "line-refs")
        met = counts(gone).select(*KEYS, F.col("n_docs").alias("more"), F.col("last_doc").alias("last_gone")).join(self.current(), KEYS)
        loose = F.col("last_gone").eqNullSafe(F.col("last_doc"))
        # of keys that lost their last document, the next to last is looked up in the references
        left = refs.unionByName(gone).join(met.where(loose).select(*KEYS), KEYS, "left_semi").groupBy(*KEYS, "doc_id").agg(F.sum("n").alias("n")).where("n > 0")
        next_ = left.groupBy(*KEYS).agg(F.max("doc_id").alias("next_doc"))
        last = F.when(loose, F.col("next_doc")).otherwise(F.col("last_doc"))
        return self._moved(gone, met.join(next_, KEYS, "left").select(*KEYS, (F.col("n_docs") + F.col("more")).alias("n_docs"), last.alias("last_doc"), F.col("n_docs").alias("n_before")))

    def _moved(self, refs: DataFrame, touched: DataFrame) -> LineIndex:
        """With a layer of references, and with the counts of the keys that these touch (h1, h2, n_docs, last_doc, n_before)."""
        touched = common.stage(touched, "line-counts")
        now, before = F.col("n_docs") >= self.min_docs, F.col("n_before") >= self.min_docs
        turned = touched.where(now != before).select(*KEYS, now.alias("enters"))
        after = LineIndex([*self.refs, refs], [*self.counts, touched.drop("n_before")], self.filters, self.shards, self.min_chars, self.min_docs)
        if len(after.refs) > MOST_LAYERS:
            net = _union(after.refs).groupBy(*KEYS, "doc_id").agg(F.sum("n").alias("n")).where("n > 0")
            after.refs = [common.stage(net, "line-refs")]
            after.counts = [common.stage(after.current().where("n_docs > 0"), "line-counts")]
        n_shared = (self.filters.agg(F.sum("n_keys")).first()[0] or 0) + (turned.agg(F.sum(F.when(F.col("enters"), 1).otherwise(-1))).first()[0] or 0)
        if shards_for(n_shared) > self.shards:
            return after._filtered(n_shared)
        filters = common.stage(move_keys(self.filters, turned, self.shards), "line-filters")
        full = filters.where("filter is null").select("shard")
        if full.limit(1).count():
            again = after.shared().withColumn("shard", shard_column(self.shards)).join(full, "shard", "left_semi")
            filters = common.stage(filters.where("filter is not null").unionByName(build_filters(again, self.shards)), "line-filters")
        after.filters = filters
        return after

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int | None = None, filter_bytes: int = FILTER_BYTES) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_text (UTF-8) for every row.

        Up to BROADCAST_ROWS shared keys, counted first, go to every worker with
        the filters.  Beyond that the exact table stays in its place: the lines
        that pass the filters go to it, and the drops it confirms come back to
        their documents in a shuffled join.
        """
        limit = common.BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
        rows, shared = keyed(docs, id_col, text_col), self.shared()
        if shared.limit(limit + 1).count() > limit:
            return _drop_far(rows, shared, maybe_shared(rows, self.filters, self.shards, self.min_chars, filter_bytes), self.min_chars)
        return _drop_near(rows, shared, self.filters, self.shards, self.min_chars)


class Filters:
    """The filters of all shards, by shard."""

    def __init__(self, sent: tuple[int, dict[int, bytes]]):
        self.shards, held = sent
        self.filters = {k: CuckooFilter.from_bytes(v) for k, v in held.items()}

    def maybe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h1), bool)
        shard = shard_of(h2, self.shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0)) if len(h1) else []
        for at in np.split(order, cuts[1:]) if len(h1) else []:
            made = self.filters.get(int(shard[at[0]]))
            if made is not None:
                found[at] = made.contains(h1[at], h2[at])
        return found


def _collected(filters: DataFrame) -> dict[int, bytes]:
    return {r.shard: bytes(r.filter) for r in filters.collect()}


def maybe_shared(rows: DataFrame, filters: DataFrame, shards: int, min_chars: int, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """h1, h2, doc_id, row_key of the keys of rows (doc_id, text, row_key) that pass their shard's filter.

    Filters of filter_bytes or less, summed first, go to every worker, and what
    they stop isn't shuffled.  Larger ones meet the keys of their shard in tasks
    of about PROBE_ROWS keys: a shard's filter comes first, its keys follow.
    """
    size = filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    if size <= filter_bytes:
        return occurrences(rows, min_chars, rows.sparkSession.sparkContext.broadcast((shards, _collected(filters))))
    found = common.stage(occurrences(rows, min_chars).withColumn("shard", shard_column(shards)), "line-occurrences")
    parts = common.stage(found.groupBy("shard").agg(F.ceil(F.count("*") / PROBE_ROWS).cast("int").alias("parts")), "line-parts")
    dealt = common.attach(found, parts, ["shard"], "inner").withColumn("part", F.pmod(F.xxhash64("row_key", "h1"), F.col("parts")).cast("int"))
    held = common.attach(filters, parts, ["shard"], "inner").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = dealt.select("shard", "part", F.lit(None).cast("binary").alias("filter"), "h1", "h2", "doc_id", "row_key").unionByName(held.select("shard", "part", "filter"), allowMissingColumns=True)
    # in a partition each shard's part begins with its filter
    ordered = both.repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("filter").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, at = None, None
        for batch in batches:
            where = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            starts = [i for i, w in enumerate(where) if i == 0 or w != where[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(where)], strict=True):
                own = batch.slice(a, b - a)
                if where[a] != at:
                    at, made = where[a], None
                if own.column(2)[0].is_valid:
                    made = CuckooFilter.from_bytes(own.column(2)[0].as_py())
                    own = own.slice(1)
                if made is not None and own.num_rows:  # a shard without a filter has no shared key
                    h1, h2 = (own.column(k).to_numpy().view(np.uint64) for k in (3, 4))
                    yield pa.RecordBatch.from_arrays(own.columns[3:], ["h1", "h2", "doc_id", "row_key"]).filter(pa.array(made.contains(h1, h2)))

    return ordered.mapInArrow(run, "h1 long, h2 long, doc_id long, row_key long")


class _Exact:
    """The exact table of shared keys, ordered by key."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, last: np.ndarray, known: np.ndarray):
        order = np.lexsort((h2, h1))
        self.h1, self.h2, self.last, self.known = h1[order], h2[order], last[order], known[order]

    def place(self, h1: int, h2: int) -> int:
        """The place of a key, or -1."""
        at = int(np.searchsorted(self.h1, np.uint64(h1)))
        while at < len(self.h1) and int(self.h1[at]) == h1:
            if int(self.h2[at]) == h2:
                return at
            at += 1
        return -1


def _rebuilt(lines: list[bytes], dropped: set[int]) -> bytes:
    return b"\n".join([x for i, x in enumerate(lines) if i not in dropped]) if dropped else b"\n".join(lines)


SCHEMA = "doc_id long, n_lines long, n_dropped long, kept_text binary"


def _rows(ids: list, lines: list, dropped: list, kept: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_lines", "n_dropped", "kept_text"])


def _drop_near(rows: DataFrame, shared: DataFrame, filters: DataFrame, shards: int, min_chars: int) -> DataFrame:
    held = shared.select("h1", "h2", "last_doc").toArrow()
    h1, h2 = (held.column(k).to_numpy().view(np.uint64) for k in (0, 1))
    known = ~np.asarray(held.column(2).is_null())
    last = held.column(2).fill_null(0).to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(((shards, _collected(filters)), (h1, h2, last, known)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, exact = Filters(sent.value[0]), _Exact(*sent.value[1])
        for batch in batches:
            held, hashes, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), common.values(batch.column(1)), strict=True):
                lines, at, own = keys_of(text, min_chars)
                held.append((doc_id, lines, at))
                hashes.extend(own)
                size += len(text or b"")
                if size > 4 << 20:
                    yield decide(probe, exact, held, hashes)
                    held, hashes, size = [], [], 0
            yield decide(probe, exact, held, hashes)

    def decide(probe: Filters, exact: _Exact, held: list, hashes: list[int]) -> pa.RecordBatch:
        a, b = halves(hashes)
        maybe = probe.maybe(a, b).tolist()
        out, n = ([], [], [], []), 0
        for doc_id, lines, at in held:
            dropped: set[int] = set()
            for i, j in enumerate(range(n, n + len(at))):
                if maybe[j] and (x := exact.place(int(a[j]), int(b[j]))) >= 0 and exact.known[x] and (doc_id is None or doc_id != int(exact.last[x])):
                    dropped.add(at[i])
            n += len(at)
            for column, value in zip(out, (doc_id, len(lines), len(dropped), _rebuilt(lines, dropped)), strict=True):
                column.append(value)
        return _rows(*out)

    return rows.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _drop_far(rows: DataFrame, shared: DataFrame, maybe: DataFrame, min_chars: int) -> DataFrame:
    hits = maybe.join(shared.select(*KEYS, "last_doc"), KEYS)
    gone = F.col("last_doc").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("last_doc"))
    drops = hits.where(gone).groupBy("doc_id", "row_key").agg(F.collect_set(F.struct(*KEYS)).alias("gone"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = ([], [], [], []), 0
            for doc_id, text, gone in zip(batch.column(0).to_pylist(), common.values(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                lines, at, hashes = keys_of(text, min_chars)
                named = {(x["h1"] & (2**64 - 1)) << 64 | (x["h2"] & (2**64 - 1)) for x in gone or ()}
                dropped = {i for i, h in zip(at, hashes, strict=True) if h in named}
                for column, value in zip(out, (doc_id, len(lines), len(dropped), _rebuilt(lines, dropped)), strict=True):
                    column.append(value)
                size += len(text or b"")
                if size > 4 << 20:
                    yield _rows(*out)
                    out, size = ([], [], [], []), 0
            yield _rows(*out)

    return common.with_facts(rows, drops, "left").select("doc_id", "text", "gone").mapInArrow(rebuild, SCHEMA)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop shared lines from all documents but the last that holds each: doc_id, n_lines, n_dropped, kept_text."""
    return LineIndex.build(docs, min_chars, min_docs, id_col, text_col).apply(docs, id_col, text_col)


def digest(result: DataFrame) -> DataFrame:
    """kept_sha256 in place of the text."""
    return result.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
