"""Language identification by prediction by partial matching (Cleary and Witten, 1984).

Each language has a tree of byte contexts of length 3 and less with the counts
of the bytes that follow.  A byte seen after its longest context costs its
share there; otherwise an escape is paid (method C: distinct followers over
followers and distinct followers) and the next shorter context is asked, down
to a uniform byte.  Statistics are frozen after training, so a byte's cost
depends on it and the three bytes before alone.  The cost of every four bytes
seen in training is kept for all languages, and a text's code length in each
language is the exact sum over its bytes.

The trees are fitted on a bounded sample: the TRAIN_DOCS documents of each
language whose hashed doc_id is smallest.  Every document is scored whole.

A text is foreign, in none of the languages, if its code length in the best of
them is over that language's usual length by more than MARGIN bits a byte, and
SPARE bits for short texts, as it stands and in lower case.  The usual length is measured on the sample: trees of each half of
it are asked for the other half.

Defined cases: a null text, or one without any letter, is "und" with score 0; a
null doc_id is never learned from and not held out; null languages are not
learned; rows that repeat are scored alike; a tie goes to the language first in
order; without anything to learn from, all are "und"; "und" is not foreign, nor
is what is nearest to a language with documents in one half only; other columns
are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

ORDER = 3
#: Documents of each language that are learned from.
TRAIN_DOCS = 1500
#: A foreign text's code length is over the usual one by more than so many bits a byte, and so many bits.
MARGIN, SPARE = 4.5, 64.0
#: Bytes scored at a time.
SLAB = 1 << 19
START = b"\n" * ORDER
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def grams(data: np.ndarray) -> np.ndarray:
    """Each byte with the three before it, as one number; the first three bytes of data have none."""
    wide = data.astype(np.uint32)
    return wide[:-3] << np.uint32(24) | wide[1:-2] << np.uint32(16) | wide[2:-1] << np.uint32(8) | wide[3:]


class Table:
    """An open-addressed map from uint32 keys to their places, 4 slots or more to a key."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(4 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint32)
        self.at = np.full(1 << self.bits, -1, np.int32)
        pending = np.arange(len(keys))
        slot = self._slot(keys)
        while len(pending):
            free = self.at[slot] < 0
            self.at[slot[free]] = pending[free]  # of keys that meet in a slot the last stays
            self.keys[slot[free]] = keys[pending[free]]
            lost = self.at[slot] != pending
            pending, slot = pending[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those not in the map."""
        slot = self._slot(keys)
        at = self.at[slot]
        wrong = np.flatnonzero((at >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            at[wrong] = self.at[slot[wrong]]
            wrong = wrong[(at[wrong] >= 0) & (self.keys[slot[wrong]] != keys[wrong])]
        return at


@dataclass
class Model:
    """Costs in bits, a column a language.

    cost[n] has a row for each n-byte sequence (n - 1 bytes of context) seen in
    any language; escape[n] has one for each n-byte context.  usual: bits a byte
    of documents that were not learned from, infinite where none is known.
    """

    langs: list[str]
    keys: dict[int, np.ndarray]
    cost: dict[int, np.ndarray]
    escape_keys: dict[int, np.ndarray]
    escape: dict[int, np.ndarray]
    usual: np.ndarray | None = None

    @classmethod
    def fit(cls, counted: pd.DataFrame) -> Model:
        """counted: lang, gram, n of all four-byte sequences of the sample."""
        langs = sorted(counted["lang"].unique().tolist())
        keys, cost, escape_keys, escape = {}, {0: np.full((1, len(langs)), 8.0)}, {}, {}
        for size in range(1, ORDER + 2):
            low = counted.assign(g=counted["gram"].to_numpy(np.int64) & ((1 << (8 * size)) - 1)).groupby(["lang", "g"], sort=True)["n"].sum()
            keys[size] = np.unique(low.index.get_level_values("g").to_numpy(np.int64)).astype(np.uint32)
            context = keys[size].astype(np.int64) >> 8
            escape_keys[size - 1] = np.unique(context).astype(np.uint32)
            at = np.searchsorted(escape_keys[size - 1], context)
            n = np.zeros((len(keys[size]), len(langs)))
            for i, lang in enumerate(langs):
                own = low.loc[lang]
                n[np.searchsorted(keys[size], own.index.to_numpy(np.int64)), i] = own.to_numpy(float)
            total = np.zeros((len(escape_keys[size - 1]), len(langs)))
            distinct = np.zeros_like(total)
            np.add.at(total, at, n)
            np.add.at(distinct, at, n > 0)
            # a context that a language has not seen costs nothing to leave
            escape[size - 1] = np.where(total > 0, np.log2(np.maximum(total + distinct, 1) / np.maximum(distinct, 1)), 0.0)
            shorter = keys[size].astype(np.int64) & ((1 << (8 * (size - 1))) - 1)
            below = cost[size - 1][np.searchsorted(keys[size - 1], shorter) if size > 1 else np.zeros(len(shorter), int)]
            share = np.log2(np.maximum(total + distinct, 1)[at] / np.maximum(n, 1))
            cost[size] = np.where(n > 0, share, escape[size - 1][at] + below)
        return cls(langs, keys, cost, escape_keys, escape)

    def measure(self, halves: pd.DataFrame) -> Model:
        """Set usual.  halves: lang, gram, n as in fit, and half, 0 or 1."""
        bits, size = np.zeros(len(self.langs)), np.zeros(len(self.langs))
        for half in (0, 1):
            learned, asked = halves[halves["half"] != half], halves[halves["half"] == half]
            if not len(learned):
                continue
            model = Model.fit(learned)
            for i, lang in enumerate(model.langs):
                own = asked[asked["lang"] == lang]
                n, at = own["n"].to_numpy(float), self.langs.index(lang)
                bits[at] += n @ model.scorer().costs(own["gram"].to_numpy(np.int64).astype(np.uint32))[:, i]
                size[at] += n.sum()
        self.usual = np.where(size > 0, bits / np.maximum(size, 1), np.inf)
        return self

    def strange(self, bits: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Which texts are longer in the best language than its documents are."""
        if self.usual is None:
            return np.zeros(len(texts), bool)
        most = (self.usual[bits.argmin(1)] + MARGIN) * np.array([len(t) for t in texts]) + SPARE
        return bits.min(1) > most

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.table = Table(model.keys[ORDER + 1])
        self.cost = model.cost[ORDER + 1]

    def _backed_off(self, sequences: np.ndarray, size: int) -> np.ndarray:
        """Costs of sequences of `size` bytes that may not have been seen in any language."""
        model = self.model
        if size == 0:
            return np.repeat(model.cost[0], len(sequences), axis=0)
        keys = model.keys[size]
        at = np.minimum(np.searchsorted(keys, sequences), len(keys) - 1)
        seen = keys[at] == sequences
        out = np.empty((len(sequences), len(model.langs)))
        out[seen] = model.cost[size][at[seen]]
        rest = sequences[~seen]
        if len(rest):
            contexts = model.escape_keys[size - 1]
            context = rest >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            leave = np.where((contexts[at] == context)[:, None], model.escape[size - 1][at], 0.0)
            out[~seen] = leave + self._backed_off(rest & np.uint32((1 << (8 * (size - 1))) - 1), size - 1)
        return out

    def costs(self, sequences: np.ndarray) -> np.ndarray:
        """Bits of the last byte of four, a column a language."""
        at = self.table.find(sequences)
        costs = self.cost[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            costs[new] = self._backed_off(sequences[new], ORDER + 1)
        return costs

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits: a row a text, a column a language."""
        out = np.zeros((len(texts), len(self.model.langs)))
        held: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            held.append(i)
            size += len(text)
            if size > SLAB:
                self._slab([texts[k] for k in held], held, out)
                held, size = [], 0
        self._slab([texts[k] for k in held], held, out)
        return out

    def _slab(self, texts: list[bytes], rows: list[int], out: np.ndarray) -> None:
        ends = np.cumsum([ORDER + len(t) for t in texts], dtype=np.int64)
        data = np.frombuffer(b"".join(x for t in texts for x in (START, t)), np.uint8)
        if len(data) <= ORDER:
            return
        begin = np.append(0, ends[:-1])
        for first in range(0, len(data) - ORDER, 4 * SLAB):  # a single text may be longer than a slab
            sequence = grams(data[first : first + 4 * SLAB + ORDER])
            costs = self.costs(sequence)
            place = np.arange(first, first + len(sequence)) + ORDER  # of the byte that is paid for
            owner = np.searchsorted(ends, place, side="right")
            costs[place < begin[owner] + ORDER] = 0.0  # the start bytes of the next text
            cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            np.add.at(out, np.asarray(rows)[owner[cuts]], np.add.reduceat(costs, cuts, axis=0))


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def remainder(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the documents with a language that are not held out; None if there are none."""
    open_ = docs.where((remainder(id_col) != 2) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ids = open_.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"))
    # a common language is thinned by the hash it is ordered by, so that a few thousand ids are ranked in any
    share = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / F.lit(2.0**63)
    thinned = ids.join(F.broadcast(ids.groupBy("lang").count()), "lang").where(share < F.lit(4.0 * train_docs) / F.col("count"))
    order = Window.partitionBy("lang").orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 1), "doc_id")
    chosen = thinned.select("doc_id", "lang").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= train_docs)
    chosen = common.stage(chosen.select("doc_id").distinct(), "language-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[tuple[str, int], list[bytes]] = {}
            for lang, half, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.values(batch.column(2)), strict=True):
                by_lang.setdefault((lang, half), []).append(text)
            for (lang, half), texts in by_lang.items():
                own = [grams(np.frombuffer(START + t, np.uint8)) for t in texts if t]
                if own:
                    keys, n = np.unique(np.concatenate(own), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(np.full(len(keys), half, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "half", "gram", "n"])

    rows = open_.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sample = rows.join(F.broadcast(chosen), "doc_id", "left_semi")  # train_docs rows a language
    sample = sample.select("lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("half"), "text")
    halves = sample.mapInArrow(count, "lang string, half int, gram long, n long").groupBy("lang", "half", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(halves):
        return None
    return Model.fit(halves.groupby(["lang", "gram"], as_index=False)["n"].sum()).measure(halves)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte, row_key for every row.

    score is the chance of the predicted language among all, each byte's cost
    being a likelihood; bits_per_byte is the code length in that language.
    """
    return score(docs, model, id_col, text_col).drop("foreign")


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As identify, with foreign: whether a text is in none of the languages."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        scorer = found.scorer() if found else None
        for batch in batches:
            lang: list[str] = ["und"] * batch.num_rows
            score, rate, foreign = np.zeros(batch.num_rows), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            held, texts, size = [], [], 0

            def settle() -> None:
                if not held or scorer is None:
                    return
                bits = scorer.lengths(texts)
                best = bits.argmin(1)
                least = bits.min(1)
                chance = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(1)
                strange = np.flatnonzero(found.strange(bits, texts))
                if len(strange):
                    lower = [texts[i].decode("utf-8", "replace").lower().encode() for i in strange]
                    foreign[np.asarray(held)[strange]] = found.strange(scorer.lengths(lower), lower)
                for i, k in enumerate(held):
                    lang[k], score[k], rate[k] = found.langs[best[i]], chance[i], least[i] / len(texts[i])

            for k, text in enumerate(common.values(batch.column(3))):
                if text and has_letter(text):
                    held.append(k), texts.append(text)
                    size += len(text)
                    if size > 4 * SLAB:
                        settle()
                        held, texts, size = [], [], 0
            settle()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang), pa.array(score), pa.array(rate), batch.column(2), pa.array(foreign)], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte", "row_key", "foreign"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(remainder(id_col) == 2, F.lit(False)).alias("held_out"), common.row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double, row_key long, foreign boolean")
