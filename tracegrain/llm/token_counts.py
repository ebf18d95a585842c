"""Exact token counts of every prefix of a text, by a dynamic program over a byte-level BPE vocabulary.

A sequence of tokens is what the vocabulary makes of a string if, and only if, each
two neighbours are what it makes of the two of them.  So the last token of a
prefix is the one that ends there and may follow the last token of the prefix
before it, and the count of the one is one more than that of the other: a table
over the bytes of a word holds the count of each of its prefixes.  Which tokens may
stand side by side is found by merging the two once, and kept.

Words are independent, so counts add up.  A text is cut into units at the spaces
that start a word; the number of tokens before each unit is the coarse table of the
text, and the table of one unit holds the rest.  Truncation to a budget and the count
of any prefix read those two: no prefix is encoded.  Where a cut changes how what
is before it falls into words (inside a contraction, or after white space), the table has the count
of what the cut leaves.

Words share their tables: the trie of the prefixes that were seen holds each one's
last token and count, so a new word is counted from where it leaves those before it.

Special tokens named in a text are one token each and part what is around them.
Units and prefixes seen are kept, UNITS_KEPT and PREFIXES_KEPT at most; units of a
long text are found SLICE characters at a time.

Defined cases: a null or empty text has no tokens and no bytes; rows that repeat are
counted each; a text is counted whole, however long, a single word too; other columns
are not read, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import bisect
import functools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LIMIT = 1024
UNITS_KEPT, PREFIXES_KEPT, PAIRS_KEPT, SLICE = 200_000, 400_000, 500_000, 1 << 20
#: Where a unit ends: before a space that starts a word; and a space that starts none.
_UNIT, _LOOSE = re.compile(r" (?=\S)"), re.compile(r" (?:\s|\Z)")
#: The library's words, for characters below U+0100.
_LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼-¾]+| ?[^A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼-¾\t-\r \x85\xa0]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+").finditer
#: Words of more bytes are counted without the trie.
SHORT = 40


class _Kept(dict):
    """Counts of what was seen, which are found where they are missing."""

    def __init__(self, find, most: int):
        self.find, self.most = find, most

    def __missing__(self, key):
        found = self.find(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = found
        return found


class _Prefix(dict):
    """A prefix of words that were seen: those one byte longer, its last token and the number of its tokens."""

    __slots__ = ("last", "count")


class Vocabulary:
    """Tokens of a byte-level BPE and their ranks, and the counts that were found with them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(path.rsplit(".", 1)[0] + ".tiktoken", "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.longest = max(map(len, self.ranks))
        self.part = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.edges = _Kept(self._edges, len(self.ranks))
        self.follows = _Kept(self._follows, PAIRS_KEPT)
        #: of units, and of units without the space that they start with
        self.units = _Kept(self._unit, UNITS_KEPT)
        self.spaced = _Kept(lambda rest: self._unit(" " + rest), UNITS_KEPT)
        self._forget()

    def _forget(self) -> None:
        self.root, self.held = _Prefix(), 0
        self.root.last, self.root.count = b"", 0

    def split(self, unit: str) -> list[tuple[int, int]]:
        """Where the words of a unit begin and end."""
        if max(unit) < "\u0100":
            return [m.span() for m in _LATIN(unit)]
        return [span for _, span in self.library(unit)]

    def _edges(self, token: bytes) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]:
        """What stands at a token's end and at its start while it is merged from its bytes, each with the rank of the merge that ends that."""
        ranks = self.ranks
        parts = [token[i : i + 1] for i in range(len(token))]
        ends, starts = [], []
        while len(parts) > 1:
            rank, at = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if at == len(parts) - 2:
                ends.append((parts[-1], rank))
            if at == 0:
                starts.append((parts[0], rank))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        never = len(ranks)
        return [*ends, (token, never)], [*starts, (token, never)]

    def _follows(self, pair: tuple[bytes, bytes]) -> bool:
        """Whether two tokens are what the vocabulary makes of the two of them: no merge across their border comes before those that make them.

        Merges come by rank, and of the same rank from the left.
        """
        ends, starts = self.edges[pair[0]][0], self.edges[pair[1]][1]
        ranks, i, j = self.ranks, 0, 0
        never = len(ranks)
        while True:
            (x, x_ends), (y, y_ends) = ends[i], starts[j]
            across = ranks.get(x + y, never)
            if across < x_ends and across <= y_ends and across < never:
                return False
            if x_ends == never and y_ends == never:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def prefixes(self, word: bytes) -> Iterator[int]:
        """The number of tokens of each prefix of a word, from the first byte on."""
        counts, last, ranks, follows = [0], [b""], self.ranks, self.follows
        gone = 0  # what no token reaches back to is forgotten
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                token = word[start:end]
                if token in ranks and (not start or follows[last[start - gone], token]):
                    break
            counts.append(counts[start - gone] + 1)
            last.append(token)
            yield counts[-1]
            if len(counts) > 16 * self.longest:
                k = len(counts) - self.longest
                del counts[:k], last[:k]
                gone += k

    def _word(self, word: bytes) -> int:
        """The number of tokens of a word; what it shares with words before it was counted with them."""
        if len(word) > SHORT:
            n = 0
            for n in self.prefixes(word):  # noqa: B007
                pass
            return n
        if self.held >= PREFIXES_KEPT:
            self._forget()
        node = self.root
        path = [node]
        for byte in word:
            longer = node.get(byte)
            if longer is None:
                longer = node[byte] = _Prefix()
                end = len(path)
                for start in range(end):
                    token = word[start:end]
                    if token in self.ranks and (not start or self.follows[path[start].last, token]):
                        break
                longer.last, longer.count = token, path[start].count + 1
                self.held += 1
            path.append(longer)
            node = longer
        return node.count

    def _unit(self, unit: str) -> int:
        if unit[1:].isalpha() and unit.isascii() and (unit[0] == " " or unit[0].isalpha()):
            return self._word(unit.encode())
        return sum([self._word(unit[a:b].encode()) for a, b in self.split(unit)])

    def unit_table(self, unit: str) -> list[int]:
        """The number of tokens of each prefix of a unit, by characters, from the empty one."""
        out, before, previous, stable = [0], 0, None, 0
        for a, b in self.split(unit):
            word = unit[a:b]
            table = list(self.prefixes(word.encode()))
            byte = 0
            for i, c in enumerate(word, a + 1):
                byte += len(c.encode())
                out.append(before + table[byte - 1])
                if word[0] == "'" and 2 <= i - a < len(word) <= 3:  # a contraction that was cut
                    out[-1] = before + self._unit(unit[a:i])
            if previous is not None and word[0].isspace() and unit[previous:a].isspace():  # the white space before goes on to here
                out[a + 1] = stable + self._unit(unit[previous : a + 1])
            before, previous, stable = before + table[-1], a, before
        return out

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """What lies between special tokens, and the special tokens, which are marked."""
        if self.part and any(s in text for s in self.special):
            for i, piece in enumerate(self.part(text)):
                yield piece, bool(i % 2)
        else:
            yield text, False

    def slices(self, text: str) -> Iterator[str]:
        """A text in slices of about SLICE characters that begin where a unit does."""
        start = 0
        while len(text) - start > SLICE:
            cut = _UNIT.search(text, start + SLICE)
            if not cut:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:] if start else text

    def count(self, text: str) -> int:
        n = 0
        for piece, special in self.parts(text):
            if special:
                n += 1
            elif piece:
                for s in self.slices(piece):
                    if _LOOSE.search(s):
                        n += sum(map(self.units.__getitem__, _units(s)))
                        continue
                    first, *rest = s.split(" ")
                    n += (self.units[first] if first else 0) + sum(map(self.spaced.__getitem__, rest))
        return n


def _units(text: str) -> list[str]:
    """A text by units, the space that starts one with it."""
    if not text:
        return []
    cuts = [0, *[m.start() for m in _UNIT.finditer(text)], len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


class Prefixes:
    """The coarse table of a text: where each unit starts and how many tokens are before it."""

    def __init__(self, vocabulary: Vocabulary, text: str):
        self.vocabulary, self.text = vocabulary, text
        self.starts: list[int] = []
        self.before: list[int] = []
        #: whether a unit is a special token
        self.whole: list[bool] = []
        at = n = 0
        for piece, special in vocabulary.parts(text):
            for unit in [piece] if special else _units(piece):
                self.starts.append(at)
                self.before.append(n)
                self.whole.append(special)
                at += len(unit)
                n += 1 if special else vocabulary.units[unit]
        self.n_tokens = n

    def _end(self, unit: int) -> int:
        return self.starts[unit + 1] if unit + 1 < len(self.starts) else len(self.text)

    def table(self, unit: int) -> list[int]:
        """The number of tokens of the text up to each character of a unit, from the first on."""
        start, end = self.starts[unit], self._end(unit)
        before = self.before[unit]
        joined = unit > 0 and not self.whole[unit - 1]
        if self.whole[unit]:  # a special token that was cut is text, and goes on from what is before it
            stable = self.starts[unit - 1] if joined else start
            base = self.before[unit - 1] if joined else before
            cut = [base + self.vocabulary._unit(self.text[stable:i]) for i in range(start + 1, end)]
            return [*cut, before + 1]
        out = [before + n for n in self.vocabulary.unit_table(self.text[start:end])[1:]]
        if joined and self.text[start - 1].isspace():  # a space after white space is one with it until a word starts
            out[0] = self.before[unit - 1] + self.vocabulary._unit(self.text[self.starts[unit - 1] : start + 1])
        return out

    def count(self, length: int) -> int:
        """The number of tokens of the first characters."""
        if length <= 0:
            return 0
        unit = _last(self.starts, length - 1)
        return self.table(unit)[length - 1 - self.starts[unit]]

    def longest(self, budget: int) -> int:
        """The length of the longest prefix of at most so many tokens."""
        if self.n_tokens <= budget:
            return len(self.text)
        # a unit with the budget before it has one prefix at most that fits, its first character; none after it has any
        for unit in range(min(_last(self.before, budget) + 1, len(self.starts) - 1), -1, -1):
            start = self.starts[unit]
            fits = [i for i, n in enumerate(self.table(unit), start + 1) if n <= budget]
            if fits:
                return fits[-1]
        return 0


def _last(ascending: list[int], most: int) -> int:
    """The place of the last value that is not above most, or -1."""
    return bisect.bisect_right(ascending, most) - 1


@functools.lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """One for all tasks of a Python worker, with what they have found out."""
    return Vocabulary(path)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def count(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(tokenizer_path)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in common.values(batch.column(1)):
                n_bytes.append(len(text or b""))
                n_tokens.append(known.count(text.decode("utf-8", "replace")) if text else 0)
            over = [n > limit for n in n_tokens]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(over, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def prefix_tables(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, starts, before, n_tokens: the coarse table of every row's text, in characters and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(tokenizer_path)
        for batch in batches:
            for i, text in enumerate(common.values(batch.column(1))):  # a row a batch: a table is as long as its text
                made = Prefixes(known, (text or b"").decode("utf-8", "replace"))
                columns = [batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), pa.array([made.starts], pa.list_(pa.int64())), pa.array([made.before], pa.list_(pa.int64())), pa.array([made.n_tokens], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "starts", "before", "n_tokens"])

    rows = _texts(docs, id_col, text_col).withColumn("row_key", common.row_key())
    return rows.mapInArrow(run, "doc_id long, row_key long, starts array<long>, before array<long>, n_tokens long")


def truncate(docs: DataFrame, tokenizer_path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_kept, n_tokens: of every row the longest prefix of at most `budget` tokens, its tokens, and those of the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(tokenizer_path)
        for batch in batches:
            kept, counts, totals = [], [], []
            for text in common.values(batch.column(1)):
                made = Prefixes(known, (text or b"").decode("utf-8", "replace"))
                length = made.longest(budget)
                kept.append(made.text[:length])
                counts.append(made.count(length))
                totals.append(made.n_tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(totals, pa.int64())], ["doc_id", "text", "n_kept", "n_tokens"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string, n_kept long, n_tokens long")
