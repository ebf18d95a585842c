"""Full-text search: query language, postings and BM25, for one query or many.

An index is three tables: postings (doc_id, term, positions, length), one row
for each term of a document; terms (term, df); and the corpus statistics.  Postings
are written as chunks, one row for each term of a block of documents, with what the block
can score at most, which lets a batch of queries skip what cannot be among the best
(operators.topk).  The files of chunks and terms are sorted by term, so a query's terms prune
the scan by row-group statistics.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracegrain.functions.session import cut
from tracegrain.functions.text import fold_word, tokens

from . import topk

#: BM25's parameters and the least inverse document frequency.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Positions between the starts of two columns, so that no phrase spans them.
COLUMN_GAP = 100_000_000


class QuerySyntaxError(ValueError):
    """An empty query, or an operator without what it stands between."""


def sanitize(query: str) -> str:
    """Letters, digits and underscores; each run of others is one space.  Case is kept."""
    return re.sub(r"[^\w\u0300-\u0331]+", " ", query).strip()


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Both:
    """All of parts (op "and"), any of them ("or"), or the first without the second ("not")."""

    op: str
    parts: tuple[object, ...]


#: Operators by how closely they bind; a space binds closer than all.
LEVELS = ("OR", "AND", "NOT")


def compile_query(query: str) -> object:
    """The expression of a sanitised query: a space, which means AND, binds closest, then NOT, then AND, then OR.

    A word with underscores is a phrase of its parts.  AND, OR and NOT in upper
    case are operators; one that misses a side, or an empty query, is an error.
    """
    words = [w for w in query.split() if w in LEVELS or fold_word(w)]
    if not words:
        raise QuerySyntaxError("empty query")
    return _level(words, 0)


def _level(words: list[str], level: int) -> object:
    if not words:
        raise QuerySyntaxError("an operator has nothing beside it")
    if level == len(LEVELS):
        parts: list[object] = [Phrase(fold_word(w)) for w in words]
        return parts[0] if len(parts) == 1 else Both("and", tuple(parts))
    cuts = [-1, *[i for i, w in enumerate(words) if w == LEVELS[level]], len(words)]
    parts = [_level(words[a + 1 : b], level + 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    if len(parts) == 1:
        return parts[0]
    op = LEVELS[level].lower()
    if op != "not":
        return Both(op, tuple(parts))
    made = parts[0]
    for part in parts[1:]:
        made = Both("not", (made, part))
    return made


def phrases(expression: object) -> list[Phrase]:
    """The distinct phrases of an expression, in order; what NOT excludes is scored nowhere but must be looked up."""
    if isinstance(expression, Phrase):
        return [expression]
    found: list[Phrase] = []
    for part in expression.parts:
        found += [p for p in phrases(part) if p not in found]
    return found


def scored_phrases(expression: object) -> list[Phrase]:
    if isinstance(expression, Phrase):
        return [expression]
    parts = expression.parts[:1] if expression.op == "not" else expression.parts
    found: list[Phrase] = []
    for part in parts:
        found += [p for p in scored_phrases(part) if p not in found]
    return found


#: Tokens that are grouped at a time, about, or those of a single document.
AT_ONCE = 250_000


def few_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (an id, then lists of tokens) in slices of AT_ONCE tokens or one row, so that memory doesn't follow how long texts are."""
    for batch in batches:
        n = sum(c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:])
        piece = (np.cumsum(n) - 1) // AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield batch.slice(a, b - a)


def _tokens(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """doc_id and the tokens of each column (c0, c1, ...)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *[tokens(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)])


def _by_document() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What makes postings of batches of _tokens, those of a document together."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_tokens(batches):
            words, doc, pos, length = [], [], [], np.zeros(batch.num_rows, np.int64)
            for i in range(1, batch.num_columns):
                lists = batch.column(i)
                n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                start = np.cumsum(n) - n
                words.append(lists.flatten())
                doc.append(np.repeat(np.arange(len(n)), n))
                pos.append(np.arange(n.sum()) - np.repeat(start, n) + (i - 1) * COLUMN_GAP)
                length += n
            coded = pa.concat_arrays(words).dictionary_encode()
            code, doc, pos = coded.indices.to_numpy(zero_copy_only=False), np.concatenate(doc), np.concatenate(pos).astype(np.int32)
            order = np.lexsort((pos, code, doc))
            doc, code = doc[order], code[order]
            first = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(code) != 0))) if len(doc) else np.zeros(0, np.int64)
            positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array(pos[order]))
            terms = coded.dictionary.take(pa.array(code[first])) if len(first) else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[first])), terms.cast(pa.string()), positions, pa.array(length[doc[first]])], ["doc_id", "term", "positions", "length"])

    return group


def build_postings(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """doc_id, term, positions, length: the tokens of the columns, one after the other.

    Tokens are grouped where their document is: nothing is shuffled.  Who writes all of
    them does so within arrow_batches, as what Python gets at a time is bounded in rows alone.
    """
    return _tokens(docs, id_col, columns).mapInArrow(_by_document(), "doc_id long, term string, positions array<int>, length long")


def _words(docs: DataFrame, id_col: str, columns: list[str], kept: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept, w: the tokens of each column (c0, c1, ...), found once a document whatever is asked of them."""
    each = F.struct(*[tokens(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *kept, F.explode(F.array(each)).alias("w"))


def _length(n_columns: int) -> Column:
    return sum((F.size(f"w.c{i}") for i in range(1, n_columns)), F.size("w.c0")).cast("long")


def said(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """doc_id, length, term: a row for each token."""
    every = F.concat(*[F.col(f"w.c{i}") for i in range(len(columns))])
    return _words(docs, id_col, columns).select("doc_id", _length(len(columns)).alias("length"), F.explode(every).alias("term"))


def term_rows(docs: DataFrame, id_col: str, columns: list[str], terms: list[str], kept: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept, length and where each of some terms stands (p0, p1, ...) of every document, one without them too; texts are split once and without Python."""

    def places(i: int, term: str) -> Column:
        at = F.filter(F.transform(f"w.c{i}", lambda x, n: F.when(x == term, n + i * COLUMN_GAP)), lambda n: n.isNotNull())
        return F.when(F.array_contains(f"w.c{i}", term), at).otherwise(F.array().cast("array<int>"))

    own = [F.concat(*[places(i, t) for i in range(len(columns))]).alias(f"p{k}") for k, t in enumerate(terms)]
    return _words(docs, id_col, columns, kept).select("doc_id", *kept, _length(len(columns)).alias("length"), *own)


def put_before(rows: DataFrame, heads: DataFrame, head: str, key: str, terms: list[str]) -> DataFrame:
    """term_rows of texts that have heads (key, head) put before them with a separator, from the term_rows of the texts; heads of texts alone are split, and no text moves."""
    at = [f"p{k}" for k in range(len(terms))]
    own = rows.select("doc_id", key, F.struct("length", *at).alias("tail"))
    met = own.join(heads.select(key, head), key).drop(key)
    both = term_rows(met, "doc_id", [head], terms, ("tail",)).withColumnRenamed("length", "before")  # or the lambda would take the new length
    moved = [F.concat(p, F.transform(f"tail.{p}", lambda n: n + F.col("before").cast("int"))).alias(p) for p in at]
    return both.select("doc_id", (F.col("before") + F.col("tail.length")).alias("length"), *moved)


def postings_of(rows: DataFrame, terms: list[str]) -> DataFrame:
    """The rows that build_postings has of some terms, from their term_rows."""
    each = [F.struct(F.lit(t).alias("term"), F.col(f"p{k}").alias("positions")) for k, t in enumerate(terms)]
    found = rows.where(reduce(Column.__or__, [F.size(f"p{k}") > 0 for k in range(len(terms))]))
    return found.select("doc_id", "length", F.explode(F.array(*each)).alias("t")).select("doc_id", "t.term", "t.positions", "length").where(F.size("positions") > 0)


def corpus_stats(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_docs, avg_length over all documents, empty ones too."""
    length = sum((F.size(tokens(F.col(c))) for c in columns[1:]), F.size(tokens(F.col(columns[0]))))
    return docs.agg(F.count("*").alias("n_docs"), F.avg(length).alias("avg_length"))


def term_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions").cast("long")).alias("cf"))


def count_words(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """What term_counts has of all postings, without making them: term, df, cf."""
    said = _words(docs, id_col, columns).select(F.concat(*[F.col(f"w.c{i}") for i in range(len(columns))]).alias("said"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def counted(words: Column, df: Column, cf: Column) -> Column:
        return F.transform(words, lambda x: F.struct(x.alias("term"), df.alias("df"), cf.alias("cf")))

    each = said.select(F.explode(F.concat(counted(F.array_distinct("said"), one, none), counted(F.col("said"), none, one))).alias("t")).select("t.*")
    return each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


@dataclass
class TextIndex:
    postings: DataFrame
    stats: DataFrame
    #: term, df, cf
    terms: DataFrame
    #: the documents, of an index that isn't written yet
    docs: DataFrame | None = None
    #: of an index that is written, the chunks that hold its postings
    blocks: DataFrame | None = None
    #: segment, doc_id of what the chunks still hold and the postings don't
    dead: DataFrame | None = None
    #: the id and the texts among docs' columns
    columns: tuple[str, list[str]] | None = None
    #: columns that the term_rows of an index that isn't written keep
    kept: tuple[str, ...] = ()
    #: what makes the term_rows of such an index in a shorter way
    rows_of: Callable[[list[str]], DataFrame] | None = None
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)
    _known: tuple[int, float] | None = field(default=None, repr=False)
    _rows: tuple[list[str], DataFrame] | None = field(default=None, repr=False)

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, columns: list[str], kept: tuple[str, ...] = ()) -> TextIndex:
        postings = build_postings(docs, id_col, columns)
        return cls(postings, corpus_stats(docs, columns), count_words(docs, id_col, columns), docs, columns=(id_col, columns), kept=kept)

    def before(self, heads: DataFrame, head: str, key: str, whole: DataFrame, column: str) -> TextIndex:
        """The index of whole (this one's id, column): this one's texts with heads (key, head) before them; a search of both, not yet written, splits the texts once."""
        made = TextIndex.build(whole, self.columns[0], [column])
        made.rows_of = lambda terms: put_before(self._split(terms), heads, head, key, terms)
        return made

    def write(self, path: str) -> None:
        """Texts are split once; all else comes from the chunks that are written.  Texts are shuffled, so that tasks have like shares of them; postings, which take many times as much, are not."""
        spark = self.postings.sparkSession
        block = topk.by_block()
        if self.docs is not None and self.columns:
            id_col, columns = self.columns
            size = reduce(Column.__add__, [F.coalesce(F.octet_length(c), F.lit(0)) for c in columns])
            docs = self.docs.select(id_col, *columns).repartition(id_col).sortWithinPartitions(size, id_col)
            postings = _by_document()
            made = _tokens(docs, id_col, columns).mapInArrow(lambda batches: block(postings(batches)), topk.MADE)
        else:
            rows = self.postings.select("doc_id", "term", "positions", "length").repartition("doc_id").sortWithinPartitions("length", "doc_id")
            made = rows.mapInArrow(block, topk.MADE)
        chunks = topk.write(spark, made, "", f"{path}/chunks")
        topk.term_counts(chunks).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        if self.docs is None:
            stats = self.stats
        else:
            total = spark.read.parquet(f"{path}/terms").agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("total"))
            n = self.docs.count()
            stats = total.select(F.lit(n).cast("long").alias("n_docs"), (F.col("total") / F.lit(n) if n else F.lit(0.0)).alias("avg_length"))
        stats.write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> TextIndex:
        chunks = spark.read.schema(topk.CHUNKS).parquet(f"{path}/chunks")
        return cls(topk.postings(chunks), spark.read.schema("n_docs long, avg_length double").parquet(f"{path}/stats"), spark.read.schema("term string, df long, cf long").parquet(f"{path}/terms"), blocks=chunks)

    def _split(self, terms: list[str]) -> DataFrame:
        """The term_rows of an index that isn't written yet, written when its terms are asked for first; who asks meanwhile waits."""
        with self._lock:
            if self._rows is None or self._rows[0] != terms:
                made = self.rows_of(terms) if self.rows_of else term_rows(self.docs, *self.columns, terms, self.kept)
                self._rows = list(terms), cut(made)
            return self._rows[1]

    def of(self, terms: list[str]) -> DataFrame:
        """The postings of some terms; only these are made, of an index that isn't written yet."""
        if self.docs is not None and self.columns:
            return postings_of(self._split(terms), terms)
        return self.postings.where(F.col("term").isin(terms))

    def in_docs(self, terms: list[str]) -> dict[str, int]:
        """How many documents hold each of some terms; what known() gives is read along, of an index that isn't written yet."""
        if self.docs is None or not self.columns:
            return {r.term: r.df for r in self.terms.where(F.col("term").isin(terms)).select("term", "df").collect()}
        holding = [F.count(F.when(F.size(f"p{k}") > 0, 1)).alias(f"t{k}") for k in range(len(terms))]
        row = self._split(terms).agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"), *holding).first()
        self._known = row.n_docs, row.avg_length or 0.0
        return {t: row[f"t{k}"] for k, t in enumerate(terms)}

    def known(self) -> tuple[int, float]:
        """n_docs and avg_length, read once."""
        if self._known is None:
            row = self.stats.select("n_docs", "avg_length").first()
            self._known = row.n_docs, row.avg_length or 0.0
        return self._known


def idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def saturation(tf: Column, length: Column, avg_length: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_length))


def search(index: TextIndex, query: str, lenient: bool = False) -> DataFrame:
    """doc_id, score of all matches of one query; the score is negative, stronger matches are smaller.

    Only the query's terms are read, or made.  Positions are compared inside a row, so
    phrases cost no join.  Statistics are of the whole corpus, whatever is
    filtered afterwards; those of words were counted when the index was made,
    those of phrases are counted here, in one job.
    """
    try:
        expression = compile_query(sanitize(query))
    except QuerySyntaxError:
        if lenient:
            return index.postings.select("doc_id", F.lit(0.0).alias("score")).limit(0)
        raise
    wanted = phrases(expression)
    terms = sorted({t for p in wanted for t in p.terms})
    held = {t: f"p{i}" for i, t in enumerate(terms)}
    df = index.in_docs(terms)
    own = [F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(c) for t, c in held.items()]
    hits = index.of(terms).groupBy("doc_id").agg(F.first("length").alias("length"), *own)

    def occurrences(phrase: Phrase) -> Column:
        first, *rest = (F.coalesce(F.col(held[t]), F.array().cast("array<int>")) for t in phrase.terms)
        if not rest:
            return F.size(first)

        def follows(x: Column) -> Column:
            out = F.array_contains(rest[0], x + 1)
            for i, r in enumerate(rest[1:], 2):
                out = out & F.array_contains(r, x + i)
            return out

        return F.size(F.filter(first, follows))

    counted = hits.select("doc_id", "length", *[occurrences(p).alias(f"f{i}") for i, p in enumerate(wanted)])
    at = {p: f"f{i}" for i, p in enumerate(wanted)}

    def holds(e: object) -> Column:
        if isinstance(e, Phrase):
            return F.col(at[e]) > 0
        left, *right = (holds(p) for p in e.parts)
        for r in right:
            left = left & r if e.op == "and" else left & ~r if e.op == "not" else left | r
        return left

    scored = scored_phrases(expression)
    n_docs, avg_length = map(F.lit, index.known())
    longer = [at[p] for p in scored if len(p.terms) > 1]
    seen = counted.agg(*[F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).alias(c) for c in longer]).first() if longer else None
    score = F.lit(0.0)
    for p in scored:
        c = at[p]
        in_docs = F.lit(df.get(p.terms[0], 0) if len(p.terms) == 1 else seen[c] or 0)
        score = score - F.when(F.col(c) > 0, idf(n_docs, in_docs) * saturation(F.col(c), F.col("length"), avg_length)).otherwise(0.0)
    return counted.where(holds(expression)).select("doc_id", score.alias("score"))


def search_batch(index: TextIndex, queries: DataFrame, k: int) -> DataFrame:
    """qid, doc_id, score, rank: the k best matches of each of many queries of words, all of which must occur.

    queries: qid, text.  One join by term serves all queries; scores are summed
    by query and document with partial aggregation.  Of an index that isn't written yet
    the words asked for are counted, in the JVM; one that has blocks is read where
    the k best can be alone.
    """
    if index.blocks is not None:
        return topk.search(index, queries, k)
    asked = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    need = asked.groupBy("qid").agg(F.count("*").alias("need"))
    asked = asked.join(index.terms.select("term", "df"), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    if index.docs is not None and index.columns:
        hits = said(index.docs, *index.columns).join(asked, "term").groupBy("qid", "doc_id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"), F.first("df").alias("df"))
    else:
        hits = index.postings.join(asked, "term").withColumn("tf", F.size("positions"))
    n_docs, avg_length = map(F.lit, index.known())
    part = idf(n_docs, F.col("df")) * saturation(F.col("tf"), F.col("length"), avg_length)
    scored = hits.groupBy("qid", "doc_id").agg((-F.sum(part)).alias("score"), F.count("*").alias("got"))
    full = scored.join(need, "qid").where("got = need")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("score", "doc_id"))
    return full.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "doc_id", "score", "rank")
