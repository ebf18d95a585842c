"""Maximum inner product search with score-aware anisotropic quantisation (Guo et al., 2020).

A vector is cut into subspaces of two components, each coded in four bits.  What
a quantiser gets wrong parallel to a vector changes its inner product with the
queries that rank it high, so that part of the error counts ETA times the rest,
both in the choice of codes and in the fit of the codebooks.

Every row is coded.  A coarse partition stands in front: each row belongs to the
cell of its nearest centroid, and a query visits the cells whose centroids have the
largest product with it.  How many is calibrated on the sample: as few as hold
RECALL of the sample's own nearest, which lie farther out than those of the whole
table, so that the table's are found more often rather than less.

A cell is cut into units of UNIT_BYTES of vectors at most, and a unit stands in one
place: the queries go to the units of the cells that they visit, and a vector moves once
for every QUERIES queries that visit its cell, so that what is shuffled grows with the rows and
with queries times visits.  A task reads a unit in blocks and then lets its queries go
by, in batches; it keeps the best k of HELD queries over all its units, and more send theirs
on sooner, so that memory grows with neither.  A query's products with all codewords are
its tables; two subspaces share a byte, so a block is scanned by lookups in tables
of 256.  Equal vectors of a block are scanned as one, so copies take one place among
those with the best approximate products; these, and all that tie with the last
of them, are reranked by exact products of the original vectors in double
precision, and the best are expanded to the rows that hold them.  What a code gets wrong
of a product is at most the length of its residual times the query's, so every vector that
could still pass the k-th best product is reranked too.  A second round does the same for cells: a query goes to
those that it has not visited and whose centroid and radius allow a product as large as its k-th of
the first round.  So nothing is missed, whatever the rows and queries are like; the codes and the
calibration decide how much is read, not what is found.  Of a vector that very many rows share, the k + 1
smallest ids are enough for any answer, and only these go on to its block.

Codebooks, centroids and the number of cells to visit come from a bounded sample,
the rows whose hashed vec_id is smallest: SAMPLE of them, or PER_CELL for each of
MOST_CELLS cells at most, and of wide vectors as many as SAMPLE_BYTES hold.

Defined cases: vectors that are null, zero, of another length than most
(of two lengths as frequent, than the smaller), or hold null or non-finite components take no part; a query
is never its own candidate, whichever rows repeat its id; rows that share an id
are one candidate, of which the best counts; a query whose id has several vectors
asks with each, and its best k are given once; ties go to the smaller vec_id;
fewer candidates than k are all returned; other columns are not read, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE, ETA, CODES = 8192, 4.0, 16
#: Rows of a cell, about, the most cells there are, and the sample's rows for each.
CELL_ROWS, MOST_CELLS, PER_CELL = 2048, 16_384, 16
#: Bytes of the sample's vectors that reach the driver at most.
SAMPLE_BYTES = 256 << 20
#: Vectors of a block at most, bytes of a unit's vectors, about, and queries that go by one, about.
BLOCK, UNIT_BYTES, QUERIES = 8192, 32 << 20, 131_072
#: Queries whose best a task keeps, about.
HELD = 32_768
#: Share of the sample's nearest that the visited cells hold, of so many sampled queries.
RECALL, PROBES = 0.97, 512
#: Share of a block that is reranked, and the least number of its rows.
RERANK_SHARE, RERANK_LEAST = 0.06, 150
#: Queries that a block is scanned for at a time.
AT_ONCE = 32
#: Bounds are taken to be as far off as this, of one; products of tables, in single precision, as far as TABLE_SLACK.
SLACK, TABLE_SLACK = 1e-9, 1e-5


@dataclass
class Codebooks:
    """words[s, c]: the codewords of each subspace."""

    words: np.ndarray
    dim: int

    @classmethod
    def fit(cls, x: np.ndarray, rounds: int = 6, seed: int = 7) -> Codebooks:
        """x: rows of finite vectors.  Codes and codebooks are improved in turn, from a sample's own parts."""
        n, dim = x.shape
        subs = (dim + 1) // 2
        padded = np.pad(x, ((0, 0), (0, 2 * subs - dim))).astype(float)
        parts = padded.reshape(n, subs, 2)
        rng = np.random.default_rng(seed)
        words = np.stack([parts[rng.choice(n, CODES, replace=n < CODES), s] for s in range(subs)])
        self = cls(words, dim)
        unit = padded / np.linalg.norm(padded, axis=1, keepdims=True)
        for _ in range(rounds):
            codes = self.encode(x)
            # normal equations of sum |r|^2 + (ETA - 1) <r, unit>^2 over all codewords at once
            at = codes + np.arange(subs) * CODES
            count = np.bincount(at.ravel(), minlength=subs * CODES)
            z = np.zeros((n, subs * CODES * 2), np.float32)
            rows = np.arange(n)[:, None]
            z[rows, 2 * at] = unit[:, 0::2]
            z[rows, 2 * at + 1] = unit[:, 1::2]
            left = (ETA - 1) * (z.T @ z).astype(float)
            left[np.diag_indices_from(left)] += np.repeat(count, 2) + 1e-6
            along = (padded * unit).sum(1)
            right = (ETA - 1) * (z.T @ along.astype(np.float32)).astype(float)
            for d in range(2):
                right[d::2] += np.bincount(at.ravel(), weights=padded[:, d::2].ravel(), minlength=subs * CODES)
            new = np.linalg.solve(left, right).reshape(subs, CODES, 2)
            used = (count > 0).reshape(subs, CODES, 1)
            self.words = np.where(used, new, self.words)
        return self

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, subspaces) that lower the anisotropic error, one subspace at a time."""
        return np.concatenate([self._encode(x[i : i + 2048], sweeps) for i in range(0, len(x), 2048)]) if len(x) else np.zeros((0, len(self.words)), np.int64)

    def _encode(self, x: np.ndarray, sweeps: int) -> np.ndarray:
        n, subs = len(x), len(self.words)
        padded = np.pad(x, ((0, 0), (0, 2 * subs - x.shape[1]))).astype(float)
        unit = padded / np.maximum(np.linalg.norm(padded, axis=1, keepdims=True), 1e-30)
        rows = np.arange(n)
        # of each row's part and codeword: the squared residual, and the residual along the row
        parts, units = padded.reshape(n, subs, 2).transpose(1, 0, 2), unit.reshape(n, subs, 2).transpose(1, 0, 2)
        words = self.words.transpose(0, 2, 1)
        squared = (parts**2).sum(2)[:, :, None] - 2 * parts @ words + (self.words**2).sum(2)[:, None]
        onto = (parts * units).sum(2)[:, :, None] - units @ words
        codes = squared.argmin(2).T
        along = sum(onto[s, rows, codes[:, s]] for s in range(subs))  # <residual, unit>
        for _ in range(sweeps):
            for s in range(subs):
                rest = along - onto[s, rows, codes[:, s]]
                codes[:, s] = (squared[s] + (ETA - 1) * (rest[:, None] + onto[s]) ** 2).argmin(1)
                along = rest + onto[s, rows, codes[:, s]]
        return codes

    def off(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far each row is from what its codes stand for."""
        made = self.words[np.arange(len(self.words)), codes].reshape(len(x), -1)[:, : x.shape[1]]
        return np.sqrt(((x - made) ** 2).sum(1))

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes a byte."""
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and byte of the codes, its 256 possible contributions to the product."""
        subs = len(self.words)
        q = np.pad(queries, ((0, 0), (0, 2 * subs - queries.shape[1]))).reshape(len(queries), subs, 2)
        own = np.matmul(q.transpose(1, 0, 2), self.words.transpose(0, 2, 1)).transpose(1, 0, 2).astype(np.float32)
        if subs % 2:
            own = np.pad(own, ((0, 0), (0, 1), (0, 0)))
        return (own[:, 1::2, :, None] + own[:, 0::2, None, :]).reshape(len(queries), own.shape[1] // 2, 256)


@dataclass
class Cells:
    """The centroids of the coarse partition, and how many of them a query visits."""

    centroids: np.ndarray
    visits: int

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, k: int, rounds: int = 8, seed: int = 7) -> Cells:
        """x: the sample's rows."""
        rng = np.random.default_rng(seed)
        cells = max(1, min(cells, len(x)))
        self = cls(x[rng.choice(len(x), cells, replace=False)].astype(float), cells)
        for _ in range(rounds if cells > 1 else 0):
            home = self.home(x)
            order = np.argsort(home, kind="stable")
            used, first = np.unique(home[order], return_index=True)
            self.centroids[used] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
        self.visits = self._needed(x, k)
        return self

    def home(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row: the nearest centroid's."""
        half = (self.centroids**2).sum(1) / 2
        return np.concatenate([(x[i : i + 4096] @ self.centroids.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)

    def _needed(self, x: np.ndarray, k: int) -> int:
        cells, k = len(self.centroids), min(k, len(x) - 1)
        if cells == 1 or k < 1:
            return cells
        home = self.home(x)
        places = np.zeros(cells, np.int64)
        for i in range(min(PROBES, len(x))):
            product = x @ x[i]
            product[i] = -np.inf
            near = np.argpartition(product, len(x) - k)[len(x) - k :]
            order = np.argsort(-(self.centroids @ x[i]), kind="stable")
            rank = np.empty(cells, np.int64)
            rank[order] = np.arange(cells)
            places += np.bincount(rank[home[near]], minlength=cells)
        return int(np.searchsorted(np.cumsum(places), RECALL * places.sum())) + 1

    def visited(self, q: np.ndarray) -> np.ndarray:
        """The cells that each query visits, a row a query."""
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, : self.visits]

    def missed(self, q: np.ndarray, least: np.ndarray, radius: np.ndarray, longest: np.ndarray) -> list[np.ndarray]:
        """Of each query the cells that it does not visit and that may hold a product so large.

        radius, longest: of each cell how far its rows are from the centroid, and how long, at most; below zero if it has none.
        """
        size = np.sqrt((q * q).sum(1))[:, None]
        off = SLACK * size * (np.sqrt((self.centroids**2).sum(1)) + longest)
        most = np.minimum(q @ self.centroids.T + size * radius, size * longest) + off
        may = (most >= least[:, None]) & (radius >= 0)
        np.put_along_axis(may, self.visited(q), False, 1)
        return [np.flatnonzero(m).astype(np.int32) for m in may]


def alike(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct vector, and each row's number among them."""
    x = np.ascontiguousarray(x + 0.0)  # without negative zeros, equal vectors have equal bytes
    _, first, group = np.unique(x.view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_index=True, return_inverse=True)
    return first, group


class Block:
    """Rows of which equal vectors are scanned as one."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, off: np.ndarray | None = None):
        """ids, x: the rows; codes: their packed codes, a row each; off: how far each row is from what its codes stand for."""
        first, group = alike(x)
        self.off = None if off is None else off[first]
        self.x, self.codes = x[first], np.ascontiguousarray(codes[first].T)
        order = np.lexsort((ids, group))
        self.ids = ids[order]  # a group's rows stand together, smallest id first
        self.count = np.bincount(group, minlength=len(first))
        self.start = np.cumsum(self.count) - self.count
        by_id = np.argsort(ids, kind="stable")
        self.known, self.group = ids[by_id], group[by_id]
        self.most = max(RERANK_LEAST, int(RERANK_SHARE * len(ids)))
        self.plain = len(first) == len(ids) == len(np.unique(ids))  # neither copies nor repeated ids

    def near(self, tables: np.ndarray) -> np.ndarray:
        """Approximate products: a row a query of tables (queries, bytes, 256), a column a vector."""
        near = np.zeros((len(tables), len(self.count)), np.float32)
        for j, code in enumerate(self.codes):
            near += np.take(tables[:, j], code, axis=1)
        odd = ~np.isfinite(near)
        if odd.any():  # beyond single precision: reranked in any case
            near[odd] = np.finfo(np.float32).max
        return near

    def nearest(self, query_id: int, q: np.ndarray, near: np.ndarray, k: int, least: float = -np.inf, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """vec_id and product of the best k ids other than the query's whose product is at least so large; near, off by slack at most, is changed."""
        held = self.group[slice(*np.searchsorted(self.known, [query_id, query_id + 1]))]
        if len(held):
            own, times = np.unique(held, return_counts=True)
            near[own[times == self.count[own]]] = -np.inf  # vectors of the query's id alone
        most = min(len(near), max(self.most, k))
        first = near >= max(np.partition(near, len(near) - most)[len(near) - most], np.finfo(np.float32).min)
        at, exact = self._exact(np.flatnonzero(first), q, least)
        found = self._best(query_id, at, exact, q, k, len(held))
        if self.off is None or first.all():
            return found
        if len(found[1]) == k:
            least = max(least, found[1][-1])
        may = near + (np.sqrt((q * q).sum()) * self.off * (1 + SLACK) + slack) >= least
        more, products = self._exact(np.flatnonzero(may & ~first & (near > -np.inf)), q, least)
        return self._best(query_id, np.append(at, more), np.append(exact, products), q, k, len(held)) if len(more) else found

    def _exact(self, at: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Those of the vectors whose product is at least so large, and the products."""
        exact = (self.x[at] * q).sum(1)  # numpy's pairwise sum, the same wherever a row stands
        enough = exact >= least
        return at[enough], exact[enough]

    def _best(self, query_id: int, at: np.ndarray, exact: np.ndarray, q: np.ndarray, k: int, held: int) -> tuple[np.ndarray, np.ndarray]:
        """The best k ids that stand in vectors; held: the rows that the query's id has here."""
        if self.plain:
            ids = self.ids[at]
            top = np.lexsort((ids, -exact))[:k]
            return ids[top], exact[top]
        order = np.argsort(-exact, kind="stable")
        n = k
        while True:
            best = at[order[:n]]
            if n < len(order):  # with all that tie with the last
                best = at[exact >= exact[order[n - 1]]]
            ids, scores = self._expanded(query_id, best, q, k + held)
            if len(ids) >= k or n >= len(order):
                return ids[:k], scores[:k]
            n *= 4  # ids that stand in several vectors

    def _expanded(self, query_id: int, at: np.ndarray, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows of vectors, best first, each id once."""
        take = np.minimum(self.count[at], most)
        end = np.cumsum(take)
        rows = np.arange(end[-1] if len(end) else 0) + np.repeat(self.start[at] - (end - take), take)
        ids, scores = self.ids[rows], np.repeat((self.x[at] * q).sum(1), take)
        other = ids != query_id
        ids, scores = ids[other], scores[other]
        top = np.lexsort((ids, -scores))
        ids, scores = ids[top], scores[top]
        first = np.sort(np.unique(ids, return_index=True)[1])
        return ids[first], scores[first]


Best = dict[int, tuple[np.ndarray, np.ndarray]]


def ask(blocks: list[Block], books: Codebooks, ids: list[int], q: np.ndarray, k: int, best: Best, floor: np.ndarray | None = None) -> None:
    """Add what a unit's blocks hold to the best k of each query, by its id; queries with equal vectors share a scan.

    floor: of each query a product below which nothing is asked for.
    """
    first, group = alike(q)
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(len(first) + 1))
    for i in range(0, len(first), AT_ONCE):
        tables = books.tables(q[first[i : i + AT_ONCE]])
        slack = TABLE_SLACK * np.abs(tables).max(2).sum(1, dtype=float)
        for block in blocks:
            near = block.near(tables)
            for j in range(len(tables)):
                same = order[cuts[i + j] : cuts[i + j + 1]].tolist()
                for r in same:
                    held = best.get(ids[r])
                    least = held[1][-1] if held is not None and len(held[1]) == k else -np.inf
                    if floor is not None:
                        least = max(least, floor[r])
                    found = block.nearest(ids[r], q[r], near[j].copy() if len(same) > 1 else near[j], k, least, slack[j])
                    if len(found[0]):
                        best[ids[r]] = found if held is None else _merged(held, found, k)


def answer(best: Best) -> pa.RecordBatch:
    columns = [np.repeat(np.fromiter(best, np.int64, len(best)), [len(b[0]) for b in best.values()]), *[np.concatenate([np.zeros(0, t), *[b[n] for b in best.values()]]) for n, t in ((0, np.int64), (1, float))]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k ids of two, each id by its best."""
    ids, scores = (np.concatenate(both) for both in zip(a, b, strict=True))
    top = np.lexsort((ids, -scores))
    ids, scores = ids[top], scores[top]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[first], scores[first]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null and size(vector) > 0")
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(finite & F.exists("vector", lambda v: v != 0))


def search(vectors: DataFrame, queries: DataFrame, k: int, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products among the vectors of another id."""
    spark = vectors.sparkSession
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    schema = "query_id long, rank int, vec_id long, score double"
    most = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if most is None:
        return spark.createDataFrame([], schema)
    dim, n = most
    rows, asked = rows.where(F.size("vector") == dim), asked.where(F.size("vector") == dim)
    bound = max(k + 2, SAMPLE_BYTES // (8 * dim))
    cells = max(1, min(MOST_CELLS, -(-n // CELL_ROWS), bound // PER_CELL))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(bound, max(sample, PER_CELL * cells))).toArrow()
    train = chosen.column(1).combine_chunks().flatten().to_numpy().reshape(-1, dim)
    index = spark.sparkContext.broadcast((Codebooks.fit(train[:sample]), Cells.fit(train, cells, k)))

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().reshape(-1, dim) + 0.0  # without negative zeros, equal vectors have equal bytes

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, coarse = index.value
        for batch in batches:
            x, ids = matrix(batch.column(1)), batch.column(0).to_numpy()
            raw = [v.tobytes() for v in x]
            first = {pair: i for i, pair in reversed(list(enumerate(zip(ids.tolist(), raw, strict=True))))}
            kept = np.sort(np.fromiter(first.values(), np.int64, len(first)))  # rows that repeat both are one
            x, ids, raw = x[kept], ids[kept], [raw[i] for i in kept]
            coded = books.encode(x)
            codes, off = [c.tobytes() for c in books.pack(coded)], books.off(x, coded)
            home = coarse.home(x)
            mark = np.fromiter((xxhash.xxh64_intdigest(v) for v in raw), np.uint64, len(raw)).view(np.int64)
            columns = [pa.array(ids), pa.array(mark), pa.array(home.astype(np.int32)), pa.array(raw, pa.binary()), pa.array(codes, pa.binary()), pa.array(off), pa.array(np.sqrt(((x - coarse.centroids[home]) ** 2).sum(1))), pa.array(np.sqrt((x * x).sum(1)))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "mark", "cell", "raw", "codes", "bound", "radius", "long"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse = index.value[1]
        for batch in batches:
            q = matrix(batch.column(1))
            raw = [v.tobytes() for v in q]
            mark = np.fromiter((xxhash.xxh64_intdigest(v) for v in raw), np.uint64, len(raw)).view(np.int64)
            visited = pa.array(list(coarse.visited(q).astype(np.int32)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mark), pa.array(raw, pa.binary()), visited], ["vec_id", "mark", "raw", "cells"])

    coded = common.stage(rows.mapInArrow(encode, "vec_id long, mark long, cell int, raw binary, codes binary, bound double, radius double, long double"), "codes")
    asking = common.stage(asked.mapInArrow(route, "vec_id long, mark long, raw binary, cells array<int>"), "routes")
    hot = common.stage(coded.groupBy("mark").count().where(F.col("count") > k + 1).select("mark"), "hot-vectors")
    if hot.limit(1).count():
        place = F.dense_rank().over(Window.partitionBy("mark", "raw").orderBy("vec_id"))
        few = common.attach(coded, hot, ["mark"], "left_semi").withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
        coded = common.stage(common.attach(coded, hot, ["mark"], "left_anti").unionByName(few), "codes")
    # a row a cell, MOST_CELLS at most
    sizes = coded.groupBy("cell").agg(F.count("*").alias("count"), F.max("radius").alias("radius"), F.max("long").alias("long")).toArrow()
    reach = np.full((2, len(index.value[1].centroids)), -1.0)
    reach[:, sizes["cell"].to_numpy()] = sizes["radius"].to_numpy(), sizes["long"].to_numpy()
    sized = F.broadcast(spark.createDataFrame(sizes.select(["cell", "count"])))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def met(asking: DataFrame) -> DataFrame:
        """The vectors of each unit, and behind them the queries that visit it; asking: vec_id, mark, raw, cells, bound."""
        visiting = asking.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("asks"))
        # a row a cell: how many units it has, and how many times each stands
        of_cell = visiting.join(sized, "cell").select("cell", F.ceil(F.col("count") * (8 * dim) / UNIT_BYTES).cast("int").alias("units"), F.ceil(F.col("asks") / QUERIES).cast("int").alias("sets"))
        plan = F.broadcast(spark.createDataFrame(of_cell.toArrow()))
        data = coded.join(plan, "cell").select("cell", F.pmod("mark", "units").cast("int").alias("unit"), every("sets").alias("set"), F.lit(0).alias("kind"), "mark", "vec_id", "raw", "codes", "bound")
        visits = asking.withColumn("cell", F.explode("cells")).join(plan, "cell")
        asks = visits.select("cell", every("units").alias("unit"), F.pmod(F.xxhash64("vec_id"), "sets").cast("int").alias("set"), F.lit(1).alias("kind"), "mark", "vec_id", "raw", F.lit(None).cast("binary").alias("codes"), "bound")
        # equal vectors stand together
        return data.unionByName(asks).repartition("cell", "unit", "set").sortWithinPartitions("cell", "unit", "set", "kind", "mark")

    def missed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse = index.value[1]
        for batch in batches:
            cells = coarse.missed(matrix(pa.array([np.frombuffer(v) for v in batch.column(2).to_pylist()], pa.list_(pa.float64()))), batch.column(3).to_numpy(), *reach)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cells, pa.list_(pa.int32())), batch.column(3)], ["vec_id", "mark", "raw", "cells", "bound"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = index.value[0]
        unit = None  # (cell, unit, set) that is being read
        blocks: list[Block] = []
        held: list[pa.RecordBatch] = []
        best: Best = {}

        def settle() -> None:
            """Make blocks of the vectors held."""
            ids = np.concatenate([b.column(5).to_numpy() for b in held])
            x = np.frombuffer(b"".join(v for b in held for v in b.column(6).to_pylist()), float).reshape(-1, dim)
            codes = np.frombuffer(b"".join(v for b in held for v in b.column(7).to_pylist()), np.uint8).reshape(len(ids), -1)
            off = np.concatenate([b.column(8).to_numpy() for b in held])
            held.clear()
            edges = np.linspace(0, len(ids), -(-len(ids) // BLOCK) + 1).astype(int).tolist()
            blocks.extend(Block(ids[a:b], x[a:b], codes[a:b], off[a:b]) for a, b in zip(edges, edges[1:], strict=False))

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                *own, kind = keys[a].tolist()
                if own != unit:
                    unit = own
                    blocks.clear()
                    held.clear()
                part = batch.slice(a, b - a)
                if kind == 0:
                    held.append(part)
                    continue
                if held:
                    settle()
                q = np.frombuffer(b"".join(part.column(6).to_pylist()), float).reshape(-1, dim)
                ask(blocks, books, part.column(5).to_pylist(), q, k, best, part.column(8).to_numpy())
                if len(best) > HELD:
                    yield answer(best)
                    best.clear()
        if best:
            yield answer(best)

    def best_of(found: DataFrame) -> DataFrame:
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def scanned(asking: DataFrame) -> DataFrame:
        return met(asking).mapInArrow(scan, "query_id long, vec_id long, score double").repartition("query_id")

    lowest = F.lit(float("-inf"))
    near = common.stage(best_of(scanned(asking.withColumn("bound", lowest))), "near")
    kth = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    again = asking.join(kth, "vec_id", "left").select("vec_id", "mark", "raw", F.coalesce("bound", lowest).alias("bound"))
    again = common.stage(again.mapInArrow(missed, "vec_id long, mark long, raw binary, cells array<int>, bound double").where("size(cells) > 0"), "routes")
    if not again.limit(1).count():
        return near
    return best_of(near.drop("rank").unionByName(scanned(again)))
