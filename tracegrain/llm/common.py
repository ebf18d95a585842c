"""What the operators share: shared-folder tables, Arrow text access, size-checked joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Largest number of rows that a join may broadcast (three longs a row at most).
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or in local mode a folder made here."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = sc._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        found = tempfile.mkdtemp(prefix="tracegrain-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and no executor's loss takes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracegrain-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    read = spark.read.schema(df.schema).parquet(path)
    read.staged_at = path
    return read


def unstage(df: DataFrame) -> None:
    """Delete what stage() wrote for df, which nothing reads any more."""
    _remove(df.sparkSession, df.staged_at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended
        pass


def values(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each row of a string column, without decoding and one row at a time."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from values(chunk)
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    valid, offsets, data = column.buffers()
    if len(column) == 0:
        return
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    null = column.is_null().to_pylist() if valid is not None and column.null_count else None
    for i in range(len(column)):
        yield None if null and null[i] else bytes(view[ends[i] : ends[i + 1]])


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of jobs that run within this have `most` bytes, about, or a single row; a lower limit of the session's stands."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    if limit <= 0 or limit > most:
        spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """Tells apart rows that share an id but not a text; a row is known by its id and this."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def by_shuffle(df: DataFrame) -> DataFrame:
    """df for a join that broadcasts neither side, whatever Spark takes their sizes to be.

    Spark goes by the sizes of files: rows that explode() makes of others, and
    rows that compress well, are far more than those let it expect, and the
    driver would build a table of all of them.  Skewed partitions are split.
    """
    return df.hint("merge")


def with_facts(rows: DataFrame, facts: DataFrame, how: str, broadcast: bool = False) -> DataFrame:
    """Join rows with facts about them (both with doc_id and row_key) by both, null ids too; facts add their other columns.

    broadcast: whether facts of up to BROADCAST_ROWS rows, counted first, are
    broadcast, so that the rows stay where they are; more are not.
    """
    named = facts.withColumnRenamed("doc_id", "__doc_id").withColumnRenamed("row_key", "__row_key")
    if broadcast:
        named = F.broadcast(named) if facts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else by_shuffle(named)
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("row_key") == F.col("__row_key"))
    return rows.join(named, same, how).drop("__doc_id", "__row_key")


def attach(docs: DataFrame, facts: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join whole documents with facts about them.

    Facts of up to BROADCAST_ROWS rows, counted first, are broadcast, so that
    texts stay where they are; more facts meet the documents in a shuffled
    join, whose large partitions Spark splits at run time.
    """
    few = facts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(facts) if few else facts, keys, how)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions, the measure of the data that the cluster's operator has set."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def running(df: DataFrame, order: list, by: str | None = None, sums: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """df with `number` (from 1) and with sums and xors (longs, not null) made running, in the order given.

    by: a long column, not null and the first of the order, with whose change all start again.

    A scan in two passes.  Ranges of the order are tasks, so that no group of
    rows, not even of one `by`, has to fit into one of them; each runs from its
    own beginning and is written.  What a range takes over from those before it
    is a row a range, which the driver adds up and sends to all.
    """
    spark, values_, n_sums = df.sparkSession, [*sums, *xors], len(sums)
    names = df.columns
    at = [names.index(c) for c in values_]
    by_at = names.index(by) if by else None
    ufuncs = [np.add] * n_sums + [np.bitwise_xor] * len(xors)
    undo = [np.subtract] * n_sums + [np.bitwise_xor] * len(xors)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        key, state = None, [0] * (len(values_) + 1)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(by_at).to_numpy() if by else np.zeros(n, np.int64)
            rows = np.arange(n)
            starts = np.append(key is None or keys[0] != key, keys[1:] != keys[:-1])
            first = np.maximum.accumulate(np.where(starts, rows, 0))
            goes_on = (first == 0) & (not starts[0])
            columns = [rows - first + 1 + np.where(goes_on, state[0], 0)]
            for i, f, back, held in zip(at, ufuncs, undo, state[1:], strict=True):
                own = batch.column(i).to_numpy()
                total = f.accumulate(own)
                total = back(total, back(total[first], own[first]))
                columns.append(np.where(goes_on, f(total, np.int64(held)), total))
            key, state = keys[-1], [int(c[-1]) for c in columns]
            made = dict(zip(values_, columns[1:], strict=True))
            out = [pa.array(made[c]) if c in made else batch.column(i) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(columns[0]), pa.array(np.full(n, pid, np.int32))], [*names, "number", "__range"])

    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = StructType([*df.schema.fields, StructField("number", LongType()), StructField("__range", IntegerType())])
    written = stage(sorted_.mapInArrow(scan, schema), "running")
    key = F.col(by) if by else F.lit(0).cast("long")
    ends = written.groupBy("__range").agg(
        F.min(key).alias("first"), F.max(F.struct(key.alias("key"), "number", *[F.col(c).alias(f"v{i}") for i, c in enumerate(values_)])).alias("last")
    ).orderBy("__range").collect()  # a row a task
    taken, before = [], None
    for r in ends:
        carry = before[1] if before and before[0] == r["first"] else [0] * (len(values_) + 1)
        if any(carry):
            taken.append((r["__range"], r["first"], *carry))
        last = list(r["last"])
        if last[0] == r["first"]:  # the range goes on with what was taken over
            last[1:] = [last[1] + carry[0], *[_wrapped(x + c) if i < n_sums else x ^ c for i, (x, c) in enumerate(zip(last[2:], carry[1:], strict=True))]]
        before = (last[0], last[1:])
    if not taken:
        return written.drop("__range")
    columns = ["__range", "__key", "__number", *[f"__v{i}" for i in range(len(values_))]]
    carried = spark.createDataFrame(pa.table([pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(zip(*taken, strict=True))], names=columns))
    met = written.join(F.broadcast(carried), (written["__range"] == carried["__range"]) & (key == F.col("__key")), "left")

    def more(name: str):
        return F.coalesce(F.col(name), F.lit(0))

    whole = {c: F.col(c) + more(f"__v{i}") if i < n_sums else F.col(c).bitwiseXOR(more(f"__v{i}")) for i, c in enumerate(values_)}
    return met.select(*[whole.get(c, F.col(c)).alias(c) for c in names], (F.col("number") + more("__number")).alias("number"))


def _wrapped(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)
