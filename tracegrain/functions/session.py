"""Session helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: that of spark.checkpoint.dir, or in local mode one made here."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        held = sc._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        found = tempfile.mkdtemp(prefix="tracegrain-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession) -> str:
    """A new folder's name in the shared folder; it is removed when the session ends."""
    path = f"{shared_dir(spark)}/tracegrain-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended
        pass


def cut(df: DataFrame) -> DataFrame:
    """df as a written table in the shared folder, without its lineage.

    A checkpoint would keep the plan's estimate of its size, which a loop of joins
    squares in each round until planning alone takes for ever.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch that holds the tokens of texts, about.
BATCH_BYTES = 4 << 20


@contextmanager
def arrow_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of jobs that start within this have BATCH_BYTES, about, or a single row; a lower limit of the session's stands.

    Spark bounds them in rows alone, and so many long texts fill a Python worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    if limit <= 0 or limit > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def resources(cores: int, intensity: str = "auto") -> dict[str, int]:
    """Batch sizes by cores; conservative halves and aggressive doubles them."""
    cores = max(cores, 1)
    tier = 0 if cores < 8 else 1 if cores < 16 else 2
    plan = {"commit_batch": (128, 256, 512)[tier], "threads": cores, "embed_batch": (64, 128, 256)[tier]}
    if intensity == "conservative":
        return {k: max(v // 2, 1) for k, v in plan.items()}
    return {k: v * 2 for k, v in plan.items()} if intensity == "aggressive" else plan


def spark_settings(plan: dict[str, int]) -> dict[str, str]:
    """What a plan means for Spark: shuffle partitions and rows an Arrow batch."""
    return {"spark.sql.shuffle.partitions": str(plan["threads"]), "spark.sql.execution.arrow.maxRecordsPerBatch": str(plan["embed_batch"])}
