"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

A key's shard follows from the key and the number of shards alone.  Going from
n to n+1 shards moves about one row in n+1, and only into shard n.

Defined cases: a null key counts as key 0; a null text has no bytes and the CRC
of the empty text, a very long one is read once, as a whole; rows that repeat a key
share its shard and have slots of their own; slots follow the MD5 of id, CRC and
size, rows that tie in these are the same; other columns of the input are not read,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of the parts into which a shard is cut to number its rows, about, so that no task sorts a whole shard.
PART_ROWS = 1_000_000
#: Fixed value of the published generator, whose state is multiplied by it, plus 1, modulo 2^64.
MULTIPLIER = 2862933555777941757
#: Steps after which all but about one walk in 500 have ended, for 40 shards.
SHORT = 10


def _low32(word: Column) -> Column:
    return word.bitwiseAND(F.lit(0xFFFFFFFF))


def _times(word: Column, factor: int) -> Column:
    """word * factor modulo 2^48 at least, for 32-bit words and factors, without leaving 63 bits."""
    high = (word * F.lit(factor >> 16)).bitwiseAND(F.lit(0xFFFF))
    return word * F.lit(factor & 0xFFFF) + F.shiftleft(high, 16)


def with_shards(df: DataFrame, key: Column, counts: dict[str, int]) -> DataFrame:
    """df with a column of shards for each count of shards, from one walk of the key's jumps.

    A walk lands on b, then on j > b, and so on; for n shards the last landing
    below n counts.  A jump goes up by one at least, so max(counts) steps do,
    and a walk past the largest count stands still.  Nearly all walks end
    within SHORT steps, so the rest are evaluated only for those that do not.
    The 64-bit state is held as two 32-bit words, as ANSI arithmetic does not
    wrap around.  explode() of one element keeps the optimiser from copying
    the walk into each column that reads it.
    """
    most = max(counts.values())
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        _low32(key).alias("lo"),
        F.lit(0).cast("long").alias("j"),
        F.array(*[F.lit(0).cast("long") for _ in counts]).alias("at"),
    )
    upper, lower = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF

    def jump(walk: Column, _: Column) -> Column:
        low = _times(walk["lo"], lower) + 1
        carry = F.shiftright(low, 32) + F.shiftright(walk["lo"] * F.lit(lower >> 16), 16)
        hi = _low32(_times(walk["hi"], lower) + _times(walk["lo"], upper) + carry)
        top = F.shiftright(hi, 1).cast("double")
        j = F.floor((walk["j"] + 1).cast("double") * (F.lit(2147483648.0) / (top + 1.0))).cast("long")
        at = F.array(*[F.when(walk["j"] < n, walk["j"]).otherwise(walk["at"][i]) for i, n in enumerate(counts.values())])
        going = F.struct(hi.alias("hi"), _low32(low).alias("lo"), j.alias("j"), at.alias("at"))
        return F.when(walk["j"] < most, going).otherwise(walk)

    walked = df.withColumn("__walk", F.explode(F.array(F.aggregate(F.sequence(F.lit(1), F.lit(SHORT)), start, jump))))
    walk, far = F.col("__walk"), F.sequence(F.lit(SHORT + 1), F.lit(max(most, SHORT) + 1))
    at = F.when(walk["j"] < most, F.aggregate(far, walk, jump)["at"]).otherwise(walk["at"])
    return walked.select(*df.columns, *[at[i].cast("int").alias(name) for i, name in enumerate(counts)])


def order_of(key: Column, crc: Column, size: Column) -> Column:
    """What rows of a shard are ordered by before all: an MD5, whose first digits also cut the shard into parts."""
    return F.md5(F.concat_ws("|", F.coalesce(key, F.lit(0)).cast("string"), crc.cast("string"), size.cast("string")).cast("binary"))


def assign_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    One scan of the documents writes their narrow rows.  A count of these by
    shard and part, of which there are as many as the rows need, gives each part
    its first slot; one shuffle of the narrow rows numbers them in their parts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = with_shards(narrow, F.col("doc_id"), {"shard": n_shards, "grown_shard": n_shards + 1})
    rows = common.stage(rows.withColumn("md5", order_of(F.col("doc_id"), F.col("text_crc32"), F.col("size"))), "shards")
    n, digits = rows.count(), 2
    while n > n_shards * part_rows * 16**digits:
        digits += 1
    rows = rows.withColumn("part", F.substring("md5", 1, digits))

    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("md5", "doc_id", "text_crc32", "size"))
    few = n_shards * 16**digits <= common.BROADCAST_ROWS
    return rows.withColumn("rank", rank.cast("long")).join(F.broadcast(starts) if few else starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).alias("slot"), "grown_shard"
    )
