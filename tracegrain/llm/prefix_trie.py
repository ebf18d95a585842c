"""The trie of conversations that begin alike: who owns each prefix, and what sharing it saves.

A conversation is a path from the textless root, and of all that pass through a
node the one with the smallest id owns it.  Members only become fewer on the way
down, so a conversation owns the nodes of its path from some depth on, its own
suffix, and (owner, depth) names a node.  What a subtree saves is therefore a sum
over its members of the tokens on their paths below, less those on the nodes that
they own; with running sums along each path that is one subtraction a row, and one
group-by of prefixes adds it up beside the members, children and leaves.

A prefix is known by its depth and 128 bits: two XORs of hashes of place, role and
SHA-256 of text, which run along the path.  All that runs is a scan over ranges of
the order (common.running), so that a conversation may be of any length; groups by
prefix are combined before they are shuffled, so that a prefix may have any number
of members.  The ids of the conversations that end in a node are joined in sorted
order in chunks of CHUNK bytes before one task hashes a node's chunks one by one.

Defined cases: a null role or text is empty; a null turn comes first; turns of a
conversation with one number come by role and then by the SHA-256 of their text, and
turns that repeat stay; rows without an id belong to no conversation and are left
out; a conversation without turns is a member of the root; texts are hashed whole,
however long; an empty table gives an empty table; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK, SHARED = 100, 6
CHUNK = 1 << 16
KEY = ["depth", "x1", "x2"]


def rebuild(conversations: DataFrame, block: int = BLOCK, shared: int = SHARED, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables, written: the rebuilt turns (conv, len, depth, role, digest, chars) and their conversations (conv, len).

    Conversation c starts with the first h = crc32(c) % shared turns of c - c % block
    and goes on with its own after its first h.  Depth 0 is the root, without a text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    said = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.sha2(text.cast("binary"), 256).alias("digest"),
        F.char_length(text).cast("long").alias("chars"),
    )
    placed = common.running(said, [F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("digest")], by="conv").drop("turn")
    first = placed.where((F.col("conv") % block == 0) & (F.col("number") < shared)).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("number", "role", "digest", "chars"))).alias("head"))
    ids = placed.groupBy("conv").agg(F.max("number").alias("own"))
    ids = ids.withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % shared).cast("int"))
    met = ids.join(common.by_shuffle(first.withColumnRenamed("conv", "base")), F.col("conv") - F.col("conv") % block == F.col("base"), "left")
    met = met.withColumn("taken", F.when(F.col("head").isNull(), F.lit(0)).otherwise(F.least(F.size("head"), F.col("h"))))
    length = (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("len")
    convs = common.stage(met.select("conv", "h", "taken", length, F.when(F.col("taken") > 0, F.slice("head", F.lit(1), F.greatest("taken", F.lit(1)))).alias("head")), "conversations")
    own = placed.join(common.by_shuffle(convs.select("conv", "h", "taken", "len")), "conv").where("number > h")
    columns = ["conv", "len", "depth", "role", "digest", "chars"]
    turns = own.withColumn("depth", F.col("number") - F.col("h") + F.col("taken")).select(columns)
    heads = convs.select("conv", "len", F.explode("head").alias("t")).select("conv", "len", F.col("t.number").alias("depth"), "t.role", "t.digest", "t.chars")
    root = convs.select("conv", "len", F.lit(0).cast("long").alias("depth"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("chars"))
    return turns.unionByName(heads).unionByName(root), convs.select("conv", "len")


def prefix_nodes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    turns: conv, len, depth (from 0, the root), role, digest, chars, a row a node of a conversation's path.
    """
    spark = turns.sparkSession
    at_root = F.col("depth") == 0
    tag = [F.when(at_root, F.lit(0)).otherwise(F.xxhash64(*c)).cast("long") for c in ((F.lit(1), "depth", "role", "digest"), (F.lit(2), "digest", "depth", "role"))]
    tagged = turns.select("conv", "len", "depth", "chars", F.col("chars").alias("upto"), tag[0].alias("t1"), tag[1].alias("t2"), tag[0].alias("x1"), tag[1].alias("x2"))
    path = common.running(tagged, [F.col("conv"), F.col("depth")], by="conv", sums=("upto",), xors=("x1", "x2")).drop("number")
    lowest = path.agg(F.min("conv").alias("c")).first().c

    # who owns each node; what its members have in common is taken from any of them
    owners = path.groupBy(KEY).agg(
        F.min("conv").alias("conv_id"),
        F.max("len").alias("deepest"),
        F.min(F.col("upto") - F.col("chars")).alias("before"),
        F.min(F.col("x1").bitwiseXOR(F.col("t1"))).alias("p1"),
        F.min(F.col("x2").bitwiseXOR(F.col("t2"))).alias("p2"),
    )
    owners = common.stage(owners, "owners")
    # from which depth on a conversation owns its path, the tokens before it, and whether its end is a leaf
    marks = owners.groupBy("conv_id").agg(F.min("depth").alias("owns_from"), F.min_by("before", "depth").alias("unowned"), F.max(F.col("deepest") == F.col("depth")).alias("leaf"))
    ends = path.groupBy("conv").agg(F.max("len").alias("end"), F.max("upto").alias("total"))
    known = ends.join(common.by_shuffle(marks.withColumnRenamed("conv_id", "conv")), "conv", "left").select(
        "conv",
        F.coalesce("owns_from", F.col("end") + 1).alias("owns_from"),
        F.coalesce("unowned", "total").alias("unowned"),
        F.coalesce("leaf", F.lit(False)).cast("long").alias("leaf"),
    )
    rows = path.join(common.by_shuffle(known), "conv")
    # tokens from here on, less those on nodes that the conversation owns
    saved = F.when(F.col("depth") < F.col("owns_from"), F.col("unowned") - F.col("upto") + F.col("chars")).otherwise(F.lit(0))
    below = F.col("depth") + 1
    summed = rows.groupBy(KEY).agg(
        F.count("*").alias("n_convs"),
        F.sum(F.col("owns_from").between(F.lit(0), below).cast("long") * (below <= F.col("len")).cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(saved).alias("saved_tokens"),
    )
    nodes = owners.join(common.by_shuffle(summed), KEY)
    nodes = nodes.join(common.by_shuffle(_ends(path.where("depth = len").select(*KEY, "conv"))), KEY, "left")

    # only where a conversation begins to own does the node above belong to another
    begin = marks.where("owns_from > 1").select("conv_id", F.col("owns_from").alias("depth"))
    above = owners.join(begin, ["conv_id", "depth"]).select("conv_id", "depth", (F.col("depth") - 1).alias("d"), "p1", "p2")
    upper = owners.select(F.col("depth").alias("d"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("above"))
    parents = above.join(common.by_shuffle(upper), ["d", "p1", "p2"]).select("conv_id", "depth", "above")
    nodes = nodes.join(common.by_shuffle(parents), ["conv_id", "depth"], "left")
    parent = F.when(at_root, F.lit(None)).when(F.col("depth") == 1, F.lit(lowest)).otherwise(F.coalesce("above", "conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    return nodes.select("conv_id", "depth", parent.cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def _ends(members: DataFrame) -> DataFrame:
    """KEY and ends_sha256 of the members (KEY, conv) in order."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, None, [], 0
        out: list[tuple] = []
        for batch in batches:
            for *k, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != key or size >= CHUNK:
                    if held:
                        out.append((*key, first, ",".join(held)))
                    key, first, held, size = k, conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            yield chunks(out)
            out = []
        if held:
            yield chunks([(*key, first, ",".join(held))])

    def chunks(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string())], [*KEY, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        out: list[tuple] = []
        for batch in batches:
            for *k, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != key:
                    if state:
                        out.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield digests(out)
            out = []
        if state:
            yield digests([(*key, state.hexdigest())])

    def digests(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], [*KEY, "ends_sha256"])

    order = [*KEY, "conv"]
    joined = members.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "depth long, x1 long, x2 long, first long, ids string")
    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, "depth long, x1 long, x2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = BLOCK, shared: int = SHARED, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes of the trie of the rebuilt conversations; see rebuild and prefix_nodes."""
    return prefix_nodes(rebuild(conversations, block, shared, id_col, turn_col, role_col, text_col)[0])
