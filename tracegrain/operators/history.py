"""Operators over the commit graph: scans, neighbours, ownership of lines, path shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.functions import text as T
from tracegrain.functions.session import cut

#: Directories of documentation, and the share from which ignoring is suggested.
DOCS = ("Documentation/", "docs/", "doc/")
HIGH_SHARE = 0.05
#: What an answer says about lines that it leaves out.
SKIPPED = " commit(s) older than the local index watermark were skipped: ["
NO_LINES = "blame returned no attributable lines (file missing in HEAD or empty range)"


def ancestors(commits: DataFrame, sha: str) -> DataFrame:
    """commit_sha of a commit and all it descends from by first parents.

    Pointer doubling: round k jumps 2^k parents at once, so the longest history
    takes as many rounds as its length has binary digits.
    """
    spark = commits.sparkSession
    jump = commits.where("parent_sha is not null").select(F.col("commit_sha").alias("c"), F.col("parent_sha").alias("p"))
    reached = spark.createDataFrame([(sha,)], "commit_sha string")
    size = 1
    while True:
        reached = cut(reached.unionByName(reached.join(jump, reached.commit_sha == jump.c).select(F.col("p").alias("commit_sha"))).distinct())
        now = reached.count()
        if now == size:
            return reached
        size = now
        jump = cut(jump.alias("a").join(jump.alias("b"), F.col("a.p") == F.col("b.c")).select(F.col("a.c").alias("c"), F.col("b.p").alias("p")))


def _number(sha: Column, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), sha)


def generations(commits: DataFrame, parents: DataFrame) -> DataFrame:
    """commit_sha, generation: the length of the longest way to a commit without parents, by any of its parents.

    commits: commit_sha; parents: commit_sha, parent_sha, a row for each parent; those
    not among the commits count for nothing.  Commits go by numbers that are theirs alone.
    Those with one parent hang on the merge or root that they lead to, again and again
    while that takes a quarter of the edges away; only what is left chooses: each merge one
    parent, then, when the lengths of the ways that this makes are known, the one with the
    longest, until no choice would make a way longer.
    """
    nodes = commits.select("commit_sha").where("commit_sha is not null").distinct()
    edges = parents.select("commit_sha", "parent_sha").where("commit_sha is not null and parent_sha is not null")
    edges = edges.join(nodes.withColumnRenamed("commit_sha", "parent_sha"), "parent_sha", "left_semi").join(nodes, "commit_sha", "left_semi").distinct()
    salt, n = 0, None
    while n is None:
        told = nodes.agg(F.count("*").alias("n"), F.count_distinct(_number(F.col("commit_sha"), salt)).alias("numbers")).first()
        n, salt = (told.n, salt) if told.n == told.numbers else (None, salt + 1)
    edges = cut(edges.select(_number(F.col("commit_sha"), salt).alias("c"), _number(F.col("parent_sha"), salt).alias("p"), F.lit(1).cast("long").alias("w")))
    hung = []
    while True:
        single = cut(edges.groupBy("c").agg(F.count("*").alias("parents"), F.first("p").alias("p"), F.first("w").alias("w")).where("parents = 1").select("c", "p", "w"))
        left = edges.count()
        if not left or 4 * single.count() < left:
            break
        way = _ends(single, n)
        hung.append(way)
        further = way.select(F.col("c").alias("p"), F.col("p").alias("next"), F.col("w").alias("more"))
        merges = edges.join(single.select("c"), "c", "left_anti").join(further, "p", "left")
        merges = merges.select("c", F.coalesce("next", "p").alias("p"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))
        edges = cut(merges.groupBy("c", "p").agg(F.max("w").alias("w")))
    level = _longest(edges, n) if left else None
    for way in reversed(hung):
        own = way.select("c", F.col("w").alias("generation"))
        if level is not None:
            known = level.select(F.col("c").alias("p"), "generation")
            own = level.unionByName(way.join(known, "p", "left").select("c", (F.col("w") + F.coalesce("generation", F.lit(0))).alias("generation")))
        level = own
    numbered = nodes.select("commit_sha", _number(F.col("commit_sha"), salt).alias("c"))
    if level is None:
        return numbered.select("commit_sha", F.lit(0).cast("long").alias("generation"))
    return numbered.join(level, "c", "left").select("commit_sha", F.coalesce("generation", F.lit(0).cast("long")).alias("generation"))


def _longest(edges: DataFrame, n: int) -> DataFrame:
    """c, generation: the longest way along edges (c, p, w), by choices that are made anew until none makes a way longer."""
    chosen = edges.groupBy("c").agg(F.max(F.struct("w", "p")).alias("e")).select("c", "e.p", "e.w")
    chosen = cut(chosen)
    while True:  # each choice makes a way longer, so this ends
        level = _ends(chosen, n).select("c", F.col("w").alias("generation"))
        ahead = level.select(F.col("c").alias("p"), F.col("generation").alias("more"))
        length = (F.col("w") + F.coalesce("more", F.lit(0))).alias("g")
        best = edges.join(ahead, "p", "left").select("c", F.struct(length, "p", "w").alias("e")).groupBy("c").agg(F.max("e").alias("e"))
        longer = F.col("e.g") > F.col("generation")
        judged = chosen.join(level, "c").join(best, "c")
        judged = cut(judged.select("c", *[F.when(longer, F.col(f"e.{x}")).otherwise(F.col(x)).alias(x) for x in ("p", "w")], longer.alias("longer")))
        if not judged.where("longer").limit(1).count():
            return level
        chosen = judged.select("c", "p", "w")


def _ends(way: DataFrame, n: int) -> DataFrame:
    """way (c, p, w; a row for each c) with p followed to the first that is no c, and w summed on the way; n: how many commits there are.

    Pointer doubling, in as many rounds as the longest way has binary digits; what has
    come to its end is looked up but moves no more.
    """
    ended: list[DataFrame] = []
    going = way.withColumn("at_end", F.lit(False))
    while True:
        ahead = reduce(DataFrame.unionByName, ended, going).select(F.col("c").alias("p"), F.col("p").alias("next"), F.col("w").alias("more"), F.col("at_end").alias("last"))
        met = going.select("c", "p", "w").join(ahead, "p", "left")
        met = cut(met.select("c", F.coalesce("next", "p").alias("p"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), F.coalesce("last", F.lit(True)).alias("at_end")))
        ended.append(met.where("at_end"))
        going = met.where("not at_end")
        longest = going.agg(F.max("w").alias("w")).first().w
        if longest is None:
            return reduce(DataFrame.unionByName, ended).select("c", "p", "w")
        if longest > n:
            raise ValueError("the parents of commits form a cycle")


def commit_scan(commits: DataFrame, known: DataFrame | None = None, parents: DataFrame | None = None) -> DataFrame:
    """Commits that are not known (commit_sha), with generation and walk_key, an order that has parents first whatever the clocks say.

    parents: commit_sha, parent_sha, a row for each parent; without it only the first parents of the commits count.
    """
    new = commits if known is None else commits.join(known, "commit_sha", "left_anti")
    edges = commits.select("commit_sha", "parent_sha") if parents is None else parents
    level = generations(new, edges)
    return new.join(level, "commit_sha").withColumn("walk_key", F.struct("generation", "ts", "commit_sha"))


def root_commits(commits: DataFrame) -> DataFrame:
    return commits.where("parent_sha is null")


def head_commit(commits: DataFrame) -> DataFrame:
    """The commit that no other has as its parent, the latest if there are more."""
    parents = commits.select(F.col("parent_sha").alias("commit_sha")).where("commit_sha is not null").distinct()
    return commits.join(parents, "commit_sha", "left_anti").orderBy(F.desc("ts"), "commit_sha").limit(1)


def neighbours(changes: DataFrame, anchors: DataFrame, before: int, after: int) -> DataFrame:
    """Commits of an anchor's file just before and after it.

    changes: file_path, commit_sha, ts, one row a hunk; anchors: file_path,
    commit_sha.  Returns anchor_sha, file_path, commit_sha, ts, side, place and
    touched_hunks, older ones nearest first, then newer ones.  A commit has one
    time; one without a time or a file has no neighbours.  Work grows with the
    changes, not with anchors times a file's commits.
    """
    per = changes.where("file_path is not null and ts is not null").groupBy("file_path", "commit_sha", "ts").agg(F.count("*").alias("touched_hunks"))
    # of a file's commits at one time the first few by sha are enough, and of its times the next few
    most = max(before + 1, after)
    place = F.row_number().over(Window.partitionBy("file_path", "ts").orderBy("commit_sha"))
    few = per.withColumn("n", place).where(F.col("n") <= most).groupBy("file_path", "ts").agg(F.collect_list(F.struct("ts", "commit_sha", "touched_hunks")).alias("at"))
    times = Window.partitionBy("file_path").orderBy("ts")
    none = F.array().cast("array<struct<ts:bigint,commit_sha:string,touched_hunks:bigint>>")
    sides = few.select(
        "file_path",
        F.col("ts").alias("anchor_ts"),
        F.flatten(F.collect_list("at").over(times.rowsBetween(-before, 0))).alias("older"),
        F.coalesce(F.flatten(F.collect_list("at").over(times.rowsBetween(1, max(after, 1)))), none).alias("newer"),
    )
    own = per.select("file_path", F.col("commit_sha").alias("anchor_sha"), F.col("ts").alias("anchor_ts")).join(anchors.select("file_path", F.col("commit_sha").alias("anchor_sha")), ["file_path", "anchor_sha"], "left_semi")

    def nearest(rows: Column, n: int) -> Column:
        others = F.filter(rows, lambda x: x["commit_sha"] != F.col("anchor_sha"))
        by = F.transform(others, lambda x: F.struct(F.abs(x["ts"] - F.col("anchor_ts")).alias("d"), x["commit_sha"].alias("commit_sha"), x["ts"].alias("ts"), x["touched_hunks"].alias("touched_hunks")))
        return F.slice(F.array_sort(by), 1, n)

    met = own.join(sides, ["file_path", "anchor_ts"])
    out = [met.select("anchor_sha", "file_path", F.lit(side).alias("side"), F.posexplode(nearest(F.col(rows), n)).alias("place", "c")) for side, rows, n in ((0, "older", before), (1, "newer", after))]
    return out[0].unionByName(out[1]).select("anchor_sha", "file_path", "c.commit_sha", "c.ts", "side", (F.col("place") + 1).alias("place"), "c.touched_hunks")


def related_commits(near: DataFrame, anchors: DataFrame) -> DataFrame:
    """Neighbours without the anchors themselves, each once, where it comes first."""
    others = near.join(anchors.select("commit_sha").distinct(), "commit_sha", "left_anti")
    first = F.row_number().over(Window.partitionBy("commit_sha").orderBy("anchor_sha", "side", "place"))
    return others.withColumn("__n", first).where("__n = 1").drop("__n")


def owned_lines(blame: DataFrame, file: str, start: int, end: int) -> DataFrame:
    """commit_sha and its sorted lines within a range of a file's lines."""
    return blame.where((F.col("file") == file) & F.col("line").between(max(start, 1), end)).groupBy("commit_sha").agg(F.sort_array(F.collect_list("line")).alias("blame_lines"))


def coverage(owned: DataFrame, commits: DataFrame) -> DataFrame:
    """first_line, last_line, lines, indexed_lines, blame_coverage, skipped: one row about owned lines."""
    met = owned.join(commits.select("commit_sha", F.lit(True).alias("known")), "commit_sha", "left")
    n = F.size("blame_lines")
    found = met.agg(
        F.min(F.array_min("blame_lines")).alias("first_line"),
        F.max(F.array_max("blame_lines")).alias("last_line"),
        F.coalesce(F.sum(n), F.lit(0)).alias("lines"),
        F.coalesce(F.sum(F.when(F.col("known"), n).otherwise(0)), F.lit(0)).alias("indexed_lines"),
        F.sort_array(F.collect_list(F.when(F.col("known").isNull(), F.col("commit_sha")))).alias("skipped"),
    )
    share = F.when(F.col("lines") > 0, F.col("indexed_lines") / F.col("lines")).otherwise(F.lit(0.0))
    return found.withColumn("blame_coverage", share)


def limitation(total: Column, skipped: Column, first: Column, last: Column) -> Column:
    """What an answer about lines leaves out; null if nothing."""
    n = F.size(skipped)
    more = F.when(n > 3, F.concat(F.lit(" (+"), (n - 3).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    note = F.concat(n.cast("string"), F.lit(SKIPPED), F.array_join(F.slice(skipped, 1, 3), ", "), F.lit("]"), more, F.lit("; range covered: "), first.cast("string"), F.lit("..="), last.cast("string"))
    return F.when(total == 0, F.lit(NO_LINES)).when(n > 0, note)


def path_shares(changes: DataFrame) -> DataFrame:
    """prefix, commits: how many commits touch each directory and file.  changes: commit_sha, path."""
    rows = changes.select("commit_sha", F.explode(T.path_prefixes(F.col("path"))).alias("prefix"))
    return rows.groupBy("prefix").agg(F.countDistinct("commit_sha").alias("commits"))


def is_top(prefix: Column) -> Column:
    return prefix.rlike("^[^/]*/$")


def suggested(shares: DataFrame, total: int) -> DataFrame:
    """Top-level directories outside the documentation that a high share of all commits touches."""
    if not total:
        return shares.limit(0)
    return shares.where(is_top(F.col("prefix")) & ~F.col("prefix").isin(*DOCS) & (F.col("commits") / F.lit(float(total)) >= HIGH_SHARE))


def top_directories(shares: DataFrame, total: int, n: int = 20) -> DataFrame:
    """prefix, commits, share of the directories that most commits touch."""
    top = shares.where(is_top(F.col("prefix"))).orderBy(F.desc("commits"), "prefix").limit(n)
    return top.withColumn("share", T.percent(F.col("commits"), F.lit(float(max(total, 1)))))
