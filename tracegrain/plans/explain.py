"""Why does this code look the way it does: lines to commits, and what happened around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.functions import text as T
from tracegrain.operators import history


def explain_change(blame: DataFrame, commits: DataFrame, hunks: DataFrame, file: str, start: int, end: int, k: int = 5, include_diff: bool = True) -> DataFrame:
    """The newest k commits that own lines of a range, with their lines and their diff of the file.

    commits: commit_sha, ts, author, message; hunks: commit_sha, file_path, diff_text.
    """
    owned = history.owned_lines(blame, file, start, end)
    own = hunks.where(F.col("file_path") == file).groupBy("commit_sha").agg(F.array_join(F.sort_array(F.collect_list("diff_text")), "\n").alias("diff"))
    excerpt, truncated = T.truncate_diff(F.coalesce("diff", F.lit("")))
    met = owned.join(commits, "commit_sha").join(own, "commit_sha", "left")
    rows = met.select(
        "commit_sha",
        F.col("message").alias("commit_message"),
        F.col("author").alias("commit_author"),
        T.rfc3339(F.col("ts")).alias("commit_date"),
        "blame_lines",
        F.lit(file).alias("file_path"),
        (excerpt if include_diff else F.lit("")).alias("diff_excerpt"),
        (truncated if include_diff else F.lit(False)).alias("diff_truncated"),
        F.lit("EXACT").alias("provenance"),
    )
    return rows.orderBy(F.desc("commit_date"), "commit_sha").limit(k)


def explain_meta(blame: DataFrame, commits: DataFrame, file: str, start: int, end: int) -> DataFrame:
    """One row: the range covered, the share of its lines whose commits are known, and what is left out."""
    found = history.coverage(history.owned_lines(blame, file, start, end), commits)
    first, last = F.coalesce("first_line", F.lit(start)), F.coalesce("last_line", F.lit(start))
    return found.select(
        F.lit(file).alias("file"),
        first.alias("first_line"),
        last.alias("last_line"),
        "lines",
        "indexed_lines",
        "blame_coverage",
        history.limitation(F.col("lines"), F.col("skipped"), first, last).alias("limitation"),
    )


def related(changes: DataFrame, anchors: DataFrame, before: int = 2, after: int = 2) -> DataFrame:
    """Commits of the same file around the anchors, each once."""
    return history.related_commits(history.neighbours(changes, anchors, before, after), anchors)
