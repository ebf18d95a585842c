"""Which commit owns each line of a file, from the stored diffs of its history.

A file's diffs are folded in the order of their commits over a list of runs, (commit,
lines), so what a task holds is the file as it is, however long its history.  The
diffs come sorted by a shuffle on the file; none is kept once it is applied.

The stored diffs pass over white space at the ends of lines, and so does the
ownership.  The way is that of first parents: a merge owns what its diff against its first
parent brings.  A renamed file begins where its diff does, with all lines added if
the diff says so.  A diff that does not fit the file (its old lines lie beyond the end) is
passed over, and counted in `misfits`.  Diffs that are null or have no hunks change
nothing; a file without lines has no rows; of diffs that repeat a commit's place the
text decides the order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
RUNS = "file string, first_line long, n_lines long, commit_sha string, misfits long"


class Lines:
    """The runs of one file."""

    def __init__(self):
        self.runs: list[tuple[str, int]] = []
        self.misfits = 0

    def apply(self, commit: str, diff: str) -> None:
        old = iter(self.runs)
        left: tuple[str, int] | None = None
        new: list[tuple[str, int]] = []
        place = 1  # the next old line

        def put(owner: str, n: int) -> None:
            if n and new and new[-1][0] == owner:
                new[-1] = owner, new[-1][1] + n
            elif n:
                new.append((owner, n))

        def take(n: int | None, keep: bool) -> bool:
            """Go over n old lines, or all that are left; False if there are fewer."""
            nonlocal left, place
            while n is None or n > 0:
                if left is None:
                    left = next(old, None)
                    if left is None:
                        return n is None
                owner, has = left
                step = has if n is None else min(has, n)
                if keep:
                    put(owner, step)
                left = (owner, has - step) if has > step else None
                place += step
                n = None if n is None else n - step
            return True

        rest_old = rest_new = 0
        hunks = 0
        for line in diff.split("\n"):
            if rest_old > 0 or rest_new > 0:
                sign = line[:1]
                if sign == "+":
                    put(commit, 1)
                    rest_new -= 1
                elif sign == "-":
                    fits = take(1, False)
                    rest_old -= 1
                    if not fits:
                        self.misfits += 1
                        return
                elif sign != "\\":
                    fits = take(1, True)
                    rest_old, rest_new = rest_old - 1, rest_new - 1
                    if not fits:
                        self.misfits += 1
                        return
                continue
            m = _HUNK.match(line)
            if m:
                start, rest_old, rest_new = int(m[1]), int(m[2] or 1), int(m[4] or 1)
                hunks += 1
                if not take(start - place + (rest_old == 0), True):  # without old lines, start is the one before
                    self.misfits += 1
                    return
        if hunks:
            take(None, True)
            self.runs = new


def runs(hunks: DataFrame) -> DataFrame:
    """RUNS of every file. hunks: file_path, ord (the commit's place in the history), commit_sha, diff_text."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, lines = None, Lines()

        def told() -> pa.RecordBatch:
            at, out = 1, []
            for owner, n in lines.runs:
                out.append((file, at, n, owner, lines.misfits))
                at += n
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in RUNS.split(", ")])

        for batch in batches:
            for name, commit, diff in zip(*[batch.column(c).to_pylist() for c in (0, 2, 3)], strict=True):
                if name != file:
                    if file is not None:
                        yield told()
                    file, lines = name, Lines()
                if diff:
                    lines.apply(commit, diff)
        if file is not None:
            yield told()

    rows = hunks.where("file_path is not null and commit_sha is not null").select("file_path", F.col("ord").cast("long").alias("ord"), "commit_sha", "diff_text")
    return rows.repartition("file_path").sortWithinPartitions("file_path", "ord", "commit_sha", "diff_text").mapInArrow(fold, RUNS)


def blame(found: DataFrame) -> DataFrame:
    """file, line, commit_sha: a row a line, as explain_change reads it."""
    lines = F.sequence(F.col("first_line").cast("int"), (F.col("first_line") + F.col("n_lines") - 1).cast("int"))
    return found.select("file", F.explode(lines).alias("line"), "commit_sha")
