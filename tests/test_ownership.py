"""Ownership folded from diffs against git's own blame."""

import random
import subprocess

from pyspark.sql import functions as F

from tracegrain.operators import ownership
from tracegrain.sources import gitlog


def test_ownership_is_that_of_git_blame(spark, tmp_path):
    path = tmp_path / "repo"
    path.mkdir()

    def git(*args, when=0):
        env = {"GIT_AUTHOR_DATE": f"{1704067200 + when} +0000", "GIT_COMMITTER_DATE": f"{1704067200 + when} +0000", "HOME": str(tmp_path), "PATH": "/usr/bin:/bin:/usr/local/bin"}
        subprocess.run(["git", "-C", str(path), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True, env=env)

    git("init", "-q")
    rng = random.Random(6)
    files = {"a.rs": [], "b.py": []}
    for n in range(24):
        name = "b.py" if n % 5 == 4 else "a.rs"
        lines = files[name]
        for k in range(rng.randint(1, 4)):
            at = rng.randint(0, len(lines))
            gone = rng.randint(0, min(3, len(lines) - at))
            lines[at : at + gone] = [f"unique {n} {k} {i}" for i in range(rng.randint(0 if gone else 1, 5))]
        (path / name).write_text("".join(f"{x}\n" for x in lines))
        git("add", "-A")
        git("commit", "-q", "--allow-empty", "-m", f"commit {n}", when=n * 60)
    spark.dataSource.register(gitlog.GitLog)

    def read(table, **more):
        return spark.read.format("gitlog").options(repo=str(path), table=table, **more).load()

    places = read("commits").select("commit_sha", F.col("walk_ord").alias("ord"))
    found = ownership.runs(read("hunks").join(places, "commit_sha"))
    assert {r.misfits for r in found.collect()} == {0}
    got = {(r.file, r.line): r.commit_sha for r in ownership.blame(found).collect()}
    want = {(r.file, r.line): r.commit_sha for name in files for r in read("blame", file=name).collect()}
    assert len(want) > 40 and len(set(want.values())) > 10
    assert got == want
    assert {(r.commit_sha, r.parent_sha) for r in read("parents").collect()} == {(r.commit_sha, r.parent_sha) for r in read("commits").collect() if r.parent_sha}


def test_odd_diffs(spark):
    rows = [
        ("f", 1, "a", "@@ -0,0 +1,3 @@\n+x\n+y\n+z"),
        ("f", 2, "b", None),
        ("f", 3, "c", "Binary files differ"),
        ("f", 4, "d", "@@ -9,2 +9,1 @@\n-q\n-r\n+s"),  # doesn't fit
        ("f", 5, "e", "--- a/f\n+++ b/f\n@@ -2 +2,2 @@ fn f()\n-y\n+++ not a header\n+--- nor this\n\\ No newline at end of file"),
        ("g", 1, "a", "@@ -0,0 +1 @@\n+only"),
        ("g", 2, "b", "@@ -1 +0,0 @@\n-only"),
        (None, 1, "a", "@@ -0,0 +1 @@\n+only"),
    ]
    df = spark.createDataFrame(rows, "file_path string, ord long, commit_sha string, diff_text string")
    got = sorted((r.file, r.first_line, r.n_lines, r.commit_sha, r.misfits) for r in ownership.runs(df).collect())
    assert got == [("f", 1, 1, "a", 1), ("f", 2, 2, "e", 1), ("f", 4, 1, "a", 1)]
    assert ownership.runs(df.limit(0)).count() == 0
