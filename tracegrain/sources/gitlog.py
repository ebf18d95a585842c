"""A Python data source over a git repository, by the git program: commits, hunks, paths, blame and files.

    spark.dataSource.register(GitLog)
    spark.read.format("gitlog").option("repo", path).option("table", "hunks").load()

Tables are read in ranges of commits, one task a range.  Only as many commits as
a range has are in memory at a time.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracegrain.functions.text import LANGUAGES

SCHEMAS = {
    "commits": "commit_sha string, parent_sha string, is_merge boolean, author string, ts long, message string, walk_ord long",
    "parents": "commit_sha string, parent_sha string, ord int",
    "hunks": "commit_sha string, file_path string, language string, change_kind string, diff_text string",
    "changed_paths": "commit_sha string, path string",
    "blame": "file string, line int, commit_sha string",
    "head_files": "file_path string, source string",
    "post_images": "commit_sha string, path string, source string",
}
#: The names of git's change letters.
KINDS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "T": "modified", "C": "added"}
ROOT = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"  # the empty tree


def git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True).stdout


def text(raw: bytes) -> str | None:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


def first_commit(repo: str) -> str:
    return git(repo, "rev-list", "--first-parent", "HEAD").decode().split()[-1]


def head_sha(repo: str) -> str:
    return git(repo, "rev-parse", "HEAD").decode().strip()


def count_since(repo: str, since: str | None) -> int:
    return int(git(repo, "rev-list", "--count", "HEAD", *([f"^{since}"] if since else [])))


class Range(InputPartition):
    def __init__(self, items: list):
        self.items = items


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema) -> GitLogReader:
        return GitLogReader(dict(self.options))


class GitLogReader(DataSourceReader):
    """Options: repo, table, since (a commit that is known, with all before it), file (of blame), rows (commits a task)."""

    def __init__(self, options: dict):
        self.repo, self.table = options["repo"], options.get("table", "commits")
        self.since, self.file, self.rows = options.get("since"), options.get("file"), int(options.get("rows", "500"))

    def partitions(self) -> list[Range]:
        if self.table == "blame":
            return [Range([self.file])]
        if self.table == "head_files":
            entries = [e.split("\t", 1) for e in git(self.repo, "ls-tree", "-r", "-z", "HEAD").decode("utf-8", "surrogateescape").split("\0")[:-1]]
            names = [name for facts, name in entries if facts.split()[1] == "blob"]  # a submodule is a commit
        else:
            names = git(self.repo, "rev-list", "--topo-order", "--reverse", "HEAD", *([f"^{self.since}"] if self.since else [])).decode().split()
        numbered = list(enumerate(names))
        return [Range(numbered[i : i + self.rows]) for i in range(0, len(numbered), self.rows)] or [Range([])]

    def read(self, partition: Range) -> Iterator[tuple]:
        return getattr(self, f"_{self.table}")(partition.items)

    def _shown(self, items: list, *fields: str) -> Iterator[list[str]]:
        """Fields of a range's commits, in their order, by one process."""
        if not items:
            return
        told = subprocess.run(["git", "-C", self.repo, "log", "--no-walk=unsorted", "--stdin", "-z", "--format=" + "%x00".join(fields)], input="\n".join(sha for _, sha in items).encode(), capture_output=True, check=True).stdout
        flat = told.decode("utf-8", "replace").split("\0")
        for i in range(len(items)):
            yield flat[i * len(fields) : (i + 1) * len(fields)]

    def _commits(self, items: list) -> Iterator[tuple]:
        for (place, _), (sha, parents, author, ts, message) in zip(items, self._shown(items, "%H", "%P", "%an", "%ct", "%B"), strict=True):
            own = parents.split()
            yield sha, own[0] if own else None, len(own) > 1, author, int(ts), message.rstrip("\n"), place

    def _parents(self, items: list) -> Iterator[tuple]:
        for sha, parents in self._shown(items, "%H", "%P"):
            for i, parent in enumerate(parents.split()):
                yield sha, parent, i

    def _base(self, sha: str) -> str:
        parents = git(self.repo, "show", "-s", "--format=%P", sha).decode().split()
        return parents[0] if parents else ROOT

    def _changes(self, sha: str) -> list[tuple[str, str]]:
        fields = git(self.repo, "diff", "--ignore-submodules=all", "--name-status", "-M50%", "-z", self._base(sha), sha).decode("utf-8", "replace").split("\0")[:-1]
        out, i = [], 0
        while i < len(fields):
            moved = fields[i][0] in "RC"
            out.append((fields[i][0], fields[i + 1 + moved]))
            i += 2 + moved
        return out

    def _changed_paths(self, items: list) -> Iterator[tuple]:
        for _, sha in items:
            for _, path in self._changes(sha):
                yield sha, path

    def _hunks(self, items: list) -> Iterator[tuple]:
        for _, sha in items:
            for letter, path in self._changes(sha):
                diff = git(self.repo, "diff", "-M50%", "-U3", "--inter-hunk-context=0", "--ignore-space-at-eol", self._base(sha), sha, "--", path)
                yield sha, path, LANGUAGES.get(path.rsplit(".", 1)[-1]), KINDS.get(letter, "modified"), diff.decode("utf-8", "replace")

    def _post_images(self, items: list) -> Iterator[tuple]:
        for _, sha in items:
            for letter, path in self._changes(sha):
                source = None if letter == "D" else text(git(self.repo, "show", f"{sha}:{path}"))
                if source is not None:
                    yield sha, path, source

    def _head_files(self, items: list) -> Iterator[tuple]:
        for _, path in items:
            source = text(git(self.repo, "show", f"HEAD:{path}"))
            if source is not None:
                yield path, source

    def _blame(self, items: list) -> Iterator[tuple]:
        for file in items:
            for line in git(self.repo, "blame", "--line-porcelain", "HEAD", "--", file).decode("utf-8", "replace").split("\n"):
                fields = line.split(" ")
                if len(fields) >= 3 and len(fields[0]) == 40 and not line.startswith("\t"):
                    yield file, int(fields[2]), fields[0]
