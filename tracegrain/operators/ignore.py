"""Path rules in layers, compiled to column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is ignored unless a rule says otherwise.
DEFAULTS = (
    "*.lock",
    "Cargo.lock",
    "package-lock.json",
    "pnpm-lock.yaml",
    "yarn.lock",
    "Pipfile.lock",
    "poetry.lock",
    "go.sum",
    "node_modules/",
    "vendor/",
    "target/",
    "dist/",
    "build/",
    ".next/",
    "__pycache__/",
    ".venv/",
    "venv/",
    "*.min.js",
    "*.min.css",
)


def to_regex(pattern: str) -> str:
    """A regular expression for the paths, and those below them, that a pattern without its "!" matches."""
    directory = pattern.endswith("/")
    body = pattern.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            inner = body[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/" if directory else "(?:/|$)")


@dataclass
class Layers:
    """User rules come before attributes, attributes before the defaults; within a layer the last rule that matches counts."""

    user: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    defaults: list[str] = field(default_factory=lambda: list(DEFAULTS))

    @classmethod
    def parse(cls, user: str = "", gitattributes: str = "") -> Layers:
        rules = [x.strip() for x in user.splitlines()]
        marked = []
        for line in gitattributes.splitlines():
            name, *values = line.split() or [""]
            if name and not name.startswith("#") and any(v in ("linguist-generated", "linguist-generated=true", "linguist-vendored", "linguist-vendored=true") for v in values):
                marked.append(name)
        return cls([x for x in rules if x and not x.startswith("#")], marked)

    def counts(self) -> dict[str, int]:
        return {"user": len(self.user), "attributes": len(self.attributes), "defaults": len(self.defaults)}

    def is_ignored(self, path: Column) -> Column:
        """True for paths to leave out."""
        out = F.lit(False)
        for layer in (self.defaults, self.attributes, self.user):
            for rule in layer:
                keep = rule.startswith("!")
                out = F.when(path.rlike(to_regex(rule.removeprefix("!"))), F.lit(not keep)).otherwise(out)
        return out


def kept_hunks(hunks: DataFrame, layers: Layers) -> tuple[DataFrame, DataFrame]:
    """The hunks that are not ignored, and the commits whose every hunk is."""
    marked = hunks.withColumn("__gone", layers.is_ignored(F.col("file_path")))
    kept = marked.where(~F.col("__gone")).drop("__gone")
    emptied = marked.groupBy("commit_sha").agg(F.count("*").alias("paths"), F.sum(F.when(F.col("__gone"), 0).otherwise(1)).alias("kept")).where("paths > 0 and kept = 0").select("commit_sha")
    return kept, emptied


BEGIN, END = "# === auto-generated by plan ", "# === end auto-generated ==="


def render_rules(patterns: list[str], version: str, when: str) -> str:
    return "\n".join([f"{BEGIN}{version}, {when} ===", *patterns, END, "", "# lines below are kept when the plan is made again", ""])


def merge_rules(existing: str, section: str) -> str:
    """The file with its generated section replaced; other lines stay.  ValueError if there is no such section."""
    if not existing.strip():
        return section
    begin = existing.find(BEGIN)
    if begin < 0:
        raise ValueError("the file has rules of its own and no generated section")
    end = existing.find(END, begin)
    if end < 0:
        raise ValueError("the generated section has no end")
    after = existing.find("\n", end)
    return existing[:begin] + section + (existing[after + 1 :] if after >= 0 else existing[end + len(END) :])
