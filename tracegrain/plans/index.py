"""Building and extending an index of parquet tables, and its state.

A batch writes its own folder of each table, and then one manifest that names all
folders, so that it is there as a whole or not at all (plans.manifest): an
interrupted run leaves folders that nothing names, and writers at the same time lose
nothing of each other.  What is indexed is not written again; a table is merged
when it has MOST_PARTS folders.  Texts go to segments (operators.segments), so a
batch costs what it holds and not what the index does.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.functions import text as T
from tracegrain.operators import cells, chunking, history, segments, symbols, tables, trigrams
from tracegrain.operators.fulltext import TextIndex
from tracegrain.operators.ignore import Layers, kept_hunks
from tracegrain.plans import retrieve
from tracegrain.plans.manifest import KEPT, Manifests
from tracegrain.sources import parser

MODEL, DIM = "hashed-trigrams", 384
COMMITS = "commit_sha string, parent_sha string, is_merge boolean, author string, ts long, message string, ulid string, message_emb array<float>"
HUNKS = "hunk_id long, commit_sha string, file_path string, language string, change_kind string, diff_text string, semantic_text string, diff_emb array<float>"
CACHE = "content_hash string, embed_model string, diff_emb array<float>"
META = "repo_id string, component string, version string, recorded_at long"
FILES = "path string, language string, ord long"
HUNK_SYMBOLS = "hunk_id long, symbol_kind string, symbol_name string, attribution_kind string"
DEAD = "commit_sha string, reason string, detail string"
FACTS = "hunk_id long, file_path string, language string, ts long"
IGNORED = "commit_sha string"
#: The tables that batches add to.
SCHEMAS = {"commits": COMMITS, "hunks": HUNKS, "cache": CACHE, "files": FILES, "hunk_symbols": HUNK_SYMBOLS, "dead_letters": DEAD, "ignored": IGNORED, "facts": FACTS, "grams": trigrams.GRAMS}
#: The text indexes and their columns: over the hunks, and over the symbols at HEAD.
TEXTS = {"text": ["diff_text"], "semantic": ["semantic_text"], "head": ["kind", "name", "sibling_names"]}
MOST_PARTS = 32


@dataclass
class Report:
    """What a batch has done: counts, and seconds by phase."""

    commits: int = 0
    hunks: int = 0
    dead_letters: int = 0
    seconds: dict[str, float] = field(default_factory=dict)


def hunk_id():
    """Tells apart the hunks of a file in a commit; a hunk that is repeated word for word is one."""
    return F.xxhash64("commit_sha", "file_path", "diff_text")


class Index:
    """Tables under a folder, each in parts that the last manifest names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.manifests = spark, path, Manifests(spark, path)

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _pointers(self) -> dict:
        return self.manifests.state()

    def _delete(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)

    def table(self, name: str, schema: str, state: dict | None = None) -> DataFrame:
        """A table as a state of the index (the last, if none is given) has it."""
        parts = (self._pointers() if state is None else state).get(name) or []
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/{part}" for part in parts]) if parts else self.spark.createDataFrame([], schema)

    def _write(self, name: str, rows: DataFrame) -> str:
        part = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{name}/{part}")
        return part

    def put(self, name: str, rows: Callable[[dict], DataFrame]) -> None:
        """Rows, made of the index's state, in place of a table's; the old parts stay for those who read them until vacuum()."""
        self.manifests.commit(lambda state: state | {name: [self._write(name, rows(state))]})

    def vacuum(self, kept: int = KEPT, seconds: float = 3600) -> int:
        """Remove manifests but the last, and folders that none of these names and that nobody has written to for so long; how many."""
        named: set[str] = set()
        for state in self.manifests.forget(kept):
            for name, held in state.items():
                named |= {f"{name}/{x}" for x in (segments.folders(held) if name in TEXTS else cells.folders(held) if name == "cells" else held if isinstance(held, list) else [])}
        gone = 0
        for name in (*SCHEMAS, *TEXTS, "cells", "metadata", "symbols", "seen", "parsed", "unkept"):
            fs, where = self._fs(f"{self.path}/{name}")
            for part in [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []:
                if f"{name}/{part}" not in named and self.manifests.age(f"{self.path}/{name}/{part}") >= seconds:
                    self._delete(f"{self.path}/{name}/{part}")
                    gone += 1
        return gone

    @property
    def bookmark(self) -> str | None:
        """The commit that was walked last."""
        return self._pointers().get("bookmark")

    def _known(self, state: dict | None = None) -> DataFrame:
        """commit_sha of what is indexed, and of what was looked at and left out."""
        state = self._pointers() if state is None else state
        return self.table("commits", COMMITS, state).select("commit_sha").unionByName(self.table("ignored", IGNORED, state))

    def ingest(
        self,
        commits: DataFrame,
        hunks: DataFrame,
        layers: Layers | None = None,
        embed_mode: str = "semantic",
        post_images: DataFrame | None = None,
        embedder: Callable = chunking.hashing_embedder,
        progress: Callable[[str, float], None] | None = None,
    ) -> Report:
        """Index the commits that are not yet known; nothing is written if there are none.

        commits: commit_sha, parent_sha, is_merge, author, ts, message, and walk_ord
        if their order is to be other than that of ts; hunks: commit_sha, file_path,
        language, change_kind, diff_text; post_images: commit_sha, path, source, whose
        symbols are attributed to the hunks of their files.  Commits without a sha or
        a time, and hunks without a commit or a path, become dead letters and stop nothing.
        A hunk that is repeated word for word counts once.
        embed_mode: semantic (the text with its message), diff (the diff alone),
        or off (semantic, without the cache).
        """
        report = Report()

        @contextmanager
        def phase(name: str):
            began = time.time()
            yield
            report.seconds[name] = report.seconds.get(name, 0.0) + time.time() - began
            if progress:
                progress(name, report.seconds[name])

        layers = layers or Layers()
        with phase("scan"):
            seen = self._pointers()
            good = F.col("commit_sha").isNotNull() & F.col("ts").isNotNull()
            fresh = tables.missing(commits.where(good), self._known(seen), ["commit_sha"]).dropDuplicates(["commit_sha"])
            walked = F.col("walk_ord") if "walk_ord" in commits.columns else F.lit(0)
            last = commits.where(good).agg(F.max_by("commit_sha", F.struct(walked.alias("w"), "ts", "commit_sha")).alias("sha")).first()
            parts: dict[str, str] = {}
            bad = commits.where(~good).select("commit_sha", F.lit("commit without sha or time").alias("reason"), F.col("message").alias("detail"))
            bad = bad.unionByName(hunks.where("commit_sha is null or file_path is null").select("commit_sha", F.lit("hunk without commit or path").alias("reason"), F.coalesce("file_path", "diff_text").alias("detail")))
            old = self.table("dead_letters", DEAD, seen).alias("old")
            same = F.lit(True)
            bad = bad.distinct().alias("bad")
            for c in ("commit_sha", "reason", "detail"):
                same = same & F.col(f"bad.{c}").eqNullSafe(F.col(f"old.{c}"))
            parts["dead_letters"] = self._write("dead_letters", bad.join(old, same, "left_anti"))
            report.dead_letters = self._part("dead_letters", parts["dead_letters"]).count()
            if not fresh.limit(1).count():
                self._publish(parts if report.dead_letters else {}, last.sha)
                if not report.dead_letters:
                    self._delete(f"{self.path}/dead_letters/{parts['dead_letters']}")
                return report
        with phase("filter"):
            new = self._staged(parts, "seen", fresh.drop("walk_ord"))
            own = hunks.where("file_path is not null").join(new.select("commit_sha"), "commit_sha", "left_semi")
            kept, emptied = kept_hunks(own, layers)
            parts["ignored"] = self._write("ignored", emptied.join(new.select("commit_sha"), "commit_sha", "left_semi").select("commit_sha"))
            new = new.join(self._part("ignored", parts["ignored"]), "commit_sha", "left_anti")
        with phase("parse"):
            named = self._staged(parts, "parsed", symbols_of(post_images.join(new.select("commit_sha"), "commit_sha", "left_semi"))) if post_images is not None else None
        with phase("embed"):
            first = named.groupBy("commit_sha", "file_path").agg(F.min_by("name", "span_start").alias("first_symbol")) if named is not None else None
            rows = kept.withColumn("hunk_id", hunk_id()).dropDuplicates(["hunk_id"]).join(new.select("commit_sha", "message", "ts"), "commit_sha")
            rows = rows.join(first, ["commit_sha", "file_path"], "left") if first is not None else rows.withColumn("first_symbol", F.lit(None).cast("string"))
            rows = rows.withColumn("semantic_text", T.semantic_text(F.coalesce("message", F.lit("")), F.coalesce("diff_text", F.lit("")), F.col("first_symbol")))
            rows = rows.withColumn("embedded", F.coalesce("diff_text", F.lit("")) if embed_mode == "diff" else F.col("semantic_text"))
            columns = [c.split()[0] for c in HUNKS.split(", ")]
            cache = self.table("cache", CACHE, seen)
            todo = tables.cache_lookup(rows, cache if embed_mode != "off" else cache.limit(0), MODEL, "embedded")[1]
            made = chunking.embed(todo, "text", DIM, embedder).select("content_hash", F.lit(MODEL).alias("embed_model"), "diff_emb")
            parts["cache"] = self._write("cache", made)  # each text is embedded once, here
            vectors = cache.unionByName(self._part("cache", parts["cache"])).where(F.col("embed_model") == MODEL)
            filled = rows.withColumn("content_hash", F.sha2("embedded", 256)).join(vectors.select("content_hash", "diff_emb"), "content_hash", "left")
            if embed_mode == "off":
                parts["unkept"] = parts.pop("cache")
            else:  # known from now on, so that a run that breaks off below embeds nothing twice
                part = parts.pop("cache")
                self.manifests.commit(lambda state: state | {"cache": [*state.get("cache", []), part]})
        with phase("write"):
            parts["hunks"] = self._write("hunks", filled.select(*columns))
            stored = self._part("hunks", parts["hunks"])
            parts["facts"] = self._write("facts", stored.join(new.select("commit_sha", "ts"), "commit_sha").select("hunk_id", "file_path", "language", "ts"))
            parts["files"] = self._write("files", stored.select(F.col("file_path").alias("path"), "language").distinct().withColumn("ord", F.lit(time.time_ns())))
            if named is not None:
                met = symbols.live_attribution(stored.select("hunk_id", F.concat_ws("\0", "commit_sha", "file_path").alias("file_path")), named.withColumn("file_path", F.concat_ws("\0", "commit_sha", "file_path")))
                parts["hunk_symbols"] = self._write("hunk_symbols", met)
                parts["grams"] = uuid.uuid4().hex
                trigrams.write(self._part("hunk_symbols", parts["hunk_symbols"]), f"{self.path}/grams/{parts['grams']}")
            stamped = new.withColumn("ulid", T.ulid(F.col("ts"), F.col("commit_sha"))).withColumn("said", F.coalesce("message", F.lit("")))
            stamped = chunking.embed(stamped, "said", DIM, embedder).withColumnRenamed("diff_emb", "message_emb").select(*[c.split()[0] for c in COMMITS.split(", ")])
            parts["commits"] = self._write("commits", stamped)
            report.commits, report.hunks = (self._part(name, parts[name]).count() for name in ("commits", "hunks"))
        with phase("text"):
            added = {name: segments.add(self.spark, f"{self.path}/{name}", segments.empty(), stored, "hunk_id", columns)["segments"] for name, columns in TEXTS.items() if name != "head"}
        with phase("publish"):
            temporary = {name: parts.pop(name) for name in ("seen", "parsed", "unkept") if name in parts}
            done = self._publish(parts, last.sha, added, seen)
            for name, part in temporary.items():
                self._delete(f"{self.path}/{'cache' if name == 'unkept' else name}/{part}")
        if not done:  # another writer has indexed some of these commits meanwhile
            return self.ingest(commits, hunks, layers, embed_mode, post_images, embedder, progress)
        with phase("merge"):
            self._merge_many()
        return report

    def _publish(self, parts: dict[str, str], bookmark: str | None, added: dict[str, list[dict]] | None = None, seen: dict | None = None) -> bool:
        """Name a batch's parts and segments in the next manifest; False if others have indexed some of its commits since `seen`."""
        met: list[bool] = []

        def change(state: dict) -> dict:
            met.clear()
            if seen is not None and any(state.get(name) != seen.get(name) for name in ("commits", "ignored")):
                own = self._part("commits", parts["commits"]).select("commit_sha")
                if own.join(self._known(state), "commit_sha", "left_semi").limit(1).count():
                    met.append(True)
                    return state
            new = state | {name: [*state.get(name, []), part] for name, part in parts.items()}
            for name, more in (added or {}).items():
                held = new.get(name) or segments.empty()
                new[name] = held | {"segments": [*held["segments"], *more]}
            if "hunks" in parts:
                new["cells"] = self._dealt(new, parts["hunks"])
            return new | ({"bookmark": bookmark} if bookmark else {})

        self.manifests.commit(change)
        return not met

    def _dealt(self, state: dict, part: str) -> dict:
        """The vectors of a state by cell, those of a new part among them; all are dealt anew when there are many more than before."""
        held = state.get("cells") or {}
        if not held.get("parts") or cells.size(held) >= cells.GROWTH * max(held["fitted"], cells.CELL_ROWS):
            return cells.build(self.spark, f"{self.path}/cells", self.table("hunks", HUNKS, state), "hunk_id", "diff_emb")
        return cells.add(self.spark, f"{self.path}/cells", held, self._part("hunks", part), "hunk_id", "diff_emb")

    def _part(self, name: str, part: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}/{part}")

    def _staged(self, parts: dict[str, str], name: str, rows: DataFrame) -> DataFrame:
        parts[name] = self._write(name, rows)
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}/{parts[name]}")

    def _merge_many(self) -> None:
        """Merge tables of too many parts, and segments of like size."""
        state = self._pointers()
        for name, parts in state.items():
            if name in SCHEMAS and len(parts) > MOST_PARTS:
                merged = self._write(name, self.table(name, SCHEMAS[name], state))
                self._replace(name, parts, [merged])
            elif name == "cells" and len(parts["parts"]) > MOST_PARTS:
                made = cells.merge(self.spark, f"{self.path}/cells", parts)
                self.manifests.commit(lambda now, was=parts, made=made: now | {"cells": made} if now.get("cells") == was else now)
            elif name in TEXTS:
                names = segments.to_merge(parts)
                if names:
                    made = segments.merge(self.spark, f"{self.path}/{name}", parts, names)
                    # only if nobody has added, deleted or merged meanwhile; the next batch tries again
                    self.manifests.commit(lambda now, name=name, was=parts, made=made: now | {name: made} if now.get(name) == was else now)

    def _replace(self, name: str, old: list[str], new: list[str]) -> bool:
        """Parts in place of others, if these are all there still."""
        done: list[bool] = []

        def change(state: dict) -> dict:
            done.clear()
            held = state.get(name) or []
            if not set(old) <= set(held):
                return state
            done.append(True)
            return state | {name: [*new, *[p for p in held if p not in old]]}

        self.manifests.commit(change)
        return bool(done)

    def forget(self, commits: DataFrame) -> int:
        """Take commits (commit_sha) and their hunks out of the index, as if never seen; how many hunks there were.

        Parts that hold some of them are written again without them; texts get tombstones.
        """
        gone = commits.select("commit_sha").where("commit_sha is not null").distinct()
        found: list[int] = []

        def change(state: dict) -> dict:
            ids = self.table("hunks", HUNKS, state).join(gone, "commit_sha", "left_semi").select("hunk_id")
            found[:] = [ids.count()]
            new = dict(state)
            for name, away, key in (("commits", gone, "commit_sha"), ("ignored", gone, "commit_sha"), ("hunks", gone, "commit_sha"), ("facts", ids, "hunk_id"), ("hunk_symbols", ids, "hunk_id")):
                parts = []
                for part in state.get(name) or []:
                    rows = self._part(name, part)
                    hit = rows.join(away, key, "left_semi").limit(1).count()
                    parts.append(self._write(name, rows.join(away, key, "left_anti")) if hit else part)
                if parts:
                    new[name] = parts
            for name in TEXTS:
                if name != "head" and name in state:
                    new[name] = segments.delete(self.spark, f"{self.path}/{name}", state[name], ids.withColumnRenamed("hunk_id", "doc_id"))
            if state.get("cells"):
                new["cells"] = cells.delete(self.spark, f"{self.path}/cells", state["cells"], ids.withColumnRenamed("hunk_id", "id"))
            return new

        self.manifests.commit(change)
        return found[0]

    # --- Lookups ---

    def commits(self) -> DataFrame:
        return self.table("commits", COMMITS)

    def hunks(self) -> DataFrame:
        return self.table("hunks", HUNKS)

    def commit(self, sha: str) -> DataFrame:
        return self.table("commits", COMMITS).where(F.col("commit_sha") == sha)

    def hunks_of(self, sha: str, file: str | None = None) -> DataFrame:
        own = self.table("hunks", HUNKS).where(F.col("commit_sha") == sha)
        return own if file is None else own.where(F.col("file_path") == file)

    def files(self) -> DataFrame:
        """path and its last known language."""
        return tables.last_known(self.table("files", FILES), ["path"], "language", "ord")

    def neighbours(self, file: str, sha: str, before: int = 2, after: int = 2) -> DataFrame:
        """Indexed commits of a file around one of them."""
        own = self.table("hunks", HUNKS).where(F.col("file_path") == file).join(self.table("commits", COMMITS).select("commit_sha", "ts"), "commit_sha")
        changes = own.select("file_path", "commit_sha", "ts")
        return history.neighbours(changes, changes.where(F.col("commit_sha") == sha), before, after)

    def hunk_symbols(self) -> DataFrame:
        return self.table("hunk_symbols", HUNK_SYMBOLS)

    def put_metadata(self, repo: str, components: dict[str, str], now: int) -> None:
        """Record components; those not named stay."""
        new = self.spark.createDataFrame([(repo, k, v, now) for k, v in components.items()], META)
        self.put("metadata", lambda state: tables.replace_by_key(self.table("metadata", META, state), new, ["repo_id", "component"]))

    def metadata(self, repo: str) -> dict[str, str]:
        found = tables.metadata_map(self.table("metadata", META).where(F.col("repo_id") == repo)).collect()
        return dict(found[0].components) if found else {}

    def replace_symbols(self, rows: DataFrame) -> None:
        """The symbols at HEAD, as parser.head_symbols has them, in place of all there were."""
        part = self._write("symbols", rows.select(*[c.split()[0] for c in parser.SCHEMA.split(", ")]))
        head = _head(self.spark.read.schema(parser.SCHEMA).parquet(f"{self.path}/symbols/{part}"))
        made = segments.add(self.spark, f"{self.path}/head", segments.empty(), head, "symbol_id", TEXTS["head"])
        self.manifests.commit(lambda state: state | {"symbols": [part], "head": made})

    def clear_symbols(self) -> None:
        self.manifests.commit(lambda state: state | {"symbols": [], "head": segments.empty()})

    # --- Search ---

    def state(self) -> dict[str, object]:
        """What is searched: the parts of the tables, and the segments."""
        held = self._pointers()
        return {name: held.get(name) for name in ("hunks", "commits", "symbols", "hunk_symbols", "facts", "cells", "grams", *TEXTS)}

    def corpus(self) -> retrieve.Corpus:
        """What retrieve.find_pattern searches, as the index is now: tables and segments, nothing of which is built or copied here."""
        state = self._pointers()
        rows = self.table("hunks", HUNKS, state).withColumn("commit_id", F.xxhash64("commit_sha"))
        text, semantic, head = (segments.view(self.spark, f"{self.path}/{name}", state.get(name) or segments.empty()) for name in TEXTS)
        return retrieve.Corpus(
            rows.select("hunk_id", "commit_id", "file_path", "language", "change_kind", "diff_text"),
            self.table("commits", COMMITS, state).select(F.xxhash64("commit_sha").alias("commit_id"), "commit_sha", "ts", "author", "message"),
            rows.select("hunk_id", F.col("diff_emb").alias("vector")),
            text,
            semantic,
            head,
            _head(self.table("symbols", parser.SCHEMA, state)),
            self.table("hunk_symbols", HUNK_SYMBOLS, state),
            self.table("facts", FACTS, state),
            cells.view(self.spark, f"{self.path}/cells", state.get("cells") or {}),
            self.table("grams", trigrams.GRAMS, state),
        )

    def text_indexes(self) -> tuple[TextIndex, TextIndex]:
        """Postings over the diffs and over the semantic texts."""
        made = self.corpus()
        return made.text, made.semantic

    def latest(self) -> DataFrame:
        """The commit with the largest ULID."""
        return self.table("commits", COMMITS).where("ulid != ''").orderBy(F.desc("ulid")).limit(1)

    def status(self, commits: DataFrame) -> dict[str, object]:
        """bookmark, commits that were never looked at, and what the cache holds."""
        behind = tables.missing(commits, self._known(), ["commit_sha"]).count()
        stats = tables.cache_stats(self.table("cache", CACHE)).first()
        return {"last_indexed_commit": self.bookmark, "commits_behind_head": behind, "cache_rows": stats.rows, "cache_bytes": stats.bytes}

    def drop(self, home: str) -> None:
        """Delete the index folder, if it is below home and not home itself."""
        fs, where = self._fs(self.path)
        top = self._fs(home)[1]
        here, above = (fs.makeQualified(x).toString().rstrip("/") for x in (where, top))
        if here == above or not here.startswith(above + "/") or ".." in self.path.split("/"):
            raise ValueError(f"{here} is not below {above}")
        fs.delete(where, True)


def _head(symbols: DataFrame) -> DataFrame:
    """Symbols at HEAD as they are searched."""
    return symbols.select(F.xxhash64("file_path", "name", "span_start").alias("symbol_id"), "kind", "name", F.lit("").alias("sibling_names"), "file_path").dropDuplicates(["symbol_id"])


def symbols_of(post_images: DataFrame) -> DataFrame:
    """commit_sha, file_path and the symbols of the files that commits (commit_sha, path, source) have left."""
    files = post_images.select(F.concat_ws(":", "commit_sha", "path").alias("file_path"), "source")
    found = parser.head_symbols(files).withColumn("commit_sha", F.substring_index("file_path", ":", 1))
    return found.select("commit_sha", F.expr("substring(file_path, length(commit_sha) + 2)").alias("file_path"), "kind", "name", "span_start")
