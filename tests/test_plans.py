import subprocess

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracegrain.functions import vectors as V
from tracegrain.operators import chunking, fulltext, ranking
from tracegrain.operators.ignore import Layers
from tracegrain.plans import catalog, explain, index, retrieve, service
from tracegrain.sources import adapters, gitlog, parser
from tracegrain.streaming import ingest

DAY = 86400
T0 = 1704067200  # 2024-01-01
NOW = T0 + 182 * DAY  # 2024-07-01
#: The acceptance set's history and queries.
#: label, days after the start, message, file, language, diff
HISTORY = [
    ("initial_skeleton_commit", 0, "initial: project skeleton", "src/fetch.rs", "rust", "+pub fn fetch() {}\n+pub struct Error;\n+pub fn lib() {}"),
    ("readme_noise_commit", 14, "docs: expand README", "README.md", None, "+# usage notes\n+more words about the project"),
    ("timeout_commit", 31, "fetch: add request timeout handling", "src/fetch.rs", "rust", "+let timeout = Duration::from_secs(5);\n+request.timeout(timeout)  // fix for the timeout bug"),
    ("retry_backoff_commit", 60, "fetch: add retry with exponential backoff", "src/fetch.rs", "rust", "+for attempt in 0..5 {\n+  retry; sleep(backoff * 2)\n+}"),
    ("login_commit", 91, "auth: introduce login function", "src/auth.rs", "rust", "+pub fn login(user: &str) -> bool { true }"),
    ("error_context_commit", 121, "error: wrap errors with context", "src/error.rs", "rust", "+err.context(\"wrap errors with context\")"),
    ("logout_noise_commit", 135, "auth: stub logout", "src/auth.rs", "rust", "+pub fn logout() {}"),
    ("config_loader_commit", 152, "config: load configuration from environment", "app/config.py", "python", "+def load():\n+    return os.environ['DATABASE_URL']  # configure the database url"),
]
#: query, language, expected
GOLDEN = [
    ("retry with exponential backoff", "rust", "retry_backoff_commit"),
    ("request timeout handling", "rust", "timeout_commit"),
    ("load configuration from environment", "python", "config_loader_commit"),
    ("wrap errors with context", "rust", "error_context_commit"),
    ("login function", None, "login_commit"),
    ("where did we configure the database url", "python", "config_loader_commit"),
    ("how did we fix the timeout bug", "rust", "timeout_commit"),
    ("how is `login` called", None, "login_commit"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, label, T0 + d * DAY, "ann", "modified", m, f, lang, diff) for i, (label, d, m, f, lang, diff) in enumerate(HISTORY)]
    wide = spark.createDataFrame(rows, "hunk_id long, commit_sha string, ts long, author string, change_kind string, message string, file_path string, language string, diff_text string").cache()
    hunks = wide.select("hunk_id", F.col("hunk_id").alias("commit_id"), "file_path", "language", "diff_text")
    commits = wide.select(F.col("hunk_id").alias("commit_id"), "commit_sha", "ts", "author", "change_kind", "message")
    sem = wide.select("hunk_id", F.concat("message", F.lit("\n\n"), "diff_text").alias("sem"))
    symbols = spark.createDataFrame([(1, "function", "login", "", "src/auth.rs"), (2, "function", "fetch", "", "src/fetch.rs")], "symbol_id long, kind string, name string, sibling_names string, file_path string")
    hunk_symbols = spark.createDataFrame([(4, "login", "function", "exact_span"), (0, "fetch", "function", "exact_span")], "hunk_id long, symbol_name string, symbol_kind string, attribution_kind string")
    vectors = chunking.embed(sem, "sem", 64).select("hunk_id", F.col("diff_emb").alias("vector")).cache()
    build = fulltext.TextIndex.build
    return retrieve.Corpus(hunks, commits, vectors, build(hunks, "hunk_id", ["diff_text"]), build(sem, "hunk_id", ["sem"]), build(symbols, "symbol_id", ["kind", "name", "sibling_names"]), symbols, hunk_symbols)


def test_golden_queries_are_recalled(spark, corpus):
    import pandas as pd

    ranks = []
    for i, (query, language, expected) in enumerate(GOLDEN):
        vector = chunking.hashing_embedder(pd.Series([query]), 64)[0].tolist()
        hits = retrieve.find_pattern(corpus, query, NOW, vector, k=5, language=language, by_fusion=True).orderBy(F.desc("combined_score")).collect()
        place = next((n for n, h in enumerate(hits, 1) if h.commit_sha == expected), None)
        ranks.append((str(i), place, 1))
    row = ranking.quality(spark.createDataFrame(ranks, "id string, rank int, ms int")).first()
    assert row.recall_at_5 == 1.0
    assert row.mrr >= 0.8


def test_neighbours_of_all_changes(spark):
    d = "/root/testdata/sf0.001"
    by_file = {}
    for r in catalog._changes(spark, d).collect():
        by_file.setdefault(r.file_path, []).append(r)
    want = []
    for rows in by_file.values():
        for a in rows:
            for side in (0, 1):
                near = sorted((abs(r.ts - a.ts), r.commit_sha) for r in rows if r.commit_sha != a.commit_sha and (r.ts > a.ts) == bool(side))
                want += [(a.commit_sha, sha, side, i + 1) for i, (_, sha) in enumerate(near[:2])]
    got = catalog.queries()["j13_j6_a1_u2_neighbours"](spark, d).select("anchor_sha", "commit_sha", "side", "place").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_live_attribution_of_all_hunks(spark):
    d = "/root/testdata/sf0.001"
    hunks, named = adapters.hunks(spark, d).collect(), adapters.symbols(spark, d).collect()
    want = {(h.hunk_id, s.kind, s.name, "exact_span") for h in hunks for s in named if h.file_path == s.file_path}
    got = catalog.queries()["w6_live_attribution"](spark, d).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert max(r.hunk_id for r in got) >= 60


def test_envelope_and_rerank(corpus):
    hits = retrieve.find_pattern(corpus, "retry with exponential backoff", NOW, k=3, rerank=True)
    told = retrieve.envelope(hits, {"last_indexed_commit": "x"}, None, "compatible", "unknown")
    assert told["hits"][0]["commit_sha"] == "retry_backoff_commit"
    assert told["hits"][0]["commit_date"] == "2024-03-01T00:00:00+00:00"
    assert set(told["_meta"]) == {"index_status", "hint", "compatibility", "query_profile"}


def test_explain_orders_by_time(spark):
    blame = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b"), ("f", 3, "a"), ("f", 4, "zz")], "file string, line int, commit_sha string")
    commits = spark.createDataFrame([("a", T0, "x", "m1"), ("b", T0 + DAY, None, "m2")], "commit_sha string, ts long, author string, message string")
    hunks = spark.createDataFrame([("a", "f", "+1"), ("a", "g", "+2")], "commit_sha string, file_path string, diff_text string")
    rows = explain.explain_change(blame, commits, hunks, "f", 1, 4).collect()
    assert [(r.commit_sha, r.blame_lines, r.diff_excerpt) for r in rows] == [("b", [2], ""), ("a", [1, 3], "+1")]
    meta = explain.explain_meta(blame, commits, "f", 1, 4).first()
    assert (meta.first_line, meta.last_line, meta.blame_coverage) == (1, 4, 0.75) and "1 commit(s)" in meta.limitation
    assert "no attributable lines" in explain.explain_meta(blame, commits, "none", 1, 4).first().limitation


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = tmp_path_factory.mktemp("repo")

    def git(*args, when=T0):
        env = {"GIT_AUTHOR_DATE": f"{when} +0000", "GIT_COMMITTER_DATE": f"{when} +0000", "HOME": str(path), "PATH": "/usr/bin:/bin:/usr/local/bin"}
        subprocess.run(["git", "-C", str(path), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True, env=env)

    git("init", "-q")
    for n, (name, body, message) in enumerate([("src.rs", "fn fetch() {\n}\n", "initial fetch"), ("src.rs", "fn fetch() {\n  retry();\n  sleep(backoff);\n}\n", "add retry with exponential backoff"), ("auth.rs", "fn login() {\n}\n", "add basic login"), ("Cargo.lock", "x\n", "lock only")]):
        (path / name).write_text(body)
        git("add", "-A")
        git("commit", "-q", "-m", message, when=T0 + n * 30 * DAY)
    return str(path)


def read(spark, repo, table, **options):
    return spark.read.format("gitlog").options(repo=repo, table=table, **options).load()


def test_git_source_and_ingest(spark, repo, tmp_path):
    spark.dataSource.register(gitlog.GitLog)
    commits = read(spark, repo, "commits").drop("walk_ord")
    hunks = read(spark, repo, "hunks")
    assert [r.message for r in read(spark, repo, "commits").orderBy("walk_ord").collect()][:2] == ["initial fetch", "add retry with exponential backoff"]
    assert {(r.path) for r in read(spark, repo, "changed_paths").collect()} == {"src.rs", "auth.rs", "Cargo.lock"}
    owned = {r.line: r.commit_sha for r in read(spark, repo, "blame", file="src.rs").collect()}
    assert owned[2] == owned[3] != owned[1]
    assert read(spark, repo, "head_files").count() == 3
    assert read(spark, repo, "post_images").count() == 4
    assert gitlog.count_since(repo, gitlog.first_commit(repo)) == 3
    assert read(spark, repo, "commits", since=gitlog.first_commit(repo)).count() == 3

    made = index.Index(spark, str(tmp_path / "ix"))
    walked = read(spark, repo, "commits")
    images = read(spark, repo, "post_images")
    asked = []

    def embedder(texts, dim):
        with open(tmp_path / "asked", "a") as f:
            f.write("".join(f"{len(t)}\n" for t in texts))
        return chunking.hashing_embedder(texts, dim)

    report = made.ingest(walked, hunks, post_images=images, embedder=embedder, progress=lambda name, seconds: asked.append(name))
    assert (report.commits, report.hunks, report.dead_letters) == (3, 3, 0) and "embed" in report.seconds and asked == list(report.seconds)
    assert len((tmp_path / "asked").read_text().split()) == 6  # each text and each message once
    assert made.commits().where("size(message_emb) = 384").count() == 3  # the one that only locks is left out
    assert made.bookmark == gitlog.head_sha(repo) and made.status(walked)["commits_behind_head"] == 0
    rows = made.table("hunks", index.HUNKS)
    assert rows.count() == 3 and rows.where("size(diff_emb) = 384").count() == 3
    assert {r.semantic_text.split("\n")[0] for r in rows.collect()} == {"fetch", "login"}  # the first symbol
    assert {r.symbol_name for r in made.hunk_symbols().collect()} == {"fetch", "login"}
    state = made._pointers()
    again = made.ingest(walked, hunks, post_images=images)
    assert again.commits == 0 and made._pointers() == state  # nothing new, nothing written
    odd = spark.createDataFrame([("zz", None, False, "a", None, "no time", 9), ("c9", None, False, "a", T0 + 999 * DAY, "late by clock", 1)], "commit_sha string, parent_sha string, is_merge boolean, author string, ts long, message string, walk_ord long")
    pieces = spark.createDataFrame([("c9", "b.rs", "rust", "added", "+fn b() {}"), ("c9", None, None, "added", "+x")], hunks.schema)
    third = made.ingest(odd.unionByName(walked.select(*odd.columns)), pieces)
    assert (third.commits, third.dead_letters) == (1, 2) and made.bookmark == gitlog.head_sha(repo)  # by walk, not by clock
    assert made.commit("c9").count() == 1 and made.hunks_of("c9", "b.rs").count() == 1 and made.hunks_of("c9").count() == 1
    assert {(r.path, r.language) for r in made.files().collect()} >= {("src.rs", "rust"), ("b.rs", "rust")}
    sha = made.hunks_of(gitlog.first_commit(repo)).first().commit_sha
    assert [r.touched_hunks for r in made.neighbours("src.rs", sha).collect()] == [1]

    made.replace_symbols(parser.head_symbols(read(spark, repo, "head_files")))
    text, semantic = made.text_indexes()
    assert fulltext.search(semantic, "retry exponential").count() == 1 and fulltext.search(text, "login").count() == 1
    vector = chunking.hashing_embedder(pd.Series(["retry with exponential backoff"]), index.DIM)[0].tolist()
    best = retrieve.find_pattern(made.corpus(), "retry", NOW, vector, k=3, by_fusion=True, scorer=None).orderBy(F.desc("combined_score")).first()
    assert best.commit_message == "add retry with exponential backoff" and best.related_head_symbols == ["fetch"]
    asking = service.Service(made)
    first, second = (asking.find_pattern("retry", NOW, k=3, by_fusion=True).orderBy(F.desc("combined_score")).first() for _ in range(2))
    assert first == second and first.commit_message == "add retry with exponential backoff"
    told = asking.counters.snapshot()
    assert told["lane_vec"][0] == told["pool"][0] == 2 and told["lane_vec"][2] > 0 and len(asking._vectors) == 1
    behind, meta = asking.explain_change(repo, "src.rs", 1, 3)
    assert [r.commit_message for r in behind.collect()] == ["add retry with exponential backoff", "initial fetch"] and meta.first().blame_coverage == 1.0
    assert asking.blame(repo, "src.rs") is asking.blame(repo, "src.rs")
    assert asking.status(walked) is asking.status(walked) and asking.metadata("none") == {}
    asking.changed()
    assert asking.status(walked)["commits_behind_head"] == 0 and asking.counters.snapshot()["get_index_status"][0] == 2
    logits = retrieve.find_pattern(made.corpus(), "login", NOW, vector, k=5, rerank=True, scorer=lambda q, texts: [9.0 if q in t else -9.0 for t in texts]).orderBy(F.desc("combined_score")).collect()
    assert logits[0].commit_message == "add basic login" and logits[0].similarity > 0.99 and logits[-1].similarity < 0.01
    with pytest.raises(retrieve.RebuildNeeded):
        retrieve.find_pattern(made.corpus(), "retry", NOW, verdict="needs_rebuild")
    assert retrieve.find_pattern(made.corpus(), "AND", NOW, vector, k=2).count() == 2  # a query that text lanes can't read
    made.clear_symbols()
    assert made.table("symbols", parser.SCHEMA).count() == 0
    assert made.latest().first().message == "late by clock"
    made.put_metadata("r", {"schema": "4", "chunker_version": "1"}, 1)
    made.put_metadata("r", {"schema": "5"}, 2)
    assert made.metadata("r") == {"schema": "5", "chunker_version": "1"}
    assert made.status(commits)["cache_rows"] == 4
    with pytest.raises(ValueError):
        index.Index(spark, str(tmp_path)).drop(str(tmp_path))
    made.drop(str(tmp_path))
    assert not (tmp_path / "ix").exists()


def test_parts_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "MOST_PARTS", 2)
    made = index.Index(spark, str(tmp_path / "ix"))
    for n in range(4):
        commits = spark.createDataFrame([(f"c{n}", None, False, "a", T0 + n, "m")], "commit_sha string, parent_sha string, is_merge boolean, author string, ts long, message string")
        report = made.ingest(commits, spark.createDataFrame([(f"c{n}", "a.rs", "rust", "added", f"+{n}")], "commit_sha string, file_path string, language string, change_kind string, diff_text string"))
        assert report.seconds
    assert len(made._pointers()["hunks"]) <= 2 and made.table("hunks", index.HUNKS).count() == made.table("commits", index.COMMITS).count() == 4


def test_submodules_are_passed_over(spark, repo, tmp_path):
    git = lambda *args: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.rs").write_text("fn a() {}\n")
    git("add", "-A")
    git("update-index", "--add", "--cacheinfo", f"160000,{gitlog.head_sha(repo)},sub")
    git("commit", "-q", "-m", "one")
    spark.dataSource.register(gitlog.GitLog)
    for table in ("head_files", "post_images", "hunks", "changed_paths"):
        assert read(spark, str(tmp_path), table).count() == 1
    assert parser.extract(None, None) == [] and parser.extract("a.rs", None) == []


def test_streamed_ingest_is_idempotent(spark, tmp_path):
    rows = [("c1", None, False, "a", T0, "first", [("a.rs", "rust", "added", "+fn f() {}")]), ("c2", "c1", False, "a", T0 + 1, "second", [("a.rs", "rust", "modified", "+x")])]
    made = index.Index(spark, str(tmp_path / "ix"))
    incoming = str(tmp_path / "in")
    spark.createDataFrame(rows[:1], ingest.ARRIVING).coalesce(1).write.parquet(incoming)
    ingest.follow(spark, incoming, made, str(tmp_path / "cp"), Layers()).awaitTermination()
    spark.createDataFrame(rows, ingest.ARRIVING).coalesce(1).write.mode("append").parquet(incoming)
    ingest.follow(spark, incoming, made, str(tmp_path / "cp"), Layers()).awaitTermination()
    assert {r.commit_sha for r in made.table("commits", index.COMMITS).collect()} == {"c1", "c2"}
    assert made.table("hunks", index.HUNKS).count() == 2 and made.bookmark == "c2"


def test_event_windows_stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'view' as event_type, 1.0D as value union all select timestamp'2024-01-01 05:00:00', 'view', 2.0D")
    rows.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev"))
    q = ingest.event_counts(stream).writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.n, r.total) for r in spark.table("windows").collect()] == [(1, 1.0)]


def test_golden_reader(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"id": "a", "query": "q", "expected_paths": ["p"]}\n{"id": "b", "query": "r", "since_unix": 5}\n')
    assert {(r.id, r.since_unix) for r in adapters.golden(spark, str(tmp_path / "g.jsonl")).collect()} == {("a", None), ("b", 5)}


def test_similarity_modes(spark):
    strict, fixed = spark.range(1).select(V.bm25_similarity(F.lit(-3.0)), V.bm25_similarity(F.lit(-3.0), strict=False)).first()
    assert (strict, fixed) == (0.25, 0.75)


def test_a_corpus_splits_texts_once(spark, monkeypatch):
    """The text and the semantic lane share what texts are split into, and no text moves to its message."""
    d, seen = "/root/testdata/sf0.001", spark.sparkContext.accumulator(0)
    hunks = catalog.A.hunks(spark, d).cache()

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    monkeypatch.setattr(catalog.A, "hunks", lambda *_: hunks.withColumn("diff_text", read("diff_text")))
    corpus = catalog.corpus(spark, d)
    hits = [{(r.doc_id, round(r.score, 9)) for r in fulltext.search(i, "of_the OR thnd").collect()} for i in (corpus.text, corpus.semantic)]
    assert hits[0] and seen.value == hunks.count()
    built = fulltext.TextIndex.build(corpus.semantic.docs, "hunk_id", ["sem"])
    assert hits[1] == {(r.doc_id, round(r.score, 9)) for r in fulltext.search(built, "of_the OR thnd").collect()}


def test_heads_before_texts(spark):
    """Counts, lengths and places of texts with heads are those of the joined texts: empty sides, phrases over the border, heads shared or missing."""
    texts = spark.createDataFrame([(1, 7, "the end"), (2, 7, None), (3, 8, "b a"), (4, 8, ""), (5, 9, "the end a"), (6, None, "a")], "id long, c long, one string")
    heads = spark.createDataFrame([(7, "Look at THE"), (8, ""), (10, "a")], "c long, said string")
    whole = texts.join(heads, "c").select("id", F.concat("said", F.lit("\n\n"), F.coalesce("one", F.lit(""))).alias("sem"))
    made = fulltext.TextIndex.build(texts, "id", ["one"], ("c",)).before(heads, "said", "c", whole, "sem")
    built = fulltext.TextIndex.build(whole, "id", ["sem"])
    terms = ["the", "a", "nowhere", "look"]
    assert made.in_docs(terms) == built.in_docs(terms) and made.known() == built.known()

    def told(df):
        return sorted((r.doc_id, r.term, list(r.positions), r.length) for r in df.collect())

    assert told(made.of(terms)) == told(built.of(terms))
    for query in ("the_the", "the NOT look", "a", "look the end"):
        assert sorted(map(tuple, fulltext.search(made, query).collect())) == sorted(map(tuple, fulltext.search(built, query).collect()))
