import random

import pytest
from pyspark.sql import functions as F

from tracegrain.functions import session
from tracegrain.functions.text import fold_word, tokens
from tracegrain.operators import chunking, fulltext, history, ignore, ranking, segments, symbols, tables
from tracegrain.sources.parser import extract, head_symbols


def test_fusion_by_hand(spark):
    rows = [(0, r, h, 1.0 / r) for r, h in enumerate([1, 2, 3], 1)] + [(1, r, h, 0.5) for r, h in enumerate([3, 1, 2], 1)]
    fused = ranking.fuse(spark.createDataFrame(rows, "lane int, rank int, hunk_id long, similarity double"), 60)
    assert [r.hunk_id for r in ranking.pool(fused, 3).orderBy("pool_rank").collect()] == [1, 3, 2]
    again = ranking.fuse(spark.createDataFrame([(0, 1, 7, 1.0), (0, 2, 7, 0.5)], "lane int, rank int, hunk_id long, similarity double"), 60)
    assert again.first().rrf == pytest.approx(1 / 61 + 1 / 62)


def test_recency_and_sigmoid(spark):
    row = ranking.weigh_by_age(spark.createDataFrame([(0.5, 1000)], "similarity double, ts long"), 1000, 0.05, 90).first()
    assert row.combined_score == pytest.approx(0.525)
    xs = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 3.0)], "n string, x double").orderBy(F.desc(ranking.sigmoid(F.col("x"))))
    assert [r.n for r in xs.collect()] == ["c", "a", "b"]


TEXTS = [(1, "retry with backoff, then retry"), (2, "backoff with retry"), (3, "rétry later"), (4, ""), (5, None)]


def found(spark, query):
    index = fulltext.TextIndex.build(spark.createDataFrame(TEXTS, "id long, t string"), "id", ["t"])
    return {r.doc_id for r in fulltext.search(index, query).collect()}


def test_query_language(spark):
    assert found(spark, "retry") == {1, 2, 3}
    assert found(spark, "retry backoff") == {1, 2}
    assert found(spark, "retry_with_backoff") == {1}
    assert found(spark, "retry NOT backoff") == {3}
    assert found(spark, "later OR then") == {1, 3}
    for bad in ("", "AND", "retry AND", "!!"):
        with pytest.raises(fulltext.QuerySyntaxError):
            fulltext.compile_query(fulltext.sanitize(bad))
    assert fulltext.sanitize("  a-b_c! ") == "a b_c"


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("alpha NOT beta AND gamma", {3}),
        ("alpha NOT beta gamma", {1, 2, 3}),
        ("alpha AND beta OR delta", {2, 4, 5}),
        ("delta OR alpha NOT gamma", {1, 2, 5}),
        ("delta OR alpha AND gamma", {3, 4, 5}),
        ("alpha NOT beta NOT gamma", {1}),
        ("alpha beta AND gamma", {4}),
        ("alpha and", set()),
    ],
)
def test_operators_bind_in_order(spark, query, want):
    rows = [(1, "alpha"), (2, "alpha beta"), (3, "alpha gamma"), (4, "alpha beta gamma"), (5, "delta")]
    index = fulltext.TextIndex.build(spark.createDataFrame(rows, "id long, t string"), "id", ["t"])
    assert {r.doc_id for r in fulltext.search(index, query).collect()} == want


@pytest.mark.parametrize("bad", ["NOT a", "a OR", "a AND OR b", "a NOT NOT b", "OR", "a AND _"])
def test_operators_need_both_sides(bad):
    with pytest.raises(fulltext.QuerySyntaxError):
        fulltext.compile_query(fulltext.sanitize(bad))


WORDS = ["чай", "Йод", "việt", "Việt", "ά", "ΆΛΦΑ", "ΣΙΣΥΦΟΣ", "e\u0301te\u0301", "été", "İstanbul", "straße", "naïve", "日本語", "Åse", "ệ", "हिन्दी"]


def test_a_document_is_found_by_its_own_words(spark):
    index = fulltext.TextIndex.build(spark.createDataFrame(list(enumerate(WORDS)), "id long, t string"), "id", ["t"])
    for i, word in enumerate(WORDS):
        assert i in {r.doc_id for r in fulltext.search(index, word).collect()}
    folded = [tuple(r.ts) for r in spark.createDataFrame([(w,) for w in WORDS], "w string").select(tokens(F.col("w")).alias("ts")).collect()]
    assert folded == [fold_word(w) for w in WORDS]
    assert fold_word("e\u0301te\u0301") == fold_word("été") == ("ete",) and fold_word("чай") == ("чай",)


def test_columns_do_not_share_phrases(spark):
    rows = spark.createDataFrame([(1, "function", "login")], "id long, kind string, name string")
    index = fulltext.TextIndex.build(rows, "id", ["kind", "name"])
    assert fulltext.search(index, "login function").count() == 1
    assert fulltext.search(index, "function_login").count() == 0


def test_index_is_written_and_read(spark, tmp_path):
    fulltext.TextIndex.build(spark.createDataFrame(TEXTS, "id long, t string"), "id", ["t"]).write(str(tmp_path))
    assert fulltext.search(fulltext.TextIndex.read(spark, str(tmp_path)), "later").count() == 1


def test_symbol_fan_out_gives_distinct_hunks(spark):
    syms = spark.range(100).select(F.col("id").alias("symbol_id"), F.lit("function").alias("kind"), F.lit("run").alias("name"), F.concat(F.lit("f"), "id").alias("file_path"))
    hunks = spark.range(100).join(spark.range(50).withColumnRenamed("id", "j")).select((F.col("id") * 50 + F.col("j")).alias("hunk_id"), F.concat(F.lit("f"), "id").alias("file_path"))
    got = symbols.head_symbol_hunks(fulltext.TextIndex.build(syms, "symbol_id", ["kind", "name"]), syms, hunks, "run", 50).collect()
    assert len({r.hunk_id for r in got}) == 50


def test_attribution_prefers_exact(spark):
    hunks = spark.createDataFrame([(1, "a.rs", "@@ -1,2 +3,2 @@ fn f()\n+x")], "hunk_id long, file_path string, diff_text string")
    syms = spark.createDataFrame([("a.rs", "function", "f", 1, 3), ("a.rs", "function", "g", 5, 9)], "file_path string, kind string, name string, line_start int, line_end int")
    assert [(r.symbol_name, r.attribution_kind) for r in symbols.attribute(hunks, syms).collect()] == [("f", "exact_span")]


def test_neighbours_and_ancestors(spark):
    changes = spark.createDataFrame([("f", str(i), i * 10) for i in range(8)], "file_path string, commit_sha string, ts long")
    near = history.neighbours(changes, changes.where("commit_sha = '4'"), 2, 2).collect()
    assert {(r.commit_sha, r.side) for r in near} == {("3", 0), ("2", 0), ("5", 1), ("6", 1)}
    chain = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(20)], "commit_sha string, parent_sha string")
    assert {r.commit_sha for r in history.ancestors(chain, "12").collect()} == {str(i) for i in range(13)}


@pytest.mark.parametrize(("before", "after"), [(2, 2), (1, 3), (0, 1)])
def test_neighbours_of_every_change(spark, before, after):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), f"c{i}", rng.randrange(25)) for i in range(120)]
    rows += rows[:5]  # two hunks of a commit
    changes = spark.createDataFrame(rows, "file_path string, commit_sha string, ts long")
    got = sorted(map(tuple, history.neighbours(changes, changes, before, after).collect()))
    want = []
    for f, sha, ts in set(rows):
        for side, n in ((0, before), (1, after)):
            near = sorted((abs(t - ts), c, t) for g, c, t in set(rows) if g == f and c != sha and (t > ts) == bool(side))
            want += [(sha, f, c, t, side, i + 1, rows.count((f, c, t))) for i, (_, c, t) in enumerate(near[:n])]
    assert got == sorted(want)


def test_neighbours_do_not_pair_a_file_s_commits(spark):
    changes = spark.range(40_000).selectExpr("'hot' as file_path", "cast(id as string) as commit_sha", "id as ts")
    assert history.neighbours(changes, changes, 2, 2).count() == 4 * 40_000 - 6  # 1.6 billion pairs


def test_share_threshold(spark):
    paths = spark.createDataFrame([(str(i), "src/a.rs") for i in range(30)] + [("0", "rare/x"), ("1", "docs/y"), ("2", "docs/z")], "commit_sha string, path string")
    assert [r.prefix for r in history.suggested(history.path_shares(paths), 30).collect()] == ["src/"]


def test_coverage_of_lines(spark):
    blame = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b"), ("f", 3, "a")], "file string, line int, commit_sha string")
    row = history.coverage(history.owned_lines(blame, "f", 1, 9), spark.createDataFrame([("a",)], "commit_sha string")).first()
    assert (row.lines, row.indexed_lines, row.skipped) == (3, 2, ["b"])
    assert history.owned_lines(blame, "f", 7, 9).count() == 0


@pytest.mark.parametrize(
    ("path", "gone"),
    [("Cargo.lock", True), ("a/node_modules/x.js", True), ("src/main.rs", False), ("keep.lock", False), ("gen/a.pb.go", True), ("lib/x.min.js", True), ("build.rs", False), ("docs/deep/b.txt", True)],
)
def test_ignore_layers(spark, path, gone):
    layers = ignore.Layers.parse("!keep.lock\ndocs/**/b.txt\n# note", "gen/* linguist-generated=true\n*.md text")
    assert spark.range(1).select(layers.is_ignored(F.lit(path))).first()[0] is gone


def test_rules_are_merged():
    new = ignore.render_rules(["a/"], "1", "now")
    assert ignore.merge_rules("", new) == new
    merged = ignore.merge_rules("mine\n" + ignore.render_rules(["b/"], "0", "then") + "last\n", new)
    assert merged.startswith("mine\n") and "a/" in merged and "b/" not in merged and merged.endswith("last\n")
    with pytest.raises(ValueError):
        ignore.merge_rules("mine\n", new)


def test_keyed_writes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert {tuple(r) for r in tables.replace_by_key(old, new, ["k"]).collect()} == {(1, "a"), (2, "x"), (3, "y")}
    assert {tuple(r) for r in tables.insert_or_ignore(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "y")}
    rows = spark.createDataFrame([("p", "rust", 1), ("p", None, 2), ("q", None, 1)], "path string, language string, ord int")
    assert {tuple(r) for r in tables.last_known(rows, ["path"], "language", "ord").collect()} == {("p", "rust"), ("q", None)}


def test_each_text_is_embedded_once(spark):
    rows = spark.createDataFrame([(1, "x y z"), (2, "x y z"), (3, "other")], "id int, text string")
    cache = spark.createDataFrame([], "content_hash string, embed_model string, diff_emb array<float>")
    filled, fresh = chunking.embed_missing(rows, cache, "m", dim=16)
    assert fresh.count() == 2 and filled.where("size(diff_emb) = 16").count() == 3


def test_chunks(spark):
    rows = spark.createDataFrame([("f", "function", n, i * 10, i * 10 + 9, c) for i, (n, c) in enumerate([("a", 800), ("b", 1000), ("c", 400), ("d", 9000)])], "file_path string, kind string, name string, span_start int, span_end int, n_chars int")
    assert [(r.name, r.sibling_names, r.span_end) for r in chunking.chunk_symbols(rows, 500).orderBy("span_start").collect()] == [("a", ["b"], 19), ("c", [], 29), ("d", [], 39)]


def test_symbols_of_sources(spark):
    assert [(k, n) for k, n, *_ in extract("a.py", "class A:\n    def f(self):\n        pass\n\ndef g():\n    return 1\n")] == [("class", "A"), ("method", "f"), ("function", "g")]
    assert [(k, n) for k, n, *_ in extract("a.rs", "pub fn fetch(u: &str) -> String {\n  x()\n}\nstruct B;\n")] == [("function", "fetch"), ("class", "B")]
    files = spark.createDataFrame([("a.rs", "fn f() {\n}\n"), ("b.txt", "fn f() {}")], "file_path string, source string")
    assert [(r.name, r.line_start, r.line_end) for r in head_symbols(files).collect()] == [("f", 1, 2)]


def test_quality(spark):
    row = ranking.quality(spark.createDataFrame([("a", 1, 5), ("b", 3, 10), ("c", None, 20)], "id string, rank int, ms int")).first()
    assert (row.cases, row.recall_at_1, row.recall_at_5, row.mrr, row.p50_ms, row.p95_ms) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3), pytest.approx((1 + 1 / 3) / 3), 10, 20)


def test_intervals_meet_once(spark):
    import random

    rng = random.Random(3)

    def made(n, longest):
        out = []
        for i in range(n):
            s = rng.randint(0, 60_000)
            out.append((i, rng.choice(["a", "b", None]), s, s + int(rng.random() ** 6 * longest) - (rng.random() < 0.1)))
        return out

    left, right = made(300, 50_000), made(300, 2_000_000)
    left += [(300, "a", 5, 4), (301, "a", None, 9), (302, "a", 64, 64), (303, "b", 0, 2_000_000_000)]
    right += [(300, "a", 4, 5), (301, "a", 63, 64), (302, "b", 5, 5), (303, "a", 5, 5)]
    a = spark.createDataFrame(left, "i int, key string, s long, e long")
    b = spark.createDataFrame(right, "j int, key string, line_start int, line_end int")
    got = sorted((r.i, r.j) for r in symbols.overlapping(a, b, "key").select("i", "j").collect())
    want = sorted((i, j) for i, k, s, e in left for j, m, x, y in right if k is not None and k == m and s is not None and x <= e and s <= y)
    assert got == want


def test_intervals_of_one_key_follow_what_they_find(spark):
    """A file with 100,000 spans and as many hunks, where all pairs would be ten thousand million."""
    n = 100_000
    a = spark.range(n).select(F.col("id").alias("i"), F.lit("f").alias("key"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 4).alias("e"))
    b = spark.range(n).select(F.col("id").alias("j"), F.lit("f").alias("key"), (F.col("id") * 10 + 3).alias("line_start"), (F.col("id") * 10 + 11).alias("line_end"))
    assert symbols.overlapping(a, b, "key").count() == 2 * n - 1


def test_parents_come_first_whatever_the_clocks_say(spark):
    #: a merge of a long and a short side, with clocks that run backwards
    edges = [("b", "a"), ("c", "b"), ("d", "c"), ("m", "a"), ("m", "d"), ("n", "m"), ("x", "gone"), ("n", "x")]
    commits = spark.createDataFrame([(c, i) for i, c in enumerate(["n", "m", "d", "c", "b", "a", "x"])], "commit_sha string, ts long")
    parents = spark.createDataFrame(edges, "commit_sha string, parent_sha string")
    got = {r.commit_sha: (r.generation, r.walk_key) for r in history.commit_scan(commits, parents=parents).collect()}
    assert {c: g for c, (g, _) in got.items()} == {"a": 0, "b": 1, "c": 2, "d": 3, "m": 4, "n": 5, "x": 0}
    assert all(got[p][1] < got[c][1] for c, p in edges if p in got)
    known = spark.createDataFrame([("a",), ("b",)], "commit_sha string")
    assert {r.commit_sha: r.generation for r in history.commit_scan(commits, known, parents).collect()} == {"c": 0, "d": 1, "m": 2, "n": 3, "x": 0}
    with pytest.raises(ValueError):
        history.generations(commits, spark.createDataFrame([("a", "b"), ("b", "a")], parents.schema)).collect()


def test_only_merges_choose_among_their_parents(spark, monkeypatch):
    """Chains hang on their merges before any choice is made; numbers that two commits share are dealt anew."""
    edges, names = [], [f"c{i:03}" for i in range(300)]
    for i in range(1, 300):
        edges += [(i, max(i - 2, 0))] + ([(i, i - 1)] if i % 7 == 0 else []) + ([(i, i // 2)] if i % 11 == 0 else [])
    want = [0] * 300
    for c, p in edges:
        want[c] = max(want[c], want[p] + 1)
    rows = [(names[c], names[p]) for c, p in edges] + [("c005", "gone")]
    commits, parents = spark.createDataFrame([(x,) for x in names], "commit_sha string"), spark.createDataFrame(rows, "commit_sha string, parent_sha string")
    asked, plain = [], history._longest
    monkeypatch.setattr(history, "_longest", lambda edges, n: asked.append(edges.select("c").distinct().count()) or plain(edges, n))
    number = history._number
    monkeypatch.setattr(history, "_number", lambda sha, salt: number(sha, salt) if salt else F.length(sha).cast("long"))
    got = {r.commit_sha: r.generation for r in history.generations(commits, parents).collect()}
    assert got == dict(zip(names, want, strict=True))
    assert len(asked) == 1 and asked[0] < 80
    assert {r.generation for r in history.generations(commits, parents.limit(0)).collect()} == {0}
    with pytest.raises(ValueError):
        loop = [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "a")]
        history.generations(spark.createDataFrame([("a",), ("b",), ("c",)], "commit_sha string"), spark.createDataFrame(loop, parents.schema)).collect()


def test_live_attribution_meets_distinct_sides(spark, monkeypatch):
    """Rows that repeat don't multiply the pairs; hunks with two files and files dealt to many tasks lose nothing."""
    monkeypatch.setattr(symbols, "PAIRS", 50)
    hunks = spark.createDataFrame([(i, f"f{i % 2}") for i in range(60)] * 2 + [(5, "f0"), (None, "f1"), (70, None)], "hunk_id long, file_path string")
    named = spark.createDataFrame([(f"f{i % 3}", "fn", f"n{i % 7}") for i in range(200)] + [(None, "fn", "x"), ("f0", None, "y")], "file_path string, kind string, name string")
    want = {(h.hunk_id, s.kind, s.name, "exact_span") for h in hunks.collect() for s in named.collect() if h.file_path == s.file_path and h.file_path}
    found = symbols.live_attribution(hunks, named)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Join")
    assert plan[: plan.index("Join")].count("Aggregate") <= 1  # pairs of hunks with several files alone are made distinct


def test_attribution_meets_each_span_once(spark):
    """A span that repeats is one before it meets hunks, and no side is broadcast, as sizes leave out their buckets."""
    hunks = spark.createDataFrame([(i, "f", f"@@ -1 +{i % 5 + 1},3 @@\n+x") for i in range(40)], "hunk_id long, file_path string, diff_text string")
    spans = spark.createDataFrame([("f", "function", "a", 2, 4), ("f", "class", "b", 90, 95)] * 500, "file_path string, kind string, name string, line_start int, line_end int")
    found = symbols.attribute(hunks, spans)
    assert sorted(map(tuple, found.collect())) == [(i, "function", "a", "exact_span") for i in range(40) if i % 5 + 1 <= 4 and i % 5 + 3 >= 2]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") >= 2


def test_only_the_terms_asked_for_are_made(spark, monkeypatch):
    """Of an index that isn't written, a query's postings and counts are those of all postings, without Python; all are grouped few at a time."""
    rows = [(1, "a b a", "b"), (2, "c", None), (3, None, "a_b the"), (4, "", "")] + [(i, "the b " * (i % 5), "x") for i in range(5, 30)]
    docs = spark.createDataFrame(rows, "id long, one string, two string").coalesce(1)
    index = fulltext.TextIndex.build(docs, "id", ["one", "two"])

    def told(df):
        return sorted((r.doc_id, r.term, list(r.positions), r.length) for r in df.collect())

    whole = told(index.postings)
    for terms in (["a"], ["b", "the"], ["nowhere"]):
        assert told(index.of(terms)) == [r for r in whole if r[1] in terms]
        assert index.in_docs(terms) == {t: sum(r[1] == t for r in whole) for t in terms}
    assert index.known() == tuple(fulltext.corpus_stats(docs, ["one", "two"]).first())
    assert sorted(map(tuple, index.terms.collect())) == sorted(map(tuple, fulltext.term_counts(index.postings).collect()))
    for df in (fulltext.search(index, "b NOT a_b"), index.terms):
        assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(fulltext, "AT_ONCE", 7)
    assert told(fulltext.build_postings(docs, "id", ["one", "two"])) == whole


def test_a_search_splits_texts_once(spark):
    """Counts, lengths, matches and what else is asked about the same terms come from one reading of the texts."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    docs = spark.range(40).select("id", read(F.when(F.col("id") % 3 == 0, "the end of the day").otherwise("of day")).alias("one")).coalesce(1)
    index = fulltext.TextIndex.build(docs, "id", ["one"])
    assert {r.doc_id for r in fulltext.search(index, "of_the").collect()} == set(range(0, 40, 3))
    assert index.of(["of", "the"]).count() == 40 + 14 and index.known() == (40, (14 * 5 + 26 * 2) / 40)
    assert seen.value == 40


def test_an_embedder_gets_few_texts_at_a_time(spark):
    def embedder(texts, dim):
        return [[float(len(texts))] + [0.0] * (dim - 1)] * len(texts)

    rows = spark.range(1000).select("id", F.lit("x").alias("text")).coalesce(1)
    sizes = [r.diff_emb[0] for r in chunking.embed(rows, dim=4, embedder=embedder).collect()]
    assert len(sizes) == 1000 and max(sizes) <= 256


def test_texts_reach_python_in_few_bytes(spark, tmp_path, monkeypatch):
    """Writing an index or a segment hands few bytes of tokens to Python at a time, whatever the rows allow; the session's limit stays, and many queries of an unwritten index take no Python."""
    key, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    largest = spark.sparkContext.accumulator(0)

    def seen(batches, cut=fulltext.few_tokens):
        for batch in batches:
            if batch.nbytes > 400_000:
                largest.add(1)
            yield from cut([batch])

    monkeypatch.setattr(fulltext, "few_tokens", seen)
    monkeypatch.setattr(segments, "few_tokens", seen)
    monkeypatch.setattr(session, "BATCH_BYTES", 100_000)
    docs = spark.range(400).select("id", F.expr("repeat('one two three ', 400)").alias("one")).coalesce(1)
    index = fulltext.TextIndex.build(docs, "id", ["one"])
    index.write(str(tmp_path / "t"))
    segments.add(spark, str(tmp_path / "s"), segments.empty(), docs, "id", ["one"])
    assert largest.value == 0 and spark.conf.get(key) == before
    asked = spark.createDataFrame([(1, "two one"), (2, "one nowhere")], "qid int, text string")
    found = fulltext.search_batch(index, asked, 3)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.qid, r.doc_id) for r in found.orderBy("rank").collect()] == [(1, 0), (1, 1), (1, 2)]
    written = fulltext.TextIndex.read(spark, str(tmp_path / "t"))
    written.blocks = None
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, fulltext.search_batch(written, asked, 3).collect()))


def test_tokens_are_compiled(spark):
    """Splitting a text takes no lambda, which Spark would interpret for each token."""
    found = spark.createDataFrame([(" a,,b ",), ("",), (None,), ("--",)], "t string").select(tokens(F.col("t")).alias("x"))
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.x for r in found.collect()] == [["a", "b"], [], [], []]
