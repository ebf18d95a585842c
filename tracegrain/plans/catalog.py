"""All queries of the lineage engine by name, with the SQL that gives the same rows.

A name starts with the ids of the operators that it shows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracegrain.functions import intent
from tracegrain.functions import text as T
from tracegrain.functions import vectors as V
from tracegrain.functions.session import scratch
from tracegrain.operators import cells, chunking, fulltext, history, ignore, knn, ownership, ranking, segments, symbols, tables, trigrams
from tracegrain.plans import explain, retrieve
from tracegrain.plans.index import DIM
from tracegrain.sources import adapters as A
from tracegrain.sources.parser import head_symbols

#: The time that queries take for now: 2024-02-15T00:00:00Z.
NOW = 1707955200
SINCE = 1704153600  # 2024-01-02
WORDS = "thnd erble"
PHRASE = "of_the"
NAME = "ring"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def r6(c: Column) -> Column:
    return F.round(c, 6)


def r9(c: Column) -> Column:
    return F.round(c, 9)


# The model's tables in SQL, as sources.adapters has them.
HUNKS = "(SELECT doc_id AS hunk_id, doc_id AS commit_id, text AS diff_text, lang AS language, source || '.rs' AS file_path FROM documents)"
COMMITS = "(SELECT event_id AS commit_id, CAST(event_id AS VARCHAR) AS commit_sha, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CAST(user_id AS VARCHAR) AS author, event_type AS change_kind, coalesce(props, '') AS message FROM events)"
CHAINED = f"(SELECT *, lag(commit_sha) OVER (PARTITION BY author ORDER BY ts, commit_id) AS parent_sha FROM {COMMITS})"
SYMBOLS = "(SELECT p_partkey AS symbol_id, p_type AS kind, p_name AS name, p_brand AS sibling_names, 'src' || CAST(p_partkey % 20 AS VARCHAR) || '.rs' AS file_path FROM part)"
HUNK_SYMBOLS = f"(SELECT l_orderkey AS hunk_id, name AS symbol_name, kind AS symbol_kind, CASE l_linenumber % 3 WHEN 1 THEN 'exact_span' WHEN 2 THEN 'hunk_header' ELSE 'file_fallback' END AS attribution_kind FROM lineitem JOIN {SYMBOLS} ON l_partkey = symbol_id)"
DIFFS = """(SELECT doc_id AS hunk_id, source || '.rs' AS file_path, lang AS language,
  '@@ -1,3 +' || CAST(doc_id % 50 + 1 AS VARCHAR) || ',' || CAST(len(ls) AS VARCHAR) || ' @@ fn name' || CAST(doc_id % 7 AS VARCHAR) || '()' || chr(10) || '+++ b/' || source || chr(10) ||
  array_to_string(list_transform(ls, lambda x, i: (['+', ' ', '-'])[(i - 1) % 3 + 1] || x), chr(10)) AS diff_text
  FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"""
BLAME = "(SELECT 'f' || CAST(conv_id AS VARCHAR) AS file, CAST(turn + 1 AS INTEGER) AS line, CAST((conv_id * 7 + turn) % 40 AS VARCHAR) AS commit_sha FROM conversations)"
PATHS = "(SELECT CAST(page_id AS VARCHAR) AS commit_sha, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS path FROM pages)"
RANK = "CASE attribution_kind WHEN 'exact_span' THEN 0 WHEN 'hunk_header' THEN 1 WHEN 'file_fallback' THEN 2 ELSE 3 END"
NL = "chr(10)"


def _tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(strip_accents(coalesce({c}, ''))), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda t: t <> '')"


def _lines(c: str) -> str:
    return f"(CASE WHEN {c} = '' THEN [] ELSE string_split(regexp_replace({c}, '\\n$', ''), chr(10)) END)"


def _added(c: str) -> str:
    return f"list_filter({_lines(c)}, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++'))"


# --- Scans, filters, projections ---------------------------------------------------------------


@query(f"SELECT commit_sha, author, ts FROM {COMMITS} WHERE ts >= {SINCE} ORDER BY ts DESC, commit_sha LIMIT 50")
def s1_commit_scan_recent(spark, d):
    return A.plain_commits(spark, d).where(F.col("ts") >= SINCE).orderBy(F.desc("ts"), "commit_sha").limit(50).select("commit_sha", "author", "ts")


@query(f"""WITH RECURSIVE c AS (SELECT * FROM {CHAINED}),
old AS (SELECT commit_sha, parent_sha FROM c WHERE commit_sha = '900' UNION ALL SELECT c.commit_sha, c.parent_sha FROM c JOIN old ON c.commit_sha = old.parent_sha)
SELECT commit_sha, parent_sha, ts FROM c WHERE author = (SELECT author FROM c WHERE commit_sha = '900') AND commit_sha NOT IN (SELECT commit_sha FROM old)""")
def s1_commit_scan_since_bookmark(spark, d):
    commits = A.commits(spark, d)
    own = commits.join(commits.where("commit_sha = '900'").select("author"), "author", "left_semi")
    return history.commit_scan(own, history.ancestors(own, "900")).select("commit_sha", "parent_sha", "ts")


#: An event has the one of its user before it as its parent; signups merge, and have that before them of either of two users too.  Clocks are up to 60 days late.
GRAPH = """(SELECT event_id AS c, unnest([lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), CASE WHEN event_type = 'signup' THEN lag(event_id) OVER (PARTITION BY user_id // 2 ORDER BY event_id) END]) AS p FROM events)"""


@query(f"""WITH RECURSIVE edges AS (SELECT DISTINCT c, p FROM {GRAPH} WHERE p IS NOT NULL),
ways AS (SELECT event_id AS c, 0::BIGINT AS n FROM events UNION SELECT e.c, w.n + 1 FROM ways w JOIN edges e ON e.p = w.c)
SELECT w.c::VARCHAR AS commit_sha, max(n) AS generation, any_value(CAST(floor(epoch(ts)) AS BIGINT) - w.c % 13 * 432000) AS ts FROM ways w JOIN events ON event_id = w.c GROUP BY w.c""")
def s1_s8_generations(spark, d):
    """Commits by how many must come before them, merges and late clocks among them."""
    events = A.read(spark, d, "events")
    own, either = (F.lag("event_id").over(Window.partitionBy(key).orderBy("event_id")) for key in ("user_id", F.floor(F.col("user_id") / 2)))
    edges = events.select("event_id", F.array(own, F.when(F.col("event_type") == "signup", either)).alias("ps")).select(F.col("event_id").cast("string").alias("commit_sha"), F.explode(F.col("ps").cast("array<string>")).alias("parent_sha"))
    commits = events.select(F.col("event_id").cast("string").alias("commit_sha"), (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.col("event_id") % 13 * 432000).alias("ts"))
    return history.commit_scan(commits, parents=edges).select("commit_sha", "generation", "ts")


@query("""WITH t AS (SELECT conv_id, turn, len(string_split(coalesce(text, ''), chr(10))) - CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 THEN 0 ELSE 1 END AS n FROM conversations)
SELECT 'f' || conv_id AS file, (sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC) - n + 1)::BIGINT AS first_line, n::BIGINT AS n_lines, conv_id || '-' || turn AS commit_sha FROM t QUALIFY n > 0""")
def s6_a6_ownership_from_diffs(spark, d):
    """A turn is a commit whose diff takes away the first line of its file and puts the lines of its text before the rest."""
    turns = A.read(spark, d, "conversations").withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    header = F.concat(F.when(F.col("place") == 1, "@@ -0,0 +1,").otherwise("@@ -1 +1,"), F.size(lines).cast("string"), F.lit(" @@\n"), F.when(F.col("place") == 1, "").otherwise("-?\n"))
    diff = F.concat(header, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("+"), x)), "\n"))
    hunks = turns.select(F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("file_path"), F.col("turn").alias("ord"), F.concat_ws("-", "conv_id", "turn").alias("commit_sha"), diff.alias("diff_text"))
    return ownership.runs(hunks).select("file", "first_line", "n_lines", "commit_sha")


@query(f"SELECT hunk_id, file_path, language, length(diff_text) AS n_chars FROM {HUNKS} WHERE language = 'de' AND diff_text IS NOT NULL")
def s2_f1_f2_diff_scan(spark, d):
    return A.hunks(spark, d).where("language = 'de' and diff_text is not null").select("hunk_id", "file_path", "language", F.length("diff_text").cast("long").alias("n_chars"))


@query(f"SELECT commit_sha, path FROM {PATHS}")
def s5_changed_paths(spark, d):
    return A.changed_paths(spark, d)


@query(f"SELECT commit_sha, count(*) AS n_lines, min(line) AS first_line, max(line) AS last_line, array_to_string(list(line ORDER BY line), ',') AS lines FROM {BLAME} WHERE file = 'f3' AND line BETWEEN 1 AND 8 GROUP BY commit_sha")
def s6_a6_blame_range(spark, d):
    owned = history.owned_lines(A.blame(spark, d), "f3", 1, 8)
    n = F.size("blame_lines").cast("long").alias("n_lines")
    return owned.select("commit_sha", n, F.array_min("blame_lines").alias("first_line"), F.array_max("blame_lines").alias("last_line"), F.array_join(F.col("blame_lines").cast("array<string>"), ",").alias("lines"))


@query(f"SELECT commit_sha, author FROM {CHAINED} WHERE parent_sha IS NULL")
def s7_root_commits(spark, d):
    return history.root_commits(A.commits(spark, d)).select("commit_sha", "author")


@query(f"SELECT commit_sha, ts FROM {CHAINED} c WHERE NOT EXISTS (SELECT 1 FROM {CHAINED} o WHERE o.parent_sha = c.commit_sha) ORDER BY ts DESC, commit_sha LIMIT 1")
def s7_head_commit(spark, d):
    return history.head_commit(A.commits(spark, d)).select("commit_sha", "ts")


@query(f"SELECT count(*) AS behind FROM {COMMITS} WHERE commit_id NOT IN (SELECT doc_id FROM documents)")
def s8_j8_commits_behind(spark, d):
    return tables.missing(A.plain_commits(spark, d), A.hunks(spark, d), ["commit_id"]).agg(F.count("*").alias("behind"))


@query(f"SELECT hunk_id, h.commit_id, ts, language FROM {HUNKS} h JOIN {COMMITS} c USING (commit_id) WHERE language = 'fr' AND ts >= {SINCE}")
def f2_f3_language_since(spark, d):
    facts = A.hunks(spark, d).select("hunk_id", "commit_id", "language").join(A.plain_commits(spark, d).select("commit_id", "ts"), "commit_id")
    return knn.filtered(facts, "fr", SINCE).select("hunk_id", "commit_id", "ts", "language")


@query(f"SELECT hunk_id, symbol_name, attribution_kind FROM {HUNK_SYMBOLS} WHERE lower(symbol_name) LIKE '%{NAME}%'")
def f5_symbol_like(spark, d):
    return A.hunk_symbols(spark, d).where(F.lower("symbol_name").like(f"%{NAME}%")).select("hunk_id", "symbol_name", "attribution_kind")


@query(f"SELECT hunk_id, language FROM {HUNKS} WHERE hunk_id IN (3, 5, 8, 13, 21, 34, 55, 89, 144)")
def f6_point_lookups(spark, d):
    return A.hunks(spark, d).where(F.col("hunk_id").isin(3, 5, 8, 13, 21, 34, 55, 89, 144)).select("hunk_id", "language")


@query(f"SELECT hunk_id FROM {HUNKS} WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = hunk_id)")
def f7_exists_anti(spark, d):
    seen = A.read(spark, d, "labels").select(F.col("doc_id").alias("hunk_id"))
    return tables.missing(A.hunks(spark, d), seen, ["hunk_id"]).select("hunk_id")


@query(f"SELECT commit_sha, message FROM {COMMITS} WHERE message <> ''")
def f8_non_empty(spark, d):
    return A.plain_commits(spark, d).where("message != ''").select("commit_sha", "message")


RULES = ignore.Layers(user=["!src1.rs", "*.log"], attributes=["src1*"], defaults=["src2*", "vendor/"])


@query(f"SELECT file_path, count(*) AS n, (CASE WHEN file_path = 'src1.rs' THEN false ELSE file_path LIKE 'src1%' OR file_path LIKE 'src2%' END) AS ignored FROM {HUNKS} GROUP BY file_path")
def f9_s10_a15_ignore_layers(spark, d):
    return A.hunks(spark, d).groupBy("file_path").agg(F.count("*").alias("n")).withColumn("ignored", RULES.is_ignored(F.col("file_path")))


@query(f"""SELECT commit_sha, count(*) AS paths, sum(CASE WHEN path LIKE '%.com/%' THEN 0 ELSE 1 END)::BIGINT AS kept FROM {PATHS} GROUP BY commit_sha HAVING kept = 0""")
def f10_emptied_commits(spark, d):
    layers = ignore.Layers(user=["*.com/"], defaults=[])
    hunks = A.changed_paths(spark, d).withColumnRenamed("path", "file_path")
    gone = ignore.kept_hunks(hunks, layers)[1]
    return hunks.join(gone, "commit_sha", "left_semi").groupBy("commit_sha").agg(F.count("*").alias("paths")).withColumn("kept", F.lit(0).cast("long"))


@query(f"SELECT hunk_id, strlen(diff_text) AS bytes FROM {HUNKS} WHERE strlen(diff_text) <= 2000")
def f11_source_size(spark, d):
    return A.hunks(spark, d).select("hunk_id", F.octet_length("diff_text").cast("long").alias("bytes")).where("bytes <= 2000")


# --- Full text ---------------------------------------------------------------------------------

TOKENS_CTE = f"""docs AS (SELECT hunk_id, {_tokens('diff_text')} AS ts FROM {HUNKS}),
toks AS (SELECT hunk_id, len(ts) AS dl, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM docs),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM docs)"""


def _bm25(terms: list[str], matched: str) -> str:
    score = " + ".join(f"CASE WHEN f{i} > 0 THEN greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END" for i in range(len(terms)))
    fs = ", ".join(f"count(*) FILTER (WHERE t = '{t}') AS f{i}" for i, t in enumerate(terms))
    ns = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i in range(len(terms)))
    return f"""WITH {TOKENS_CTE}, fs AS (SELECT hunk_id, dl, {fs} FROM toks GROUP BY ALL), ns AS (SELECT {ns} FROM fs)
SELECT hunk_id, round(-({score}), 6) AS score FROM fs, ns, stats WHERE {matched}"""


def _text_index(spark, d) -> fulltext.TextIndex:
    return fulltext.TextIndex.build(A.hunks(spark, d), "hunk_id", ["diff_text"])


def _search(spark, d, text: str) -> DataFrame:
    return fulltext.search(_text_index(spark, d), text).select(F.col("doc_id").alias("hunk_id"), r6(F.col("score")).alias("score"))


@query(_bm25(["thnd", "erble"], "f0 > 0 AND f1 > 0"))
def t2_t4_t5_f4_bm25_and(spark, d):
    return _search(spark, d, WORDS)


@query(_bm25(["thnd", "erble"], "f0 > 0 OR f1 > 0"))
def t2_bm25_or(spark, d):
    return _search(spark, d, "thnd OR erble")


@query(_bm25(["thnd", "erble"], "f0 > 0 AND NOT f1 > 0").replace(" + CASE WHEN f1 > 0", " + 0 * CASE WHEN f1 > 0"))
def t2_bm25_not(spark, d):
    return _search(spark, d, "thnd NOT erble")


#: query, terms, which of them are scored, and what FTS makes of it
PRECEDENCE = {
    "t2_bm25_not_before_and": ("the NOT thnd AND of", ["the", "thnd", "of"], (0, 2), "(f0 > 0 AND NOT f1 > 0) AND f2 > 0"),
    "t2_bm25_space_before_not": ("the NOT thnd of", ["the", "thnd", "of"], (0,), "f0 > 0 AND NOT (f1 > 0 AND f2 > 0)"),
    "t2_bm25_and_before_or": ("thnd OR der AND und", ["thnd", "der", "und"], (0, 1, 2), "f0 > 0 OR (f1 > 0 AND f2 > 0)"),
    "t2_bm25_chain": ("der und OR the NOT of NOT thnd AND erble", ["der", "und", "the", "of", "thnd", "erble"], (0, 1, 2, 5), "(f0 > 0 AND f1 > 0) OR (((f2 > 0 AND NOT f3 > 0) AND NOT f4 > 0) AND f5 > 0)"),
}


def _precedence(name: str, text: str, terms: list[str], scored: tuple[int, ...], matched: str) -> None:
    sql = _bm25(terms, matched)
    for i in set(range(len(terms))) - set(scored):
        sql = sql.replace(f"CASE WHEN f{i} > 0 THEN greatest", f"0 * CASE WHEN f{i} > 0 THEN greatest")

    def run(spark, d):
        return _search(spark, d, text)

    run.__name__ = name
    query(sql)(run)


for _name, _case in PRECEDENCE.items():
    _precedence(_name, *_case)


FOLDED = [("чай", "чай"), ("Việt", "việt"), ("ά", "ά"), ("ΣΙΣΥΦΟΣ", "σισυφοσ"), ("e\u0301te\u0301", "ete"), ("naïve Åse", "naive ase"), ("a_b", "a b"), ("x-1", "x 1"), ("Straße", "straße")]


@query("SELECT doc_id, coalesce(lang, '') || ' ' || w || ' ' || coalesce(source, '') AS said, trim(coalesce(lower(lang), '') || ' ' || t || ' ' || coalesce(lower(source), '')) AS tokens FROM documents JOIN (VALUES " + ", ".join(f"({i}, '{w}', '{t}')" for i, (w, t) in enumerate(FOLDED)) + f") AS v(i, w, t) ON doc_id % {len(FOLDED)} = i")
def t3_folding(spark, d):
    """Words that the full-text engine folds in its own way, between columns of every document."""
    word = F.element_at(F.array(*[F.lit(w) for w, _ in FOLDED]), (F.col("doc_id") % len(FOLDED) + 1).cast("int"))
    said = F.concat(F.coalesce("lang", F.lit("")), F.lit(" "), word, F.lit(" "), F.coalesce("source", F.lit("")))
    rows = A.read(spark, d, "documents").select("doc_id", said.alias("said"))
    return rows.withColumn("tokens", F.array_join(T.tokens(F.col("said")), " "))


@query(f"""WITH {TOKENS_CTE}, ph AS (SELECT a.hunk_id, a.dl, count(*) AS f FROM toks a JOIN toks b ON a.hunk_id = b.hunk_id AND b.pos = a.pos + 1 WHERE a.t = 'of' AND b.t = 'the' GROUP BY ALL)
SELECT hunk_id, f, round(-(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM ph, stats, (SELECT count(*) AS df FROM ph)""")
def t2_t3_bm25_phrase(spark, d):
    index = _text_index(spark, d)
    found = fulltext.search(index, PHRASE)
    pair = index.of(["of", "the"]).groupBy("doc_id").agg(F.first(F.when(F.col("term") == "of", F.col("positions")), ignorenulls=True).alias("a"), F.first(F.when(F.col("term") == "the", F.col("positions")), ignorenulls=True).alias("b"))
    counted = pair.select("doc_id", F.size(F.filter("a", lambda x: F.array_contains("b", x + 1))).cast("long").alias("f"))
    return found.join(counted, "doc_id").select(F.col("doc_id").alias("hunk_id"), "f", r9(F.col("score")).alias("score"))


@query(f"SELECT * FROM ({_bm25(['thnd', 'erble'], 'f0 > 0 AND f1 > 0')}) ORDER BY score, hunk_id LIMIT 20")
def t6_t10_r7_text_lane(spark, d):
    return _search(spark, d, WORDS).orderBy("score", "hunk_id").limit(20)


@query(f"""WITH docs AS (SELECT hunk_id, {_tokens("c.message || chr(10) || chr(10) || diff_text")} AS ts FROM {HUNKS} h JOIN {COMMITS} c USING (commit_id)),
toks AS (SELECT hunk_id, len(ts) AS dl, unnest(ts) AS t FROM docs), stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM docs),
fs AS (SELECT hunk_id, dl, count(*) AS f FROM toks WHERE t = 'thnd' GROUP BY ALL)
SELECT hunk_id, round(-(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM fs, stats, (SELECT count(*) AS df FROM fs) ORDER BY score, hunk_id LIMIT 20""")
def t7_x5_semantic_lane(spark, d):
    hunks, commits = A.hunks(spark, d).where("diff_text is not null"), A.plain_commits(spark, d).select("commit_id", "message")
    rows = hunks.join(commits, "commit_id").withColumn("sem", T.semantic_text(F.col("message"), F.col("diff_text")))
    text = fulltext.TextIndex.build(hunks, "hunk_id", ["diff_text"], ("commit_id",))
    found = fulltext.search(text.before(commits, "message", "commit_id", rows, "sem"), "thnd")
    return found.select(F.col("doc_id").alias("hunk_id"), r6(F.col("score")).alias("score")).orderBy("score", "hunk_id").limit(20)


@query(f"SELECT hunk_id, len({_tokens('diff_text')})::BIGINT AS n_tokens, md5(array_to_string({_tokens('diff_text')}, ' ')) AS tokens_md5 FROM {HUNKS}")
def t3_tokenizer(spark, d):
    found = T.tokens(F.col("diff_text"))
    return A.hunks(spark, d).select("hunk_id", F.size(found).cast("long").alias("n_tokens"), F.md5(F.array_join(found, " ").cast("binary")).alias("tokens_md5"))


@query(f"WITH {TOKENS_CTE} SELECT t AS term, count(DISTINCT hunk_id) AS df, count(*) AS cf FROM toks GROUP BY t")
def a14_term_statistics(spark, d):
    return _text_index(spark, d).terms


@query(f"WITH {TOKENS_CTE} SELECT n AS n_docs, round(avgdl, 6) AS avg_length FROM stats")
def a14_corpus_statistics(spark, d):
    return _text_index(spark, d).stats.select("n_docs", r6(F.col("avg_length")).alias("avg_length"))


BATCH = [(1, "thnd erble"), (2, "ofand"), (3, "the of"), (4, "und der"), (5, "de la")]
BATCH_SQL = ", ".join(f"({q}, '{w}')" for q, t in BATCH for w in t.split())


@query(f"""WITH {TOKENS_CTE}, q(qid, t) AS (VALUES {BATCH_SQL}), need AS (SELECT qid, count(*) AS need FROM q GROUP BY qid),
tf AS (SELECT hunk_id, dl, t, count(*) AS f FROM toks WHERE t IN (SELECT t FROM q) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
s AS (SELECT qid, hunk_id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score, count(*) AS got FROM tf JOIN q USING (t) JOIN df USING (t), stats GROUP BY qid, hunk_id)
SELECT qid, hunk_id, score FROM s JOIN need USING (qid) WHERE got = need QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score, hunk_id) <= 1000000""")
def t4_bm25_many_queries(spark, d):
    asked = spark.createDataFrame(BATCH, "qid int, text string")
    return fulltext.search_batch(_text_index(spark, d), asked, 1_000_000).select("qid", F.col("doc_id").alias("hunk_id"), r9(F.col("score")).alias("score"))


LIVING = f"(SELECT * FROM {HUNKS} WHERE language IS DISTINCT FROM 'es')"


@query(_bm25(["thnd", "erble"], "f0 > 0 OR f1 > 0").replace(HUNKS, LIVING))
def a14_t5_w4_segmented_search(spark, d):
    """All documents come in three batches, a language is deleted, two segments become one, and what lives is searched."""
    root, hunks = scratch(spark), A.hunks(spark, d)
    state = segments.empty()
    for batch in (F.col("language") == "en", F.col("language").isin("de", "fr"), F.coalesce(~F.col("language").isin("en", "de", "fr"), F.lit(True))):
        state = segments.add(spark, root, state, hunks.where(batch), "hunk_id", ["diff_text"])
    state = segments.delete(spark, root, state, hunks.where("language = 'es'").select(F.col("hunk_id").alias("doc_id")))
    state = segments.merge(spark, root, state, [s["id"] for s in state["segments"][1:]])
    found = fulltext.search(segments.view(spark, root, state), "thnd OR erble")
    return found.select(F.col("doc_id").alias("hunk_id"), r6(F.col("score")).alias("score"))


@query(f"""WITH {TOKENS_CTE}, q(qid, t) AS (VALUES {BATCH_SQL}), need AS (SELECT qid, count(*) AS need FROM q GROUP BY qid),
tf AS (SELECT hunk_id, dl, t, count(*) AS f FROM toks WHERE t IN (SELECT t FROM q) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
s AS (SELECT qid, hunk_id, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS raw, count(*) AS got FROM tf JOIN q USING (t) JOIN df USING (t), stats GROUP BY qid, hunk_id)
SELECT qid, hunk_id, round(raw, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY raw, hunk_id) AS rank FROM s JOIN need USING (qid) WHERE got = need QUALIFY rank <= 10""")
def t4_t10_topk_blocks(spark, d):
    """The best of each query, from the blocks that may hold them alone."""
    path = scratch(spark)
    _text_index(spark, d).write(path)
    found = fulltext.search_batch(fulltext.TextIndex.read(spark, path), spark.createDataFrame(BATCH, "qid int, text string"), 10)
    return found.select("qid", F.col("doc_id").alias("hunk_id"), r9(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


# --- Symbols -----------------------------------------------------------------------------------

HEAD_CTE = f"""sd AS (SELECT symbol_id, file_path, {_tokens('kind')} || {_tokens('name')} || {_tokens('sibling_names')} AS ts FROM {SYMBOLS}),
st AS (SELECT symbol_id, file_path, len(ts) AS dl, unnest(ts) AS t FROM sd), sn AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM sd),
sf AS (SELECT symbol_id, file_path, dl, count(*) AS f FROM st WHERE t = '{NAME}' GROUP BY ALL),
best AS (SELECT file_path, min(-(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)))) AS score FROM sf, sn, (SELECT count(*) AS df FROM sf) GROUP BY file_path)"""


def _head_index(spark, d) -> fulltext.TextIndex:
    return fulltext.TextIndex.build(A.symbols(spark, d), "symbol_id", ["kind", "name", "sibling_names"])


@query(f"WITH {HEAD_CTE} SELECT hunk_id, round(score, 9) AS score FROM {HUNKS} JOIN best USING (file_path) ORDER BY best.score, hunk_id LIMIT 50")
def t8_j2_j3_r8_head_symbol_lane(spark, d):
    found = symbols.head_symbol_hunks(_head_index(spark, d), A.symbols(spark, d), A.hunks(spark, d), NAME, 50)
    return found.select("hunk_id", r9(F.col("score")).alias("score"))


HIST = f"""(SELECT hunk_id, symbol_name, attribution_kind, ts, {RANK} AS rank FROM {HUNK_SYMBOLS} JOIN (SELECT hunk_id, ts FROM {HUNKS} JOIN {COMMITS} USING (commit_id)) USING (hunk_id)
WHERE lower(symbol_name) LIKE '%{NAME}%' ORDER BY rank, ts DESC, hunk_id, symbol_name LIMIT 60)"""


@query(f"SELECT hunk_id, min(ord)::INTEGER AS ord, CASE arg_min(rank, ord) WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS similarity FROM (SELECT *, row_number() OVER (ORDER BY rank, ts DESC, hunk_id, symbol_name) AS ord FROM {HIST}) GROUP BY hunk_id")
def t9_j4_r12_u3_historical_symbol_lane(spark, d):
    facts = A.hunks(spark, d).select("hunk_id", "commit_id").join(A.plain_commits(spark, d).select("commit_id", "ts"), "commit_id").select("hunk_id", "ts")
    return symbols.historical_symbol_hunks(A.hunk_symbols(spark, d), facts, NAME, 60)


@query(f"SELECT DISTINCT lower(name) AS name FROM {SYMBOLS} WHERE lower(name) LIKE '%{NAME}%'")
def f5_trigram_names(spark, d):
    """Names that hold a string, through their trigrams."""
    path = scratch(spark)
    trigrams.write(A.symbols(spark, d), path, "name")
    return trigrams.matching(spark.read.schema(trigrams.GRAMS).parquet(path), NAME)


@query(f"SELECT hunk_id, min(ord)::INTEGER AS ord, CASE arg_min(rank, ord) WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS similarity FROM (SELECT *, row_number() OVER (ORDER BY rank, ts DESC, hunk_id, symbol_name) AS ord FROM {HIST}) GROUP BY hunk_id")
def t9_f5_trigram_symbol_lane(spark, d):
    path = scratch(spark)
    trigrams.write(A.hunk_symbols(spark, d), path)
    facts = A.hunks(spark, d).select("hunk_id", "commit_id").join(A.plain_commits(spark, d).select("commit_id", "ts"), "commit_id").select("hunk_id", "ts")
    return symbols.historical_symbol_hunks(A.hunk_symbols(spark, d), facts, NAME, 60, spark.read.schema(trigrams.GRAMS).parquet(path))


@query(f"SELECT hunk_id, coalesce(array_to_string(names, ','), '') AS names FROM {HUNKS} LEFT JOIN (SELECT hunk_id, list(symbol_name ORDER BY {RANK}, symbol_name) AS names FROM {HUNK_SYMBOLS} GROUP BY hunk_id) USING (hunk_id)")
def j11_a13_symbols_by_hunk(spark, d):
    return symbols.symbols_by_hunk(A.hunks(spark, d).select("hunk_id"), A.hunk_symbols(spark, d)).select("hunk_id", F.array_join("related_head_symbols", ",").alias("names"))


@query(f"SELECT DISTINCT hunk_id, kind AS symbol_kind, name AS symbol_name, 'exact_span' AS attribution_kind FROM {HUNKS} JOIN {SYMBOLS} USING (file_path)")
def w6_live_attribution(spark, d):
    return symbols.live_attribution(A.hunks(spark, d), A.symbols(spark, d))


SPANS = f"(SELECT file_path, CASE symbol_id % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'method' END AS kind, 'name' || CAST(symbol_id % 9 AS VARCHAR) AS name, CAST(symbol_id % 60 + 1 AS INTEGER) AS line_start, CAST(symbol_id % 60 + 1 + symbol_id % 5 AS INTEGER) AS line_end FROM {SYMBOLS})"


@query(f"""WITH r AS (SELECT hunk_id, file_path, hunk_id % 50 + 1 AS s, hunk_id % 50 + len(string_split(coalesce(diff_text, ''), chr(10))) AS e FROM {HUNKS}),
x AS (SELECT hunk_id, kind, name, 'exact_span' AS a FROM r JOIN {SPANS} USING (file_path) WHERE line_start <= e AND s <= line_end
UNION ALL SELECT hunk_id, 'function', 'name' || CAST(hunk_id % 7 AS VARCHAR), 'hunk_header' FROM r)
SELECT hunk_id, kind AS symbol_kind, name AS symbol_name, min(a) AS attribution_kind FROM x GROUP BY ALL""")
def x10_f12_j14_attribution(spark, d):
    p = F.col("symbol_id")
    kind = F.when(p % 3 == 0, "function").when(p % 3 == 1, "class").otherwise("method")
    spans = A.symbols(spark, d).select("file_path", kind.alias("kind"), F.concat(F.lit("name"), (p % 9).cast("string")).alias("name"), (p % 60 + 1).cast("int").alias("line_start"), (p % 60 + 1 + p % 5).cast("int").alias("line_end"))
    return symbols.attribute(A.diffs(spark, d), spans)


@query("""SELECT file_path, span_start, span_end, kind, name FROM (SELECT 'f' || CAST(p_partkey % 10 AS VARCHAR) AS file_path, p_size AS span_start, p_size + 10 AS span_end,
CASE p_partkey % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'method' END AS kind, p_name AS name, CASE WHEN p_partkey % 10 < 3 THEN 'rust' ELSE 'python' END AS language FROM part)
QUALIFY language = 'rust' OR row_number() OVER (PARTITION BY file_path, span_start, span_end ORDER BY CASE kind WHEN 'method' THEN 0 WHEN 'class' THEN 1 WHEN 'function' THEN 2 ELSE 3 END, name) = 1""")
def u5_span_dedup(spark, d):
    p = F.col("p_partkey")
    kind = F.when(p % 3 == 0, "function").when(p % 3 == 1, "class").otherwise("method")
    rows = A.read(spark, d, "part").select(F.concat(F.lit("f"), (p % 10).cast("string")).alias("file_path"), F.col("p_size").alias("span_start"), (F.col("p_size") + 10).alias("span_end"), kind.alias("kind"), F.col("p_name").alias("name"), F.when(p % 10 < 3, "rust").otherwise("python").alias("language"))
    return symbols.dedup_spans(rows).drop("language")


@query("""SELECT 'src/' || p_partkey || '.rs' AS file_path, unnest(['function', 'class']) AS kind, unnest([replace(p_name, ' ', '_'), 'S' || p_partkey]) AS name, unnest([1, 4])::INTEGER AS line_start, unnest([3, 4])::INTEGER AS line_end FROM part""")
def s4_e3_x12_head_symbols(spark, d):
    source = F.concat(F.lit("fn "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("() {\n  x();\n}\nstruct S"), F.col("p_partkey").cast("string"), F.lit(";\n"))
    files = A.read(spark, d, "part").select(F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit(".rs")).alias("file_path"), source.alias("source"))
    return head_symbols(files).select("file_path", "kind", "name", "line_start", "line_end")


@query("SELECT DISTINCT sha256(text) AS blob_sha, 'm' AS embed_model FROM documents WHERE text IS NOT NULL")
def w11_record_blobs(spark, d):
    rows = A.read(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("blob_sha"), F.lit("m").alias("embed_model"))
    return tables.insert_or_ignore(rows.where("1 = 0"), rows, ["blob_sha", "embed_model"])


# --- Vectors -----------------------------------------------------------------------------------


@lru_cache(maxsize=None)
def _vector(spark, d, vec_id: int) -> tuple[float, ...]:
    row = A.read(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return tuple(row.embedding) if row else ()


V_OF = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {})"
NEAR = f"(SELECT vec_id AS hunk_id, list_distance(embedding::DOUBLE[], {V_OF.format(7)}) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 50)"


@query(f"SELECT hunk_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity FROM {NEAR}")
def v1_x18_j15_knn_l2(spark, d):
    near = knn.nearest(A.vectors(spark, d), list(_vector(spark, d, 7)), 50)
    return near.select("hunk_id", r6(F.col("distance")).alias("distance"), r6(F.col("similarity")).alias("similarity"))


@query(f"SELECT hunk_id, round(distance, 6) AS distance, language FROM {NEAR} JOIN {HUNKS} USING (hunk_id) JOIN {COMMITS} USING (commit_id) WHERE language = 'en' AND ts >= {SINCE}")
def v1_knn_post_filter(spark, d):
    near = knn.nearest(A.vectors(spark, d), list(_vector(spark, d, 7)), 50)
    facts = A.hunks(spark, d).select("hunk_id", "commit_id", "language").join(A.plain_commits(spark, d).select("commit_id", "ts"), "commit_id")
    return knn.filtered(near.join(facts, "hunk_id"), "en", SINCE).select("hunk_id", r6(F.col("distance")).alias("distance"), "language")


@query(f"""SELECT q.vec_id AS qid, e.vec_id AS hunk_id, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings e, embeddings q WHERE q.vec_id IN (1, 2, 3, 5, 8)
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id) <= 10""")
def v1_knn_many_queries(spark, d):
    asked = A.vectors(spark, d).where(F.col("hunk_id").isin(1, 2, 3, 5, 8)).select(F.col("hunk_id").alias("qid"), F.col("vector").alias("query"))
    return knn.nearest_batch(A.vectors(spark, d), asked, 10).select(F.col("qid").cast("long").alias("qid"), "hunk_id", r6(F.col("distance")).alias("distance"))


EVERY_100TH = "SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0"


@query(f"""SELECT q.vec_id AS qid, e.vec_id AS hunk_id, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id) AS rank
FROM embeddings e, ({EVERY_100TH}) q QUALIFY rank <= 10""")
def v1_v8_j15_cells_many_queries(spark, d):
    """Every vector is dealt to cells; asked are those whose id is divisible by 100."""
    root = scratch(spark)
    held = cells.view(spark, root, cells.build(spark, root, A.vectors(spark, d)))
    asked = A.vectors(spark, d).where("hunk_id % 100 = 0").select(F.col("hunk_id").alias("qid"), F.col("vector").alias("query"))
    return cells.nearest_batch(held, asked, 10).select("qid", "hunk_id", r6(F.col("distance")).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT hunk_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity FROM {NEAR}")
def v8_cells_knn(spark, d):
    root = scratch(spark)
    held = cells.view(spark, root, cells.build(spark, root, A.vectors(spark, d)))
    near = cells.nearest(held, list(_vector(spark, d, 7)), 50)
    return near.select("hunk_id", r6(F.col("distance")).alias("distance"), r6(F.col("similarity")).alias("similarity"))


@query("SELECT h AS content_hash, count(*) AS n FROM (SELECT sha256(text) AS h FROM documents) GROUP BY h HAVING n > 1")
def x15_content_hash_groups(spark, d):
    return A.hunks(spark, d).groupBy(T.content_hash(F.col("diff_text")).alias("content_hash")).agg(F.count("*").alias("n")).where("n > 1")


CACHE_SQL = "(SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE doc_id % 3 = 0)"


@query(f"SELECT doc_id AS hunk_id, sha256(text) AS content_hash, sha256(text) IN (SELECT content_hash FROM {CACHE_SQL}) AS hit FROM documents WHERE text IS NOT NULL")
def j10_v4_cache_lookup(spark, d):
    docs = A.read(spark, d, "documents").where("text is not null")
    cache = docs.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("content_hash"), F.lit("m").alias("embed_model"), F.array(F.lit(1.0).cast("float")).alias("diff_emb")).dropDuplicates(["content_hash"])
    met, _ = tables.cache_lookup(docs.select(F.col("doc_id").alias("hunk_id"), "text"), cache, "m")
    return met.select("hunk_id", "content_hash", F.col("diff_emb").isNotNull().alias("hit"))


@query(f"SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT content_hash FROM {CACHE_SQL})")
def j10_cache_misses_once(spark, d):
    docs = A.read(spark, d, "documents").where("text is not null")
    cache = docs.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("content_hash"), F.lit("m").alias("embed_model"), F.array(F.lit(1.0).cast("float")).alias("diff_emb")).dropDuplicates(["content_hash"])
    return tables.cache_lookup(docs.select("text"), cache, "m")[1].select("content_hash")


@query("SELECT count(*) AS rows, coalesce(sum(len(embedding) * 4), 0)::BIGINT AS bytes FROM embeddings")
def a2_cache_stats(spark, d):
    return tables.cache_stats(A.read(spark, d, "embeddings").withColumnRenamed("embedding", "diff_emb"))


@query("SELECT event_type AS method, count(*) AS calls, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS elapsed_us, CAST(sum(user_id) AS BIGINT) AS rows FROM events GROUP BY event_type")
def a16_a17_method_metrics(spark, d):
    events = A.read(spark, d, "events")
    return tables.method_metrics(events.select(F.col("event_type").alias("method"), F.lit(1).cast("long").alias("calls"), F.floor(F.col("value") * 1000).alias("elapsed_us"), F.col("user_id").alias("rows")))


@query("SELECT count(*) > 0 AS seen FROM documents WHERE sha256(text) = (SELECT sha256(text) FROM documents WHERE doc_id = 5)")
def a3_blob_seen(spark, d):
    docs = A.read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.where(F.col("h") == docs.where("doc_id = 5").select("h").scalar()).agg((F.count("*") > 0).alias("seen"))


@query()
def v2_v3_e1_embed_texts(spark, d):
    rows = chunking.embed(A.hunks(spark, d).select("hunk_id", "diff_text"), "diff_text", DIM)
    return rows.select("hunk_id", F.size("diff_emb").alias("dim"), F.round(V.dot(F.col("diff_emb"), F.col("diff_emb")), 3).alias("norm"))


# --- Ranking -----------------------------------------------------------------------------------

LANE_A = f"(SELECT 0 AS lane, row_number() OVER (ORDER BY distance, hunk_id) AS rank, hunk_id, 1 / (1 + distance) AS similarity FROM {NEAR})"
LANE_B = f"(SELECT 1 AS lane, row_number() OVER (ORDER BY score, hunk_id) AS rank, hunk_id, 1 / (1 - score) AS similarity FROM ({_bm25(['the'], 'f0 > 0')}) ORDER BY score, hunk_id LIMIT 50)"
FUSED = f"(SELECT hunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, arg_min(similarity, lane * 1000 + rank) AS similarity, min(lane * 1000 + rank) AS first FROM (SELECT * FROM {LANE_A} UNION ALL SELECT * FROM {LANE_B}) GROUP BY hunk_id)"


def _two_lanes(spark, d) -> DataFrame:
    near = knn.nearest(A.vectors(spark, d), list(_vector(spark, d, 7)), 50)
    a = ranking.lane(near, 0, [F.col("distance"), F.col("hunk_id")], F.col("similarity"))
    hits = _search(spark, d, "the").orderBy("score", "hunk_id").limit(50)
    return a.unionByName(ranking.lane(hits, 1, [F.col("score"), F.col("hunk_id")], V.bm25_similarity(F.col("score"))))


@query(f"SELECT hunk_id, round(rrf, 9) AS rrf, round(similarity, 6) AS similarity, first AS first FROM {FUSED}")
def r1_a4_a5_j12_u1_rrf(spark, d):
    return ranking.fuse(_two_lanes(spark, d)).select("hunk_id", r9(F.col("rrf")).alias("rrf"), r6(F.col("similarity")).alias("similarity"), (F.col("first.lane") * 1000 + F.col("first.rank")).cast("long").alias("first"))


@query(f"SELECT hunk_id, row_number() OVER (ORDER BY rrf DESC, first, hunk_id)::INTEGER AS pool_rank FROM {FUSED} ORDER BY rrf DESC, first, hunk_id LIMIT 20")
def r2_r9_pool(spark, d):
    return ranking.pool(ranking.fuse(_two_lanes(spark, d)), 20).select("hunk_id", "pool_rank")


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END, 9) AS score FROM (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 3 AS x FROM lineitem)")
def r3_x19_sigmoid(spark, d):
    return A.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r9(ranking.sigmoid((F.col("l_quantity") - 25) / 3)).alias("score"))


@query(f"SELECT commit_sha, round(0.5 * (1 + 0.05 * exp(-(greatest({NOW} - ts, 0) / 86400.0::DOUBLE) / 90.0::DOUBLE)), 9) AS combined_score FROM {COMMITS}")
def r4_recency(spark, d):
    rows = A.plain_commits(spark, d).withColumn("similarity", F.lit(0.5))
    return ranking.weigh_by_age(rows, NOW, 0.05, 90.0).select("commit_sha", r9(F.col("combined_score")).alias("combined_score"))


@query(f"SELECT commit_sha, strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS commit_date FROM {COMMITS} ORDER BY commit_date DESC, commit_sha LIMIT 5")
def r10_x32_newest_commits(spark, d):
    return A.plain_commits(spark, d).select("commit_sha", T.rfc3339(F.col("ts")).alias("commit_date")).orderBy(F.desc("commit_date"), "commit_sha").limit(5)


@query(f"SELECT max(commit_sha) AS commit_sha, max(ts) AS ts FROM (SELECT commit_sha, ts, sha1(commit_sha) AS h FROM {COMMITS} ORDER BY ts DESC, substr(sha1(commit_sha), 1, 20) DESC LIMIT 1)")
def r11_x17_latest_by_ulid(spark, d):
    rows = A.plain_commits(spark, d).withColumn("ulid", T.ulid(F.col("ts"), F.sha1("commit_sha")))
    return rows.orderBy(F.desc("ulid")).limit(1).select("commit_sha", "ts")


@query("""WITH r AS (SELECT doc_id, CASE WHEN quality = 1 THEN doc_id % 7 + 1 END AS rank, doc_id % 97 AS ms FROM labels), s AS (SELECT list(ms ORDER BY ms) AS m, count(*) AS n FROM r)
SELECT count(*) AS cases, round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_1, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_5,
round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, round(avg(coalesce(1.0::DOUBLE / log2(rank + 1), 0)), 6) AS ndcg_lite,
any_value(m[greatest(ceil(n * 0.5::DOUBLE), 1)::INTEGER]) AS p50_ms, any_value(m[greatest(ceil(n * 0.95::DOUBLE), 1)::INTEGER]) AS p95_ms FROM r, s""")
def a12_s11_eval_metrics(spark, d):
    ranks = A.read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, F.col("doc_id") % 7 + 1).alias("rank"), (F.col("doc_id") % 97).alias("ms"))
    q = ranking.quality(ranks)
    return q.select("cases", *[r6(F.col(c)).alias(c) for c in ("recall_at_1", "recall_at_5", "mrr", "ndcg_lite")], "p50_ms", "p95_ms")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1")
def u3_first_of_each(spark, d):
    return ranking.first_of_each(A.read(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")]).select("source", "doc_id")


# --- History -----------------------------------------------------------------------------------

CHANGES = "(SELECT CAST(user_id AS VARCHAR) AS file_path, CAST(event_id AS VARCHAR) AS commit_sha, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events)"
#: What an answer is about: changes of one kind, a kind that a fifth of them are.
ANCHORS = f"(SELECT * FROM {CHANGES} WHERE commit_sha IN (SELECT CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'error'))"


def _neighbours_sql(anchors: str) -> str:
    return f"""(SELECT a.commit_sha AS anchor_sha, a.file_path, c.commit_sha, c.ts, CASE WHEN c.ts <= a.ts THEN 0 ELSE 1 END AS side,
row_number() OVER (PARTITION BY a.commit_sha, a.file_path, CASE WHEN c.ts <= a.ts THEN 0 ELSE 1 END ORDER BY abs(c.ts - a.ts), c.commit_sha) AS place
FROM {anchors} a JOIN {CHANGES} c ON a.file_path = c.file_path AND a.commit_sha <> c.commit_sha QUALIFY place <= 2)"""


def _changes(spark, d) -> DataFrame:
    return A.plain_commits(spark, d).select(F.col("author").alias("file_path"), "commit_sha", "ts")


def _anchors(spark, d) -> DataFrame:
    return A.plain_commits(spark, d).where("change_kind = 'error'").select(F.col("author").alias("file_path"), "commit_sha", "ts")


@query(f"SELECT anchor_sha, file_path, commit_sha, ts, side, place::INTEGER AS place, 1::BIGINT AS touched_hunks FROM {_neighbours_sql(CHANGES)}")
def j13_j6_a1_u2_neighbours(spark, d):
    """The neighbours of every change."""
    return history.neighbours(_changes(spark, d), _changes(spark, d), 2, 2)


@query(f"SELECT commit_sha, anchor_sha FROM {_neighbours_sql(ANCHORS)} WHERE commit_sha NOT IN (SELECT commit_sha FROM {ANCHORS}) QUALIFY row_number() OVER (PARTITION BY commit_sha ORDER BY anchor_sha, side, place) = 1")
def f14_u3_related_commits(spark, d):
    """What happened around the changes of kind error, without these themselves."""
    return explain.related(_changes(spark, d), _anchors(spark, d)).select("commit_sha", "anchor_sha")


@query(f"""WITH b AS (SELECT commit_sha, list(line ORDER BY line) AS ls FROM {BLAME} WHERE file = 'f3' AND line BETWEEN 1 AND 8 GROUP BY commit_sha)
SELECT b.commit_sha, strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS commit_date, array_to_string(ls, ',') AS lines, 'EXACT' AS provenance FROM b JOIN {COMMITS} USING (commit_sha) ORDER BY commit_date DESC, commit_sha LIMIT 5""")
def explain_change_flagship(spark, d):
    hunks = A.hunks(spark, d).select(F.col("commit_id").cast("string").alias("commit_sha"), "file_path", "diff_text")
    found = explain.explain_change(A.blame(spark, d), A.plain_commits(spark, d), hunks, "f3", 1, 8)
    return found.select("commit_sha", "commit_date", F.array_join(F.col("blame_lines").cast("array<string>"), ",").alias("lines"), "provenance")


@query(f"""WITH b AS (SELECT * FROM {BLAME} WHERE file = 'f3' AND line BETWEEN 1 AND 8), k AS (SELECT *, commit_sha IN (SELECT commit_sha FROM {COMMITS} WHERE commit_id % 2 = 0) AS known FROM b), s AS (SELECT list(DISTINCT commit_sha ORDER BY commit_sha) AS sk FROM k WHERE NOT known)
SELECT 'f3' AS file, min(line) AS first_line, max(line) AS last_line, count(*) AS lines, count(*) FILTER (WHERE known) AS indexed_lines, count(*) FILTER (WHERE known) / count(*)::DOUBLE AS blame_coverage,
CASE WHEN any_value(len(sk)) > 0 THEN any_value(len(sk)) || '{history.SKIPPED}' || any_value(array_to_string(sk[1:3], ', ')) || ']' || CASE WHEN any_value(len(sk)) > 3 THEN ' (+' || (any_value(len(sk)) - 3) || ' more)' ELSE '' END || '; range covered: ' || min(line) || '..=' || max(line) END AS limitation FROM k, s""")
def a7_j9_x30_explain_meta(spark, d):
    return explain.explain_meta(A.blame(spark, d), A.plain_commits(spark, d).where("commit_id % 2 = 0"), "f3", 1, 8)


PREFIXES = f"""(SELECT commit_sha, array_to_string(parts[1:i], '/') || CASE WHEN i < len(parts) THEN '/' ELSE '' END AS prefix FROM (SELECT commit_sha, string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM {PATHS}))"""
SHARES = f"(SELECT prefix, count(DISTINCT commit_sha) AS commits FROM {PREFIXES} GROUP BY prefix)"


@query(f"SELECT prefix, commits FROM {SHARES}")
def a8_x26_path_shares(spark, d):
    return history.path_shares(A.changed_paths(spark, d))


@query(f"SELECT prefix, commits FROM {SHARES} WHERE regexp_matches(prefix, '^[^/]*/$') AND prefix NOT IN ('Documentation/', 'docs/', 'doc/') AND commits / (SELECT count(*) FROM pages)::DOUBLE >= 0.05")
def a9_suggested_rules(spark, d):
    paths = A.changed_paths(spark, d)
    return history.suggested(history.path_shares(paths), paths.select("commit_sha").distinct().count())


@query(f"SELECT prefix, commits, CASE WHEN p < 1 THEN '<1%' ELSE CAST(CAST(round_even(p, 0) AS BIGINT) AS VARCHAR) || '%' END AS share FROM (SELECT *, commits / (SELECT count(*) FROM pages)::DOUBLE * 100 AS p FROM {SHARES} WHERE regexp_matches(prefix, '^[^/]*/$') ORDER BY commits DESC, prefix LIMIT 20)")
def r13_x27_plan_hotmap(spark, d):
    paths = A.changed_paths(spark, d)
    return history.top_directories(history.path_shares(paths), paths.select("commit_sha").distinct().count())


@query(f"SELECT file_path, sum(strlen(diff_text))::BIGINT AS diff_bytes, sum(len({_added('diff_text')}))::BIGINT AS added_lines FROM {DIFFS} GROUP BY file_path")
def a10_a11_diff_totals(spark, d):
    return tables.total_bytes(A.diffs(spark, d), ["file_path"])


# --- Scalar functions --------------------------------------------------------------------------


@query(f"""SELECT hunk_id, n > 5 AS truncated, CASE WHEN n > 5 THEN array_to_string(ls[1:5], {NL}) || {NL} || '... (' || (n - 5) || ' more lines)' || {NL} ELSE diff_text END AS excerpt, n::INTEGER AS n_lines
FROM (SELECT *, len(ls) AS n FROM (SELECT hunk_id, diff_text, {_lines('diff_text')} AS ls FROM {DIFFS}))""")
def x1_x2_truncate_diff(spark, d):
    excerpt, truncated = T.truncate_diff(F.col("diff_text"), 5)
    return A.diffs(spark, d).select("hunk_id", truncated.alias("truncated"), excerpt.alias("excerpt"), T.count_lines(F.col("diff_text")).alias("n_lines"))


@query(f"SELECT hunk_id, coalesce(array_to_string(list_transform({_added('diff_text')}, lambda x: substr(x, 2)), {NL}), '') AS added, len({_added('diff_text')})::INTEGER AS n FROM {DIFFS}")
def x3_added_lines(spark, d):
    return A.diffs(spark, d).select("hunk_id", T.added_lines(F.col("diff_text")).alias("added"), T.added_line_count(F.col("diff_text")).alias("n"))


@query(f"""SELECT hunk_id, 'commit: fix ' || hunk_id || {NL} || 'file: ' || file_path || {NL} || 'language: ' || language || {NL} || 'symbols: a, b' || {NL} || 'change: modified' || CASE WHEN added <> '' THEN {NL} || 'added_lines:' || {NL} || added ELSE '' END AS sem
FROM (SELECT *, coalesce(array_to_string(list_transform({_added('diff_text')}, lambda x: substr(x, 2)), {NL}), '') AS added FROM {DIFFS})""")
def x4_sectioned_text(spark, d):
    message = F.concat(F.lit("fix "), F.col("hunk_id").cast("string"), F.lit("\nmore"))
    return A.diffs(spark, d).select("hunk_id", T.sectioned_text(message, F.col("file_path"), F.col("language"), F.array(F.lit("a"), F.lit("b")), F.lit("modified"), F.col("diff_text")).alias("sem"))


@query(f"SELECT hunk_id, (hunk_id % 50 + 1)::INTEGER AS start, len(string_split(coalesce(diff_text, ''), {NL}))::INTEGER AS count, 'fn name' || hunk_id % 7 || '()' AS suffix, 'name' || hunk_id % 7 AS name, 'function' AS kind FROM {HUNKS}")
def x6_x7_x8_diff_headers(spark, d):
    c = F.col("diff_text")
    rows = A.diffs(spark, d).select("hunk_id", F.element_at(T.post_image_ranges(c), 1).alias("r"), F.element_at(T.header_suffixes(c), 1).alias("suffix"))
    rows = rows.withColumn("s", T.header_symbol(F.col("suffix")))
    return rows.select("hunk_id", "r.start", "r.count", "suffix", "s.name", "s.kind")


@query("""SELECT doc_id, (length(regexp_replace(substr(t, 1, a), '[^\\n]', '', 'g')) + 1)::INTEGER AS first_line, (length(regexp_replace(substr(t, 1, b), '[^\\n]', '', 'g')) + 1)::INTEGER AS last_line
FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS t, length(text) // 3 AS a, greatest(2 * length(text) // 3 - 1, 0) AS b FROM documents WHERE n_chars > 0)""")
def x9_line_spans(spark, d):
    """The lines of the middle third of every text."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "?")
    n = F.octet_length("t")
    first, last = T.line_span(F.col("t"), F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int"))
    return A.read(spark, d, "documents").where("n_chars > 0").select("doc_id", plain.alias("t")).select("doc_id", first.alias("first_line"), last.alias("last_line"))


EXTENSIONS = "['rs', 'py', 'ts', 'tsx', 'js', 'mjs', 'go', 'java', 'kt', 'txt']"


@query(f"""SELECT doc_id, path, CASE WHEN e = 'rs' THEN 'rust' WHEN e = 'py' THEN 'python' WHEN e IN ('ts', 'tsx') THEN 'typescript' WHEN e IN ('js', 'mjs') THEN 'javascript' WHEN e = 'go' THEN 'go' END AS language,
CASE WHEN e = 'rs' THEN 'rust' WHEN e = 'py' THEN 'python' WHEN e IN ('ts', 'tsx') THEN 'typescript' WHEN e IN ('js', 'mjs') THEN 'javascript' WHEN e = 'java' THEN 'java' WHEN e = 'kt' THEN 'kotlin' END AS parser
FROM (SELECT doc_id, e, 'a/' || source || '.' || e AS path FROM (SELECT doc_id, source, ({EXTENSIONS})[doc_id % 10 + 1] AS e FROM documents))""")
def x11_x12_languages(spark, d):
    e = F.element_at(F.array(*[F.lit(x) for x in ("rs", "py", "ts", "tsx", "js", "mjs", "go", "java", "kt", "txt")]), (F.col("doc_id") % 10 + 1).cast("int"))
    rows = A.read(spark, d, "documents").select("doc_id", F.concat(F.lit("a/"), F.col("source"), F.lit("."), e).alias("path"))
    return rows.select("doc_id", "path", T.detect_language(F.col("path")).alias("language"), T.parser_language(F.col("path")).alias("parser"))


@query("SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def x13_estimate_tokens(spark, d):
    return A.read(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("""WITH RECURSIVE s AS (SELECT 'f' || p_partkey % 20 AS file_path, p_type AS kind, p_name AS name, CAST(p_partkey AS INTEGER) AS span_start, CAST(p_partkey + 10 AS INTEGER) AS span_end, p_size * 20 // 4 AS t,
    row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY p_partkey, p_name) AS n FROM part),
  w AS (SELECT file_path, n, t AS tokens, 1 AS chunk FROM s WHERE n = 1 UNION ALL
    SELECT s.file_path, s.n, CASE WHEN w.tokens + s.t <= 500 THEN w.tokens + s.t ELSE s.t END, CASE WHEN w.tokens + s.t <= 500 THEN w.chunk ELSE w.chunk + 1 END FROM w JOIN s ON s.file_path = w.file_path AND s.n = w.n + 1)
SELECT file_path, arg_min(kind, n) AS kind, arg_min(name, n) AS name, array_to_string(list(name ORDER BY n)[2:], '|') AS sibling_names, min(span_start) AS span_start, arg_max(span_end, n) AS span_end, CAST(max(tokens) AS INTEGER) AS tokens
FROM s JOIN w USING (file_path, n) GROUP BY file_path, chunk""")
def x14_chunk_symbols(spark, d):
    rows = A.read(spark, d, "part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 20).cast("string")).alias("file_path"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.col("p_partkey").cast("int").alias("span_start"), (F.col("p_partkey") + 10).cast("int").alias("span_end"), (F.col("p_size") * 20).alias("n_chars"))
    return chunking.chunk_symbols(rows).withColumn("sibling_names", F.array_join("sibling_names", "|"))


@query("SELECT doc_id, substr(sha256(encode(CAST(doc_id AS VARCHAR)) || '\\x00'::BLOB || encode(source)), 1, 32) AS repo_id FROM documents")
def x16_repo_id(spark, d):
    return A.read(spark, d, "documents").select("doc_id", T.repo_id(F.col("doc_id").cast("string"), F.col("source")).alias("repo_id"))


CROCK = f"'{T.CROCKFORD}'"


@query("WITH c AS (SELECT commit_sha, ts * 1000 AS ms, substr(sha1(commit_sha), 1, 20) AS h FROM " + COMMITS + ") SELECT commit_sha, "
       + " || ".join(f"substr({CROCK}, ((ms >> {5 * i}) & 31)::INTEGER + 1, 1)" for i in range(9, -1, -1)) + " || "
       + " || ".join(f"substr({CROCK}, ((('0x' || substr(h, {1 + 10 * g}, 10))::BIGINT >> {5 * i}) & 31)::INTEGER + 1, 1)" for g in (0, 1) for i in range(7, -1, -1)) + " AS ulid FROM c")
def x17_ulid(spark, d):
    return A.plain_commits(spark, d).select("commit_sha", T.ulid(F.col("ts"), F.sha1("commit_sha")).alias("ulid"))


ASKED = ["how did we fix the crash", "where do we configure the url", "load configuration", "callers of open", "how was retry done before", "retry with backoff", "an error we fixed", "pattern for retries"]
ASKED_SQL = "[" + ", ".join(f"'{x}'" for x in ASKED) + "]"


@query(f"""SELECT doc_id, q, CASE WHEN q LIKE '%where do we configure%' OR q LIKE '%load configuration%' OR q LIKE '%config%' THEN 'configuration'
WHEN q LIKE '%how did we fix%' OR ((q LIKE '% error%' OR q LIKE '% crash%') AND (q LIKE '% fix%' OR q LIKE '%fixed%')) THEN 'bug_fix_precedent' WHEN q LIKE '%callers of%' THEN 'api_usage'
WHEN q LIKE '%how did we%' OR q LIKE '%pattern for%' OR (q LIKE '%how was%' AND q LIKE '%done before%') THEN 'implementation_pattern' ELSE 'unknown' END AS intent FROM (SELECT doc_id, lower(coalesce(text, '') || ' ' || ({ASKED_SQL})[doc_id % 8 + 1]) AS q FROM documents)""".replace("SELECT doc_id, q, CASE", "SELECT doc_id, md5(q) AS asked_md5, CASE"))
def x24_classify_intents(spark, d):
    """Every text with a question after it is a query."""
    asked = F.element_at(F.array(*[F.lit(x) for x in ASKED]), (F.col("doc_id") % 8 + 1).cast("int"))
    q = F.lower(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), asked))
    return A.read(spark, d, "documents").select("doc_id", q.alias("q")).select("doc_id", F.md5(F.col("q").cast("binary")).alias("asked_md5"), intent.intent_column(F.col("q")).alias("intent"))


# --- Writes ------------------------------------------------------------------------------------

OLD = "(SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 3 <> 0)"
NEW = "(SELECT doc_id, upper(lang) AS lang, n_chars + 1 AS n_chars FROM documents WHERE doc_id % 2 = 0)"


def _old_new(spark, d):
    docs = A.read(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return docs.where("doc_id % 3 != 0"), docs.where("doc_id % 2 = 0").select("doc_id", F.upper("lang").alias("lang"), (F.col("n_chars") + 1).alias("n_chars"))


@query(f"SELECT * FROM {OLD} WHERE doc_id NOT IN (SELECT doc_id FROM {NEW}) UNION ALL SELECT * FROM {NEW}")
def w3_w4_j7_replace_by_key(spark, d):
    old, new = _old_new(spark, d)
    return tables.replace_by_key(old, new, ["doc_id"])


@query(f"SELECT * FROM {OLD} UNION ALL SELECT * FROM {NEW} WHERE doc_id NOT IN (SELECT doc_id FROM {OLD})")
def w9_insert_or_ignore(spark, d):
    old, new = _old_new(spark, d)
    return tables.insert_or_ignore(old, new, ["doc_id"])


@query(f"SELECT author, commit_sha, ts FROM {COMMITS} QUALIFY row_number() OVER (PARTITION BY author ORDER BY ts DESC, commit_id DESC) = 1")
def w1_w2_w10_latest_wins(spark, d):
    return tables.latest_wins(A.plain_commits(spark, d), ["author"], F.struct("ts", "commit_id")).select("author", "commit_sha", "ts")


@query("SELECT source AS path, arg_max(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END, doc_id) FILTER (WHERE doc_id % 4 <> 0) AS language FROM documents GROUP BY source")
def w5_last_known_language(spark, d):
    rows = A.read(spark, d, "documents").select(F.col("source").alias("path"), F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("lang")).alias("language"), "doc_id")
    return tables.last_known(rows, ["path"], "language", "doc_id")


@query(f"""SELECT l_orderkey AS hunk_id, kind AS symbol_kind, name AS symbol_name, CASE max(l_linenumber) % 3 WHEN 1 THEN 'exact_span' WHEN 2 THEN 'hunk_header' ELSE 'file_fallback' END AS attribution_kind
FROM lineitem JOIN {SYMBOLS} ON l_partkey = symbol_id GROUP BY l_orderkey, kind, name""")
def w6_put_hunk_symbols(spark, d):
    """Of rows that repeat a hunk's symbol the last one counts."""
    return tables.put_hunk_symbols(A.hunk_symbols(spark, d, order=True), "ord").select("hunk_id", "symbol_kind", "symbol_name", "attribution_kind")


@query("SELECT source AS repo_id, array_to_string(list(lang || '=' || n ORDER BY lang), ',') AS components FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL) GROUP BY source")
def w10_metadata_map(spark, d):
    rows = A.read(spark, d, "documents").where("lang is not null").groupBy(F.col("source").alias("repo_id"), F.col("lang").alias("component")).agg(F.count("*").cast("string").alias("version"))
    pairs = F.transform(F.map_entries("components"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return tables.metadata_map(rows).select("repo_id", F.array_join(pairs, ",").alias("components"))


@query(f"SELECT to_json({{hunk_id: hunk_id, language: language}})::VARCHAR AS line FROM {HUNKS}")
def w15_json_rows(spark, d):
    return A.hunks(spark, d).select(F.to_json(F.struct("hunk_id", "language")).alias("line"))


@query(f"SELECT DISTINCT author FROM {COMMITS}")
def u4_distinct(spark, d):
    return A.plain_commits(spark, d).select("author").distinct()


@query(f"SELECT hunk_id, h.commit_id, commit_sha, file_path, language, ts, author FROM {HUNKS} h JOIN {COMMITS} c USING (commit_id) WHERE hunk_id IN (SELECT hunk_id FROM {NEAR})")
def j1_hydrate_hits(spark, d):
    near = knn.nearest(A.vectors(spark, d), list(_vector(spark, d, 7)), 50).select("hunk_id")
    wide = A.hunks(spark, d).join(F.broadcast(near), "hunk_id").join(A.plain_commits(spark, d), "commit_id")
    return wide.select("hunk_id", "commit_id", "commit_sha", "file_path", "language", "ts", "author")


@query(f"SELECT hunk_id, language, length(diff_text)::INTEGER AS n FROM {HUNKS} WHERE commit_id = 17 AND file_path = (SELECT file_path FROM {HUNKS} WHERE hunk_id = 17)")
def j5_hunks_of_file_in_commit(spark, d):
    hunks = A.hunks(spark, d)
    file = hunks.where("hunk_id = 17").select("file_path").scalar()
    return hunks.where((F.col("commit_id") == 17) & (F.col("file_path") == file)).select("hunk_id", "language", F.length("diff_text").alias("n"))


# --- Whole plans -------------------------------------------------------------------------------


def corpus(spark: SparkSession, d: str) -> retrieve.Corpus:
    hunks, commits = A.hunks(spark, d), A.plain_commits(spark, d)
    rows = hunks.join(commits.select("commit_id", "message"), "commit_id").withColumn("sem", T.semantic_text(F.col("message"), F.coalesce("diff_text", F.lit(""))))
    text = fulltext.TextIndex.build(hunks, "hunk_id", ["diff_text"], ("commit_id",))
    semantic = text.before(commits, "message", "commit_id", rows, "sem")
    return retrieve.Corpus(hunks, commits, A.vectors(spark, d), text, semantic, _head_index(spark, d), A.symbols(spark, d), A.hunk_symbols(spark, d))


SEMANTIC = f"(SELECT hunk_id, c.message || chr(10) || chr(10) || coalesce(diff_text, '') AS sem FROM {HUNKS} h JOIN {COMMITS} c USING (commit_id))"


def _matches(rows: str, key: str, tokens: str, words: list[str]) -> str:
    """key and score of the rows that hold all words."""
    fs = ", ".join(f"count(*) FILTER (WHERE t = '{w}') AS f{i}" for i, w in enumerate(words))
    score = " + ".join(f"greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(words)))
    return f"""(WITH d AS (SELECT {key}, {tokens} AS ts FROM {rows}), x AS (SELECT {key}, len(ts) AS dl, unnest(ts) AS t FROM d), st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
fs AS (SELECT {key}, dl, {fs} FROM x GROUP BY ALL), ns AS (SELECT {", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i in range(len(words)))} FROM fs)
SELECT {key}, -({score}) AS score FROM fs, ns, st WHERE {" AND ".join(f"f{i} > 0" for i in range(len(words)))})"""


def _find_pattern_sql(text: str, k: int, pool: int, weight: float, similarity: str, where: str = "true", vector: bool = True) -> str:
    """find_pattern in SQL: the lanes, their fusion, and the best of the pool with their facts."""
    words = text.split()
    facts = f"(SELECT hunk_id, file_path, language, ts FROM {HUNKS} JOIN {COMMITS} USING (commit_id))"
    fit = f"(SELECT * FROM {facts} WHERE {where})"
    near = f"(SELECT vec_id AS hunk_id, list_distance(embedding::DOUBLE[], {V_OF.format(7)}) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 100)"

    def best(lane: int, matches: str) -> str:
        top = f"(SELECT hunk_id, score FROM {matches} SEMI JOIN {fit} USING (hunk_id) ORDER BY score, hunk_id LIMIT 100)"
        return f"SELECT {lane} AS lane, row_number() OVER (ORDER BY score, hunk_id) AS rank, hunk_id, 1 / (1 - score) AS similarity FROM {top}"

    head = _matches(SYMBOLS, "symbol_id", f"{_tokens('kind')} || {_tokens('name')} || {_tokens('sibling_names')}", words)
    head = f"(SELECT hunk_id, min(score) AS score FROM {fit} JOIN (SELECT file_path, score FROM {head} JOIN {SYMBOLS} USING (symbol_id)) USING (file_path) GROUP BY hunk_id)"
    named = f"""(SELECT *, row_number() OVER (ORDER BY rank, ts DESC, hunk_id, symbol_name) AS ord FROM (SELECT hunk_id, symbol_name, ts, {RANK} AS rank FROM {HUNK_SYMBOLS} JOIN {fit} USING (hunk_id)
WHERE lower(symbol_name) LIKE '%{text}%' ORDER BY rank, ts DESC, hunk_id, symbol_name LIMIT 100))"""
    lanes = [
        *([f"SELECT 0 AS lane, row_number() OVER (ORDER BY distance, hunk_id) AS rank, hunk_id, 1 / (1 + distance) AS similarity FROM {near} JOIN {fit} USING (hunk_id)"] if vector else []),
        best(1, _matches(HUNKS, "hunk_id", _tokens("diff_text"), words)),
        best(2, _matches(SEMANTIC, "hunk_id", _tokens("sem"), words)),
        f"SELECT 3 AS lane, row_number() OVER (ORDER BY ord) AS rank, hunk_id, CASE r WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS similarity FROM (SELECT hunk_id, min(ord) AS ord, arg_min(rank, ord) AS r FROM {named} GROUP BY hunk_id)",
        best(4, head),
    ]
    return f"""WITH l AS ({" UNION ALL ".join(f"(SELECT * FROM ({x}))" for x in lanes)}),
fused AS (SELECT hunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, arg_min(similarity, lane * 1000 + rank) AS first_similarity, min(lane * 1000 + rank) AS first FROM l GROUP BY hunk_id),
pool AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, first, hunk_id) AS pool_rank FROM fused ORDER BY rrf DESC, first, hunk_id LIMIT {pool}),
scored AS (SELECT *, {similarity} AS similarity, exp(-(greatest({NOW} - ts, 0) / 86400.0::DOUBLE) / 90.0::DOUBLE) AS recency FROM pool JOIN {HUNKS} h USING (hunk_id) JOIN {COMMITS} c USING (commit_id)),
top AS (SELECT *, similarity * (1 + {weight}::DOUBLE * recency) AS combined FROM scored ORDER BY combined DESC, pool_rank LIMIT {k}),
names AS (SELECT hunk_id, list(symbol_name ORDER BY {RANK}, symbol_name) AS ns FROM {HUNK_SYMBOLS} GROUP BY hunk_id)
SELECT hunk_id, commit_sha, message AS commit_message, author AS commit_author, strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS commit_date, file_path, change_kind,
len({_lines("coalesce(diff_text, '')")}) > 80 AS diff_truncated, coalesce(array_to_string(ns, ','), '') AS related_head_symbols, round(similarity, 9) AS similarity, round(recency, 9) AS recency_weight, round(combined, 9) AS combined_score, 'INFERRED' AS provenance
FROM top LEFT JOIN names USING (hunk_id)"""


def _shown(found: DataFrame) -> DataFrame:
    return found.drop("diff_excerpt").withColumns({"related_head_symbols": F.array_join("related_head_symbols", ","), **{c: r9(F.col(c)) for c in ("similarity", "recency_weight", "combined_score")}})


@query(_find_pattern_sql("how did we fix the", 10, 20, 0.075, "first_similarity"))
def find_pattern_hybrid(spark, d):
    return _shown(retrieve.find_pattern(corpus(spark, d), "how did we fix " + "the", NOW, list(_vector(spark, d, 7)), k=10))


@query(_find_pattern_sql("the", 20, 20, 0.05, "first_similarity"))
def find_pattern_all_lanes(spark, d):
    """A word that hunks, messages, names and symbols hold."""
    return _shown(retrieve.find_pattern(corpus(spark, d), "the", NOW, list(_vector(spark, d, 7)), k=20))


@query(_find_pattern_sql(NAME, 20, 20, 0.05, "rrf"))
def find_pattern_by_symbol(spark, d):
    return _shown(retrieve.find_pattern(corpus(spark, d), NAME, NOW, list(_vector(spark, d, 7)), k=20, by_fusion=True))


@query(_find_pattern_sql("thnd", 10, 20, 0.05, "rrf", f"language = 'en' AND ts >= {SINCE}"))
def find_pattern_filtered(spark, d):
    found = retrieve.find_pattern(corpus(spark, d), "thnd", NOW, list(_vector(spark, d, 7)), k=10, language="en", since=SINCE, by_fusion=True)
    return _shown(found)


RERANKED = f"1 / (1 + exp(-(len(list_intersect(['thnd', 'erble'], {_tokens('h.diff_text')})) / 2::DOUBLE * 6 - 3)))"


@query(_find_pattern_sql(WORDS, 10, 20, 0.05, RERANKED, vector=False))
def find_pattern_reranked(spark, d):
    return _shown(retrieve.find_pattern(corpus(spark, d), WORDS, NOW, k=10, rerank=True))


@query("SELECT event_type, date_trunc('hour', ts)::VARCHAR AS hour, count(*) AS n FROM events GROUP BY ALL")
def st_event_windows(spark, d):
    rows = A.read(spark, d, "events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pattern_hybrid(spark, sf_dir)
