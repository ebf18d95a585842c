import pytest
from pyspark.sql import functions as F

from tracegrain.functions import compatibility, intent
from tracegrain.functions import text as T
from tracegrain.functions import vectors as V
from tracegrain.functions.counters import Counters
from tracegrain.functions.held import Held
from tracegrain.functions.session import resources
from tracegrain.operators import tables


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_truncate_diff(spark):
    text, cut = T.truncate_diff(F.lit("a\nb\nc"), 2)
    assert one(spark, text, cut) == ("a\nb\n... (1 more lines)\n", True)
    text, cut = T.truncate_diff(F.lit("a\nb\n"), 2)
    assert one(spark, text, cut) == ("a\nb\n", False)
    assert one(spark, T.count_lines(F.lit("")), T.count_lines(F.lit("a\nb")), T.count_lines(F.lit("a\n"))) == (0, 2, 1)


DIFF = "@@ -1,2 +10,3 @@ fn fetch(url: &str)\n+++ b/x\n+added one\n context\n-gone\n+added two\n@@ -5 +7 @@\n@@ -5 +0,0 @@ impl\n"


def test_diff_functions(spark):
    assert one(spark, T.added_lines(F.lit(DIFF)), T.added_line_count(F.lit(DIFF))) == ("added one\nadded two", 2)
    ranges, suffixes = one(spark, T.post_image_ranges(F.lit(DIFF)), T.header_suffixes(F.lit(DIFF)))
    assert [tuple(r) for r in ranges] == [(10, 3), (7, 1)]
    assert suffixes == ["fn fetch(url: &str)", "impl"]
    assert tuple(one(spark, T.header_symbol(F.lit("pub fn fetch(url")))[0]) == ("fetch", "function")
    assert one(spark, T.header_symbol(F.lit("my_fn fetch"))) == (None,)


def test_hashes_and_ulid(spark):
    assert one(spark, T.content_hash(F.lit("")))[0].startswith("e3b0c442")
    made = one(spark, T.ulid(F.lit(0), F.lit("00" * 20)), T.ulid(F.lit(1), F.lit("ff" * 20)), T.ulid(F.lit(-5), F.lit("not hex")))
    assert made == ("0" * 26, "00000000Z8" + "Z" * 16, "0" * 26)


def test_path_prefixes_and_percent(spark):
    assert one(spark, T.path_prefixes(F.lit("a/b/c.rs"))) == (["a/", "a/b/", "a/b/c.rs"],)
    assert one(spark, T.percent(F.lit(1), F.lit(300)), T.percent(F.lit(30), F.lit(100.0))) == ("<1%", "30%")


def test_query_understanding():
    p = intent.parse_query("how is `retry_with_backoff` called in rust src/fetch.rs last 30 days", 10_000_000)
    assert (p.intent, p.language, p.path_terms, p.symbol_terms, p.since_unix) == ("api_usage", "rust", ("src/fetch.rs",), ("retry_with_backoff",), 10_000_000 - 30 * 86400)
    assert intent.classify("there was a bug we fixed")[:2] == ("bug_fix_precedent", "medium")
    assert intent.classify("how did we fix the crash")[:2] == ("bug_fix_precedent", "high")
    assert intent.classify("load configuration")[0] == "configuration"
    assert intent.classify("retry with backoff") == ("unknown", "low", "intent:unknown:fallthrough")
    assert intent.PROFILES["bug_fix_precedent"].weights().recency_weight == pytest.approx(0.075)
    assert intent.PROFILES["api_usage"].weights().rerank_top_k == 40


def test_since_and_lines():
    assert intent.parse_since("", 5) is None and intent.parse_since("2d", 200_000) == 200_000 - 2 * 86400
    assert intent.parse_since("2024-01-01", 0) == 1704067200 == intent.parse_since("2024-01-01T00:00:00+00:00", 0)
    with pytest.raises(ValueError):
        intent.parse_since("yesterday", 0)
    assert intent.parse_lines("3:", 9) == (3, 9) and intent.parse_lines(":4", 9) == (1, 4) and intent.parse_lines(None, 0) == (1, 1)


def test_compatibility():
    want = compatibility.Expected({"embedding_model": "m", "schema": "4"}, {"rust": "1"})
    have = {"embedding_model": "m", "schema": "4", "parser_rust": "1"}
    assert compatibility.assess(want, have).status == "compatible"
    assert compatibility.assess(want, have | {"embedding_model": "x", "schema": "3"}).status == "needs_rebuild"
    assert compatibility.assess(want, have | {"schema": "3"}).status == "query_compatible_needs_refresh"
    assert compatibility.assess(want, {"schema": "4"}).missing == ("embedding_model", "parser_rust")
    assert compatibility.hint("a", 3, compatibility.assess(want, have)) is None
    assert "51 commits" in compatibility.hint("a", 51, compatibility.assess(want, have))


def test_resources():
    assert resources(8) == {"commit_batch": 256, "threads": 8, "embed_batch": 128}
    assert resources(4, "conservative") == {"commit_batch": 64, "threads": 2, "embed_batch": 32}


def test_held_values():
    now, gone, made = [0.0], [], []
    held = Held(2, 5.0, gone=gone.append, clock=lambda: now[0])

    def get(key):
        return held.get(key, lambda: made.append(key) or key)

    assert [get(k) for k in "aba"] == ["a", "b", "a"] and made == ["a", "b"]
    get("c")  # b was used longest ago
    assert gone == ["b"] and len(held) == 2
    now[0] = 5.0
    get("a")
    now[0] = 5.1
    get("a")  # too old
    assert made == ["a", "b", "c", "a"] and gone == ["b", "a"]
    held.drop("c")
    held.drop("none")
    assert gone == ["b", "a", "c"] and len(held) == 1


def test_counters(spark):
    counted = Counters()
    with counted.timed("knn") as rows:
        rows.append(3)
    with pytest.raises(ValueError), counted.timed("knn"):
        raise ValueError
    counted.record("text", 7, 2)
    told = counted.snapshot()
    assert told["knn"][0] == 2 and told["knn"][2] == 3 and told["text"] == (1, 7, 2)
    twice = tables.method_metrics(counted.table(spark).unionByName(counted.table(spark)))
    assert {r.method: (r.calls, r.rows) for r in twice.collect()} == {"knn": (4, 6), "text": (2, 4)}
    assert tables.method_metrics(Counters().table(spark)).count() == 0


def test_vector_codec(spark):
    rows = spark.createDataFrame([(1, [1.0, -0.5]), (2, []), (3, None)], "id int, v array<float>")
    coded = rows.withColumn("raw", V.to_bytes(F.col("v")))
    assert bytes(coded.where("id = 1").first().raw) == b"\x00\x00\x80\x3f\x00\x00\x00\xbf"
    assert [r.back for r in coded.select("id", V.from_bytes(F.col("raw")).alias("back")).orderBy("id").collect()] == [[1.0, -0.5], [], None]
    assert spark.range(1).select(V.from_bytes(F.unhex(F.lit("0000803f00"))).alias("v")).first().v == [1.0]
