"""The k best matches by blocks against scoring all."""

import random

import pytest
from pyspark.sql import functions as F

from tracegrain.operators import fulltext, segments, topk


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(40)], k=int(3 + rng.random() ** 4 * 400)))) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(30)] + [(3000, ""), (3001, None)]  # ties
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()


def shape(df):
    return sorted((r.qid, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())


def test_blocks_give_what_scoring_all_gives(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_DOCS", 16)
    whole = fulltext.TextIndex.build(docs, "doc_id", ["text"])
    whole.write(str(tmp_path / "t"))
    held = fulltext.TextIndex.read(spark, str(tmp_path / "t"))
    queries = [(i, f"w{i % 7} w{i % 5}") for i in range(200)] + [(900, "w0"), (901, "w39 w38"), (902, "none w0"), (903, "")]
    asked = spark.createDataFrame(queries, "qid int, text string")
    for k in (1, 5, 40):
        assert shape(fulltext.search_batch(held, asked, k)) == shape(fulltext.search_batch(whole, asked, k))
    _, may, _, more = topk.visits(held, asked, 5)
    n, read = may.count(), more.count() + min(topk.FIRST, 4) * may.select("qid").distinct().count()
    assert read < n / 2  # most blocks of common words are passed over
    assert held.blocks.agg(F.max("n")).first()[0] < 64


def test_blocks_of_segments_with_their_dead(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_DOCS", 16)
    root, state = str(tmp_path / "s"), segments.empty()
    for n in range(3):
        state = segments.add(spark, root, state, docs.where(F.col("doc_id") % 3 == n), "doc_id", ["text"])
    state = segments.delete(spark, root, state, docs.where("doc_id % 5 = 0"))
    whole = fulltext.TextIndex.build(docs.where("doc_id % 5 != 0"), "doc_id", ["text"])
    asked = spark.createDataFrame([(i, f"w{i} w{(i * i) % 9}") for i in range(30)], "qid int, text string")
    assert shape(fulltext.search_batch(segments.view(spark, root, state), asked, 7)) == shape(fulltext.search_batch(whole, asked, 7))


def shuffled(spark):
    """Bytes that all stages of the session have shuffled so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_postings_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Writing an index moves its texts at most, and blocks hold whole documents of which there are few, or one that is long."""
    monkeypatch.setattr(topk, "BLOCK_TOKENS", 900, raising=False)
    rng = random.Random(8)
    rows = [(i, " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(rng.randint(0, 400)))) for i in range(800)] + [(5000, "long " * 2000), (5001, None)]
    held = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    size, before = sum(len(t or "") for _, t in rows), shuffled(spark) if held.count() else 0
    whole = fulltext.TextIndex.build(held, "doc_id", ["text"])
    whole.write(str(tmp_path / "t"))
    assert shuffled(spark) - before < 1.5 * size
    before, root = shuffled(spark), str(tmp_path / "s")
    state = segments.add(spark, root, segments.empty(), held, "doc_id", ["text"])
    assert shuffled(spark) - before < 0.5 * size
    told = lambda df: sorted((r.doc_id, r.term, tuple(r.positions), r.length) for r in df.collect())
    want, written = told(whole.postings), fulltext.TextIndex.read(spark, str(tmp_path / "t"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    spark.conf.set(key, "300")  # documents go on in the next batch
    try:
        fulltext.TextIndex(written.postings, written.stats, written.terms).write(str(tmp_path / "again"))
    finally:
        spark.conf.set(key, usual)
    for index in (written, segments.view(spark, root, state), fulltext.TextIndex.read(spark, str(tmp_path / "again"))):
        assert told(index.postings) == want and sorted(index.terms.collect()) == sorted(whole.terms.collect())
        each = index.blocks.select("term", "block", "n", "cf", "max_tf", "min_length", "hits").collect()
        assert len({(r.term, r.block) for r in each}) == len(each)
        blocks = {}
        for r in each:
            tf = [len(h.positions) for h in r.hits]
            assert (r.n, r.cf, r.max_tf, r.min_length) == (len(tf), sum(tf), max(tf), min(h.length for h in r.hits))
            blocks.setdefault(r.block, {}).update({h.doc_id: h.length for h in r.hits})
        assert max(map(len, blocks.values())) <= topk.BLOCK_DOCS and all(sum(b.values()) <= 900 or len(b) == 1 for b in blocks.values())
        assert sum(map(len, blocks.values())) == len({d for d, *_ in want})  # each in one block


def test_trigrams_find_what_like_finds(spark):
    from tracegrain.operators import trigrams

    rng = random.Random(1)
    names = ["".join(rng.choices("abcAB_%é", k=rng.randint(0, 9))) for _ in range(400)] + ["retry_with_backoff", "RetryPolicy", "ab", None, "a\\b"]
    rows = spark.createDataFrame([(n,) for n in names], "symbol_name string")
    grams = trigrams.grams_of(rows).cache()
    for q in ("retry", "Retry", "with_back", "ab", "a", "", "%", "a%b", "abc%ab", "_bc", "é", "bca", "a\\b", "nothing"):
        want = {n.lower() for (n,) in rows.where(trigrams.holds(F.col("symbol_name"), q)).collect()}
        assert {r.name for r in trigrams.matching(grams, q).collect()} == want, q
    distinct = grams.select("name").distinct().count()
    assert trigrams.candidates(grams, "retry").count() == 2 < distinct / 10  # names that are read
    assert trigrams.wanted("a_bcd%ef") == ["bcd"]
