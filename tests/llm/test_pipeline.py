import base64
import collections
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tracegrain.llm.simhash import simhash

from .test_operators import plain_targets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(i, n=120):
    return " ".join(f"w{(i * 7919 + k * k * 31) % 5003}" for k in range(n))


def rows():
    out = [(i, words(i), "en", f"s{i % 3}", 0) for i in range(60)]
    out += [(100, words(3).upper().replace("W", "w", 0), "en", "s0", 0), (101, words(4) + " tail", "en", "s1", 0)]
    return out + [(200, "123 !!", "en", "s0", 0), (201, None, None, None, None), (202, "", "en", "s1", 0)]


def test_stages(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == set(range(60)) | {100, 101}
    assert kept.columns == docs.columns
    kept = corpus_pipeline.drop_copies(spark, kept, "")
    ids = {r.doc_id for r in kept.collect()}
    assert 100 in ids and 3 not in ids and len(ids) == 61
    near = corpus_pipeline.drop_near_copies(spark, kept, "")
    assert {r.doc_id for r in near.collect()} == near_kept({i: t for i, t, *_ in rows() if i in ids})
    mixed = corpus_pipeline.mix_sources(spark, near, "")
    assert mixed.columns == docs.columns
    sizes = mixed.agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert abs(sizes - 1.5 * near.agg(F.sum(F.size(F.split("text", " ")))).first()[0]) < 200
    packed = corpus_pipeline.pack_sequences(spark, mixed, "")
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_text_in_no_learned_language_goes(spark):
    rng = np.random.default_rng(3)
    known = {
        "en": "the of and to in is that for it with as was on be at by this had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up".split(),
        "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder".split(),
    }
    clean = [(i, " ".join(rng.choice(known[lang], int(rng.integers(3, 300)))), lang, "s", 0) for i in range(200) for lang in ["de" if i % 3 else "en"]]
    strange = [rng.bytes(300).hex(), base64.b64encode(rng.bytes(300)).decode(), "Съешь же ещё этих мягких французских булок " * 12, "今天天气很好我们一起去公园散步吧然后回家吃晚饭" * 12, "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw " * 8]
    cuts = [t[:n] for t in strange for n in (40, 200, 600)]
    docs = spark.createDataFrame(clean + [(1000 + i, t, None, "s", 0) for i, t in enumerate(cuts)], DOCS)
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()} == set(range(200))


def near_kept(texts):
    """The smallest id of each group that differences of four bits or fewer connect."""
    marks = {i: simhash(t.encode()) for i, t in texts.items()}
    kept = set()
    left = set(texts)
    while left:
        group, todo = set(), [min(left)]
        while todo:
            at = todo.pop()
            group.add(at)
            todo += [i for i in left - group - set(todo) if (marks[i] ^ marks[at]).bit_count() <= 4]
        left -= group
        kept.add(min(group))
    return kept


def test_near_copies_broadcast_no_more_than_is_counted(spark, monkeypatch):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "sha1(cast(id AS string)) AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    docs = docs.union(docs.selectExpr("doc_id + 20000", "text", "lang", "source", "n_chars"))
    monkeypatch.setattr("tracegrain.llm.common.BROADCAST_ROWS", 10_000)
    held = {"spark.sql.autoBroadcastJoinThreshold": "1m", "spark.sql.maxBroadcastTableSize": "4m"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert corpus_pipeline.drop_near_copies(spark, docs, "").agg(F.count("*"), F.max("doc_id")).first() == (20_000, 19_999)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def batch_bytes(spark, docs, stage, seen, monkeypatch):
    """Bytes of all Arrow batches that a stage sends to Python before it returns."""
    plain = type(docs).mapInArrow

    def seeing(df, run, *args):
        def noted(batches):
            def note():
                for batch in batches:
                    with open(seen, "a") as f:
                        f.write(f"{batch.nbytes}\n")
                    yield batch

            return run(note())

        return plain(df, noted, *args)

    seen.write_text("")
    with monkeypatch.context() as m:
        m.setattr(type(docs), "mapInArrow", seeing)
        stage(spark, docs, "")
    return [int(x) for x in seen.read_text().split()]


def test_texts_go_to_python_in_small_batches(spark, tmp_path, monkeypatch):
    docs = spark.range(0, 240, 1, 1).selectExpr("id AS doc_id", "concat(id % 120, repeat(' some words', 5000)) AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    for _, stage in corpus_pipeline.STAGES:
        found = batch_bytes(spark, docs, stage, tmp_path / "seen", monkeypatch)
        assert sum(found) > 12 << 20
        assert max(found) < 5 << 20
        assert spark.conf.get(key) == before
    try:
        spark.conf.set(key, "1m")
        assert max(batch_bytes(spark, docs, corpus_pipeline.mix_sources, tmp_path / "seen", monkeypatch)) < 2 << 20
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)


def test_run(spark, tmp_path):
    from tokenizers import Tokenizer

    near = [(300 + i, words(10 + i, 900) + tail, "en", "s1", 0) for i in range(4) for tail in (" end", " end")]  # same id and text twice
    near += [(400 + i, words(10 + i, 900) + " fin", "en", "s1", 0) for i in range(4)]
    all_ = rows() + near
    spark.createDataFrame(all_, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    last = {}
    for i, text, lang, source, _ in all_:
        if text and any(c.isalpha() for c in text):
            key = text.encode().lower()
            last[key] = max(last.get(key, (i, text, source)), (i, text, source))
    left = {i: (t, s) for i, t, s in last.values()}
    left = {i: left[i] for i in near_kept({i: t for i, (t, _) in left.items()})}
    assert any(i in left for i in range(300, 304)) and any(i not in left for i in range(400, 404))
    exact = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    ids = {i: np.array([*exact.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, (t, _) in left.items()}
    pieces, bins = collections.Counter(), collections.defaultdict(list)
    for r in out:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32
        pieces[(r.doc_id, r.piece)] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    copies = {i: pieces[(i, 0)] for i in left}
    assert all(n == copies[i] <= 2 for (i, _), n in pieces.items())
    assert all(sum(r.length for r in out if r.doc_id == i) == n * len(ids[i]) for i, n in copies.items())
    for spans in bins.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 2048
    tokens = sum(len(ids[i]) * n for i, n in copies.items())
    assert len(bins) <= 1.2 * tokens / 2048 + 1
    size = {i: len(t.split()) for i, (t, _) in left.items()}
    by_source = collections.Counter()
    for i, (_, source) in left.items():
        by_source[source] += size[i]
    for source, target in plain_targets(by_source).items():
        assert abs(sum(size[i] * copies[i] for i, (_, s) in left.items() if s == source) - target) <= max(size.values())


def test_repeated_rows_and_clashing_columns(spark):
    text = words(1, 50)
    base = [(1, text), (1, text), (1, text.upper()), (2, words(2, 50)), (2, words(2, 50)), (None, words(3, 50)), (None, words(3, 50)), (3, words(4, 50)), (3, words(5, 50)), (4, words(5, 50))]
    fields = "doc_id long, text string, lang string, source string, n_chars long, doc string, row_key string, __row_key string, copies string, stays string, kept string, same_id string"
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "a", "b", "c", "d", "e", "f", "g") for i, t in base], fields)
    out = corpus_pipeline.drop_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text.lower()) for r in out.collect())
    assert got == sorted([(1, text), (2, words(2, 50)), (0, words(3, 50)), (3, words(4, 50)), (4, words(5, 50))])
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 0
    assert corpus_pipeline.pack_sequences(spark, docs, "").count() == len(base)
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
