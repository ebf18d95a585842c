"""The index over batches: segments against an index built at once, the manifest log, and what goes wrong."""

import json
import threading
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracegrain.operators import chunking, fulltext, segments
from tracegrain.plans import index, manifest, retrieve

T0 = 1704067200
COMMITS = "commit_sha string, parent_sha string, is_merge boolean, author string, ts long, message string"
HUNKS = "commit_sha string, file_path string, language string, change_kind string, diff_text string"


def commits(spark, *shas, message="m"):
    return spark.createDataFrame([(s, None, False, "a", T0 + i, message) for i, s in enumerate(shas)], COMMITS)


def hunks(spark, *rows):
    return spark.createDataFrame([(sha, path, "rust", "added", diff) for sha, path, diff in rows], HUNKS)


def found(text_index, query):
    return {(r.doc_id, round(r.score, 9)) for r in fulltext.search(text_index, query).collect()}


WORDS = ["alpha", "beta", "gamma", "delta", "of", "the", "Ünï", "x_y"]
QUERIES = ["alpha", "alpha beta", "of_the", "alpha OR gamma NOT delta", "uni", "x_y", "absent", "the of"]


def texts(n):
    return [(i, " ".join(WORDS[(i * 7 + j * j) % len(WORDS)] for j in range(i % 9))) for i in range(n)]


def test_segments_equal_an_index_built_at_once(spark, tmp_path):
    root, rows = str(tmp_path / "t"), texts(90)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    state = segments.empty()
    for n in range(9):
        state = segments.add(spark, root, state, docs.where(F.col("doc_id") % 9 == n), "doc_id", ["text"])
    assert len(state["segments"]) == 9

    def same(living):
        whole = fulltext.TextIndex.build(spark.createDataFrame([r for r in rows if r[0] in living], docs.schema), "doc_id", ["text"])
        held = segments.view(spark, root, state)
        assert held.known() == (len(living), pytest.approx(whole.known()[1]))
        assert sorted(held.terms.collect()) == sorted(whole.terms.collect())
        for q in QUERIES:
            assert found(held, q) == found(whole, q), q
        asked = spark.createDataFrame([(1, "alpha beta"), (2, "the"), (3, "absent")], "qid int, text string")
        shape = lambda df: {(r.qid, r.doc_id, r["rank"], round(r.score, 9)) for r in df.collect()}
        assert shape(fulltext.search_batch(held, asked, 5)) == shape(fulltext.search_batch(whole, asked, 5))

    living = set(range(90))
    same(living)
    for gone in ({3, 4, 50, 1000}, {4, 5, 89}):  # unknown and dead ids are passed over
        state = segments.delete(spark, root, state, spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        living -= gone
    assert segments.delete(spark, root, state, spark.createDataFrame([(4,)], "doc_id long")) == state
    same(living)
    names = segments.to_merge(state, 8)
    assert len(names) >= 8
    state = segments.merge(spark, root, state, names)
    assert len(state["segments"]) < 9 and all(set(d["of"]) <= {s["id"] for s in state["segments"]} for d in state["dead"])
    same(living)
    state = segments.add(spark, root, state, docs.where("doc_id = 4"), "doc_id", ["text"])  # again, after it was deleted
    same(living | {4})
    state = segments.merge(spark, root, state, [s["id"] for s in state["segments"]])
    assert len(state["segments"]) == 1 and not state["dead"]
    same(living | {4})


def test_an_empty_text_index_is_searched(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert segments.add(spark, str(tmp_path / "s"), segments.empty(), docs, "doc_id", ["text"]) == segments.empty()
    assert found(segments.view(spark, str(tmp_path / "s"), segments.empty()), "alpha OR beta") == set()
    fulltext.TextIndex.build(docs, "doc_id", ["text"]).write(str(tmp_path / "t"))
    assert found(fulltext.TextIndex.read(spark, str(tmp_path / "t")), "alpha") == set()


def test_an_index_without_head_symbols_is_searched(spark, tmp_path):
    made = index.Index(spark, str(tmp_path / "ix"))
    made.ingest(commits(spark, "c1", message="add retry"), hunks(spark, ("c1", "a.rs", "+retry()")))
    vector = chunking.hashing_embedder(pd.Series(["retry"]), index.DIM)[0].tolist()
    assert [r.commit_sha for r in retrieve.find_pattern(made.corpus(), "retry", T0, vector).collect()] == ["c1"]
    empty = index.Index(spark, str(tmp_path / "none"))
    assert retrieve.find_pattern(empty.corpus(), "retry", T0, vector).count() == 0


def test_hunks_of_a_file_are_told_apart(spark, tmp_path):
    made = index.Index(spark, str(tmp_path / "ix"))
    report = made.ingest(commits(spark, "c1"), hunks(spark, ("c1", "g.py", "+alpha"), ("c1", "g.py", "+beta"), ("c1", "g.py", "+beta")))
    assert report.hunks == 2  # what is repeated word for word is one
    text, _ = made.text_indexes()
    (alpha,), (beta,) = found(text, "alpha"), found(text, "beta")
    assert alpha[0] != beta[0]
    by_id = {r.hunk_id: r.diff_text for r in made.hunks().collect()}
    assert by_id[alpha[0]] == "+alpha" and by_id[beta[0]] == "+beta"


def test_no_failure_is_lost(spark, tmp_path):
    made = index.Index(spark, str(tmp_path / "ix"))
    bad = spark.createDataFrame([(None, None, False, "a", T0, "no sha"), ("c0", None, False, "a", None, "no time")], COMMITS)
    none = hunks(spark).limit(0)
    report = made.ingest(bad, hunks(spark, ("c1", None, "+x"), (None, "b.rs", "+y")))
    assert (report.commits, report.dead_letters) == (0, 4)
    kept = {(r.commit_sha, r.detail) for r in made.table("dead_letters", index.DEAD).collect()}
    assert kept == {(None, "no sha"), ("c0", "no time"), ("c1", "+x"), (None, "b.rs")}
    state = made._pointers()
    assert made.ingest(bad, none).dead_letters == 0 and made._pointers() == state  # once
    mixed = made.ingest(bad.unionByName(commits(spark, "c1")), none)
    assert (mixed.commits, mixed.dead_letters) == (1, 0)


def test_a_batch_writes_one_segment_and_equals_a_rebuild(spark, tmp_path):
    made = index.Index(spark, str(tmp_path / "ix"))
    rows = [(f"c{n}", f"f{n % 2}.rs", f"+{text} common") for n, text in texts(6)]
    for n, row in enumerate(rows):
        before = made._pointers()
        made.ingest(commits(spark, row[0], message="msg"), hunks(spark, row))
        after = made._pointers()
        for name in ("text", "semantic"):
            assert len(after[name]["segments"]) == n + 1
            assert [s for s in after[name]["segments"] if s not in (before.get(name) or segments.empty())["segments"]] == after[name]["segments"][-1:]
    again = index.Index(spark, str(tmp_path / "whole"))
    again.ingest(commits(spark, *[r[0] for r in rows], message="msg"), hunks(spark, *rows))
    for a, b in zip(made.text_indexes(), again.text_indexes(), strict=True):
        for q in ("common", "alpha", "common NOT alpha", "msg"):
            assert found(a, q) == found(b, q)
    assert made.forget(spark.createDataFrame([("c2",), ("c9",)], "commit_sha string")) == 1
    assert made.hunks().count() == made.commits().count() == 5 and len(found(made.text_indexes()[0], "common")) == 5
    assert made.ingest(commits(spark, "c2", message="msg"), hunks(spark, rows[2])).hunks == 1  # as if never seen
    for q in ("common", "alpha"):
        assert found(made.text_indexes()[0], q) == found(again.text_indexes()[0], q)


def test_texts_are_embedded_once_though_a_run_breaks_off(spark, tmp_path, monkeypatch):
    made = index.Index(spark, str(tmp_path / "ix"))
    log = tmp_path / "asked"

    def embedder(asked, dim):
        with open(log, "a") as f:
            f.write("".join(f"{t!r}\n" for t in asked))
        return chunking.hashing_embedder(asked, dim)

    batch = commits(spark, "c1", "c2"), hunks(spark, ("c1", "a.rs", "+one"), ("c2", "a.rs", "+two"))
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(segments, "add", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        made.ingest(*batch, embedder=embedder)
    assert made.commits().count() == 0 and made.bookmark is None
    report = made.ingest(*batch, embedder=embedder)
    assert report.hunks == 2
    asked = [x for x in log.read_text().split("\n") if "one" in x or "two" in x]
    assert len(asked) == 2


def test_writers_at_once_lose_nothing(spark, tmp_path):
    log = manifest.Manifests(spark, str(tmp_path / "m"))
    failed = []

    def write(k):
        try:
            for i in range(10):
                log.commit(lambda state, i=i: state | {"rows": [*state.get("rows", []), [k, i]]})
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    number, state = log.latest()
    assert number == 40 and sorted(state["rows"]) == [[k, i] for k in range(4) for i in range(10)]
    assert log.commit(lambda state: state) == state and log.latest()[0] == 40  # no change, no manifest


def test_a_crash_inside_the_write_leaves_the_last_state(spark, tmp_path, monkeypatch):
    log = manifest.Manifests(spark, str(tmp_path / "m"))
    log.commit(lambda state: {"a": 1})
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(manifest.os, "link", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        log.commit(lambda state: {"a": 2})
    (Path(tmp_path) / "m/manifests/.half").write_text('{"a":')  # what a killed writer leaves aside
    assert log.state() == {"a": 1}
    assert log.commit(lambda state: state | {"b": 2}) == {"a": 1, "b": 2}


def test_ingests_at_once(spark, tmp_path, monkeypatch):
    made = index.Index(spark, str(tmp_path / "ix"))
    real, other = segments.add, []

    def add(*a):
        if not other:  # another writer indexes c2 and c3 while the first is at its texts
            other.append(True)
            index.Index(spark, made.path).ingest(commits(spark, "c2", "c3"), hunks(spark, ("c2", "a.rs", "+two"), ("c3", "a.rs", "+three")))
        return real(*a)

    monkeypatch.setattr(segments, "add", add)
    made.ingest(commits(spark, "c1", "c2"), hunks(spark, ("c1", "a.rs", "+one"), ("c2", "a.rs", "+two")))
    assert sorted(r.commit_sha for r in made.commits().collect()) == ["c1", "c2", "c3"]
    assert made.hunks().count() == 3 and made.text_indexes()[0].known()[0] == 3


def test_vacuum_spares_what_is_named(spark, tmp_path):
    made = index.Index(spark, str(tmp_path / "ix"))
    for n in range(3):
        made.put_metadata("r", {"schema": str(n)}, n)
    made.ingest(commits(spark, "c1"), hunks(spark, ("c1", "a.rs", "+one")))
    orphan = Path(made.path) / "hunks" / "orphan"
    orphan.mkdir()
    assert made.vacuum(kept=100) == 0 and orphan.exists()  # too young
    assert made.vacuum(kept=1, seconds=0) >= 3 and not orphan.exists()
    assert made.metadata("r") == {"schema": "2"} and made.hunks().count() == 1 and len(found(made.text_indexes()[0], "one")) == 1
    assert json.loads((Path(made.path) / "manifests" / sorted(p.name for p in (Path(made.path) / "manifests").glob("*.json"))[-1]).read_text())
