"""Each operator against a plain version, on a small table with all the odd cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tracegrain.llm import (
    common,
    components,
    exact_dedup,
    html_extract,
    importance,
    language_id,
    line_dedup,
    mixing,
    packing,
    prefix_trie,
    sharding,
    simhash,
    token_counts,
    toxicity,
    vector_search,
)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, fp string, size string, Part string, copies string"
PASSAGE = "this passage stands in very many documents"
LONG = "word " * 30000 + "\n" + PASSAGE
BASE = [
    (1, "Hello World", "en", "b"),
    (2, "hello world", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, LONG, "en", "a"),
    (6, "x\n  " + PASSAGE.upper() + " \t\ny", "de", "c"),
    (7, PASSAGE + "\n" + PASSAGE + "\n", None, "a"),
    (8, "ÄÖ ünï ÀÉ\nähnlich", "de", "c"),
    (9, "ÄÖ ünï àÉ\nähnlich", "de", "c"),
    (10, "12 34 !!", "en", None),
    (10, "12 34 !!", "en", None),
    (11, "  two  spaces \n and\t tabs  <|endoftext|> end ", "en", "b"),
    (12, " \x0b\x0c\r\n", "fr", "b"),
    (-13, "négative id " * 40, "fr", "d"),
    (-14, "négative id " * 40 + "fin", "fr", "d"),
    (None, "no id here", "en", "d"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, "s", "f", "z", "p", "c") for r in BASE], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return (text or "").encode().lower()


def test_exact_dedup(odd, empty):
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(odd).collect())
    groups = collections.defaultdict(list)
    for i, text, *_ in BASE:
        groups[low(text)].append(i)
    want = collections.Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, hashlib.sha256(text).hexdigest()) for i in ids)
    assert got == want
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_counting_quotient_filters_merge_losslessly():
    rng = np.random.default_rng(1)
    all_ = rng.integers(0, 1 << 61, 5000, dtype=np.uint64)
    all_ = np.concatenate([all_, all_[:900], np.repeat(all_[:1], 700)])
    parts = [exact_dedup.CountingQuotientFilter.of(3, 0, x) for x in np.array_split(rng.permutation(all_), 7)]
    again = [exact_dedup.CountingQuotientFilter.from_bytes(p.to_bytes()) for p in parts]
    fps, counts = exact_dedup.merge(again).entries()
    want = np.unique(all_, return_counts=True)
    assert (fps == want[0]).all() and (counts == want[1]).all()
    whole = exact_dedup.merge(again)
    assert whole.count(int(want[0][5])) == want[1][5] and whole.count(int(want[0][5]) ^ 1) == 0


def test_fingerprint_join_without_broadcast(odd, monkeypatch):
    monkeypatch.setattr("tracegrain.llm.common.BROADCAST_ROWS", 0)
    rows = exact_dedup.exact_dedup(odd).collect()
    assert {(r.keep_id, r.group_size) for r in rows if r.doc_id in (1, 2)} == {(2, 2)}


def line_truth(rows, min_chars=20, min_docs=3):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()

    held = collections.defaultdict(list)
    for i, text, *_ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                held[k].append(i)
    out = collections.Counter()
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        gone = [x for x in lines if len(held[key(x)]) >= min_docs and max(held[key(x)]) != i]
        kept = [x for x in lines if x not in gone]
        out[(i, len(lines), len(gone), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


def rows_of(df):
    return collections.Counter(tuple(r) for r in line_dedup.digest(df).collect())


def test_line_dedup(odd, empty):
    assert rows_of(line_dedup.line_dedup(odd)) == line_truth(BASE)
    assert line_dedup.line_dedup(empty).count() == 0


@pytest.mark.parametrize("filter_bytes", [1 << 20, 0])
def test_line_dedup_with_many_shared_lines(spark, odd, monkeypatch, filter_bytes):
    """Without broadcasting the exact table, and without broadcasting the filters."""
    monkeypatch.setattr(line_dedup, "PROBE_ROWS", 3)
    lines = spark.range(400).selectExpr("1000 + id as doc_id", "concat('a line of its own, number ', id, '\n', 'THIS line stands in all of these four hundred\n', repeat('x', 5000)) as text")
    docs = odd.select("doc_id", "text").unionByName(lines)
    index = line_dedup.LineIndex.build(docs)
    want = line_truth([tuple(r) for r in docs.collect()])
    assert rows_of(index.apply(docs, broadcast_rows=0, filter_bytes=filter_bytes)) == want == rows_of(index.apply(docs))
    passed = line_dedup.maybe_shared(line_dedup.keyed(docs), index.filters, index.shards, 20, filter_bytes)
    real = line_dedup.references(docs).join(index.shared(), ["h1", "h2"]).count()
    assert real == 803 and real <= passed.count() <= real + 5  # of over 1200 keys


def test_line_dedup_is_reversible(spark, odd, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_LAYERS", 2)  # the third layer merges
    other = [(20, PASSAGE, None, None), (21, "A line that only later is in three documents", None, None), (22, "a line that only later is in three documents\n", None, None), (23, " a LINE that only later is in three documents", None, None)]
    more = spark.createDataFrame([(*r, 0, "", "", "", "", "") for r in other], SCHEMA)
    base = line_dedup.LineIndex.build(odd)
    grown = base.insert(more)
    both = odd.unionByName(more)
    assert rows_of(grown.apply(both)) == line_truth(BASE + other)
    back = grown.delete(more)
    assert rows_of(back.apply(odd)) == rows_of(base.apply(odd))
    again = back.insert(more)
    assert rows_of(again.apply(both)) == line_truth(BASE + other)
    fewer = base.delete(odd.where("doc_id = 7"))
    assert rows_of(fewer.apply(odd.where("doc_id != 7"))) == line_truth([r for r in BASE if r[0] not in (7, None)])


def test_line_index_with_repeated_and_null_ids(spark):
    rows = [(1, PASSAGE), (1, PASSAGE), (2, PASSAGE), (None, PASSAGE + "\nend"), (None, PASSAGE), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = line_dedup.LineIndex.build(docs)

    def truth(rows):
        """As line_truth, with null below every id."""
        ranked = [(-10**9 if i is None else i, t) for i, t in rows]
        known = any(i is not None for i, t in rows if t)
        out = line_truth(ranked) if known else collections.Counter({(i, len((t or "").split("\n")), 0, hashlib.sha256((t or "").encode()).hexdigest()): n for (i, t), n in collections.Counter(ranked).items()})
        return collections.Counter({(None if k[0] == -10**9 else k[0], *k[1:]): n for k, n in out.items()})

    assert rows_of(index.apply(docs)) == truth(rows)
    left = index.delete(spark.createDataFrame([(2,), (99,)], "doc_id long"))
    rest = [r for r in rows if r[0] != 2]
    assert rows_of(left.apply(docs.where("doc_id is null or doc_id != 2"))) == truth(rest)
    left = left.delete(spark.createDataFrame([(1,)], "doc_id long"))
    rest = [r for r in rest if r[0] != 1]
    assert rows_of(left.apply(docs.where("doc_id is null or doc_id > 2"))) == truth(rest)  # two holders
    nulls = left.insert(spark.createDataFrame([(None, PASSAGE)], "doc_id long, text string"))
    three = docs.where("doc_id is null").unionByName(spark.createDataFrame([(None, PASSAGE)], "doc_id long, text string"))
    assert {r.n_dropped for r in nulls.apply(three).collect()} == {0} and nulls.shared().count() == 1
    gone = nulls.delete(spark.createDataFrame([(None,)], "doc_id long"))
    assert gone.shared().count() == 0 and gone.current().where("n_docs > 0").count() == 0
    assert gone.filters.where("n_keys > 0").count() == 0


def test_filters_grow_with_the_keys(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 20)
    text = lambda a, b: "\n".join(f"a line that three documents have, number {i}" for i in range(a, b))

    def docs(first, a, b):
        return spark.createDataFrame([(first + k, text(a, b)) for k in range(3)], "doc_id long, text string")

    index = line_dedup.LineIndex.build(docs(0, 0, 100))
    assert index.shards == 16
    small = index.insert(docs(10, 100, 290))  # filters that are full are made again
    assert small.shards == 16 and small.filters.agg(F.sum("n_keys")).first()[0] == 290
    large = small.insert(docs(20, 290, 900))
    assert large.shards == 64 and large.filters.agg(F.sum("n_keys")).first()[0] == 900
    for state, n in ((small, 290), (large, 900)):
        held = line_dedup.Filters((state.shards, line_dedup._collected(state.filters)))
        keys = line_dedup.keys_of(text(0, n).encode(), 20)[2]
        assert held.maybe(*line_dedup.halves(keys)).all()
        other = line_dedup.keys_of("\n".join(f"some other line of text, {i}" for i in range(5000)).encode(), 20)[2]
        assert held.maybe(*line_dedup.halves(other)).mean() < 0.01


def test_cuckoo_filter_deletes():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, (2, 3000), dtype=np.uint64)
    assert not line_dedup.CuckooFilter(1000).insert(*h)  # too small
    made = line_dedup.CuckooFilter.from_bytes(line_dedup.CuckooFilter.of(*h).to_bytes())
    assert made.contains(*h).all()
    made.delete(h[0, :2900], h[1, :2900])
    assert made.contains(h[0, 2900:], h[1, 2900:]).all() and made.contains(h[0, :2900], h[1, :2900]).mean() < 0.2
    full = line_dedup.CuckooFilter(3000)
    n = int(full.buckets * 4 * 0.9)
    more = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
    assert full.insert(*more) and full.contains(*more).all()


def jump(key, n):
    key, b, j = (key or 0) & (2**64 - 1), -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, odd, empty):
    many = odd.select("doc_id", "text").unionByName(spark.range(3000).select((F.col("id") * 977 - 10**6).alias("doc_id"), F.lit("t").alias("text")))
    rows = sharding.assign_shards(many, 40).collect()
    assert len(rows) == many.count()
    slots = collections.defaultdict(list)
    for r in rows:
        assert (r.shard, r.grown_shard) == (jump(r.doc_id, 40), jump(r.doc_id, 41)) and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    facts = {r.doc_id: (r.size, r.text_crc32) for r in sharding.assign_shards(odd, 40).collect()}
    for i, text, *_ in BASE:
        assert facts[i] == (len((text or "").encode()) + 16, zlib.crc32((text or "").encode()))
    assert sharding.assign_shards(empty, 40).count() == 0


def test_packing(odd, empty):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack(odd, TOKENIZER).collect()
    ids = {i: np.array(exact.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t, *_ in BASE}
    placed, own = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and len(part) == r.length
        placed[r.sequence_id].append((r.offset, r.length))
        own[r.doc_id].append((r.piece, r.start, r.length))
    for spans in placed.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    for i, spans in own.items():
        times = 2 if i == 10 else 1
        assert sum(s[2] for s in spans) == times * len(ids[i])
        assert all(length == 2048 or piece == 0 for piece, _, length in spans)
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_best_two_fit_improves_on_greedy():
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [([6, 2, 2], 1), ([3], 1)]
    rng = np.random.default_rng(3)
    counts = collections.Counter(int(x) for x in rng.integers(1, 2049, 20000))
    patterns = packing.best_two_fit(counts)
    used = collections.Counter()
    for lengths, times in patterns:
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] += times
    assert used == counts
    assert sum(t for _, t in patterns) <= 1.01 * -(-sum(k * n for k, n in counts.items()) // 2048)


def test_word_tokenizer_is_exact():
    from tokenizers import Tokenizer

    exact, fast = Tokenizer.from_file(TOKENIZER), packing.WordTokenizer(TOKENIZER)
    for text in ["a  b", " a", "a ", "a \n b", "\n\n x y  z", "don't  we'll 12 345", "é\x1c \x1cq", "x" * 500, "<|endoftext|> a", "日本 語\tok", *[t for _, t, *_ in BASE if t]]:
        assert np.frombuffer(fast.ids(text), "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids


def test_packing_holds_little_in_the_workers(odd):
    assert "ExistingRDD" not in packing.pack(odd, TOKENIZER)._jdf.queryExecution().toString()
    fast = packing.WordTokenizer(TOKENIZER)
    fast.ids("no special token")
    assert "exact" not in vars(fast)
    fast.ids("<|endoftext|>")
    assert "exact" in vars(fast)


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text).decode())
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(odd, empty):
    for r in simhash.near_duplicates(odd).collect():
        assert int(r.fingerprint, 16) in {plain_simhash(t) for i, t, *_ in BASE if i == r.doc_id}
        near = [j for j, t, *_ in BASE if j is not None and bin(plain_simhash(t) ^ int(r.fingerprint, 16)).count("1") <= 4]
        assert r.component_id == min(near, default=None) or len(near) > 1
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("chunk", [2048, 7])
def test_links_connect_all_that_is_near(spark, chunk):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = [int(s) for s in seeds]
    for s in seeds[:30]:
        x = int(s)
        for _ in range(12):  # chains of near fingerprints, and clusters
            x ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))
            fps.append(x)
    fps = sorted(set(fps))
    signed = [(int(np.uint64(x).view(np.int64)),) for x in fps]
    df = spark.createDataFrame(signed, "fp long")
    roots = {r.node: r.root for r in components.connected_components(simhash.links(df, chunk)).collect()}
    parent = dict(zip(fps, fps, strict=True))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in fps:
        for b in fps:
            if a < b and bin(a ^ b).count("1") <= 4:
                parent[find(a)] = find(b)
    mine = {x: roots.get(s[0], s[0]) for x, s in zip(fps, signed, strict=True)}
    for a in fps:
        for b in fps:
            assert (find(a) == find(b)) == (mine[a] == mine[b])


def test_components_of_a_long_chain_and_a_star(spark):
    rows = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[1000 + i] == 1000 for i in range(1, 50))


def test_no_join_of_simhash_broadcasts_more_than_spark_expects(spark, monkeypatch):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.sha1(F.col("id").cast("string")).alias("text"))
    docs = docs.union(docs.selectExpr("doc_id + 20000", "text"))
    monkeypatch.setattr("tracegrain.llm.common.BROADCAST_ROWS", 20_000)
    held = {"spark.sql.autoBroadcastJoinThreshold": "1m", "spark.sql.maxBroadcastTableSize": "16m"}  # 20,000 fingerprints have 500,000 keys
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = simhash.near_duplicates(docs).groupBy("component_id").count()
        assert found.where("count = 2 and component_id < 20000").count() == 20_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_mixing_targets(spark):
    rows = [("a", 100), ("b", 1000), (None, 10), ("c", 0)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    # 1665 to share by 3, 1, 2 and 3: a, c and null reach twice their size, b gets the rest
    assert got == {"a": 200.0, "b": pytest.approx(1445.0), "c": 0.0, None: 20.0}


def test_mixing(spark, odd, empty):
    text = F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int"))
    many = spark.range(6000).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"))
    rows = mixing.mix(many).collect()
    taken, aim = collections.Counter(), {}
    for r in rows:
        assert 0 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
        aim[r.source] = r.target
    assert len(rows) == 6000
    for source, target in aim.items():
        assert abs(taken[source] - target) <= 2
    assert collections.Counter(rows) == collections.Counter(mixing.mix(many).collect())
    assert mixing.mix(odd).count() == len(BASE) and mixing.mix(empty).count() == 0


def plain_targets(sizes, share=1.5, most=2.0):
    """Weights 3, 1, 2 in turn; what is above twice a source's size is shared again among those below."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {name: (3, 1, 2)[i % 3] for i, name in enumerate(names)}
    left, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[x] for x in free)
        over = {x for x in free if level * weight[x] > most * sizes[x]}
        if not over:
            return target | {x: level * weight[x] for x in free}
        target |= {x: most * sizes[x] for x in over}
        left -= sum(target[x] for x in over)
        free -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_those_of_sharing_again(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {f"s{i}": int(10 ** rng.uniform(0, 5)) for i in range(int(rng.integers(1, 12)))} | {None: int(rng.integers(0, 900))}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_flight_keeps_totals():
    import random

    rng = np.random.default_rng(1)
    p, size = rng.random(500), rng.integers(1, 90, 500)
    out = mixing.flight(p, size, random.Random(1))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())


@pytest.mark.parametrize("kind", ["equal chances", "mixed", "one large", "equal sizes", "one"])
def test_documents_are_included_as_often_as_their_chances_say(kind):
    import random

    rng = np.random.default_rng(2)
    n = {"one": 1}.get(kind, 14)
    size = {"one large": np.array([5000] + [3] * 13), "equal sizes": np.full(14, 7)}.get(kind, rng.integers(1, 90, n))
    p = np.full(n, 0.3) if kind in ("equal chances", "one") else rng.uniform(0.05, 0.95, n)
    draws = np.array([mixing.settle(p, size, random.Random(i)) for i in range(1500)])
    assert set(np.unique(draws)) <= {0.0, 1.0}
    assert np.abs(draws.mean(0) - p).max() < 4.5 * 0.5 / np.sqrt(len(draws))
    if kind == "mixed":  # and they are balanced: words miss the target by less than a document, drawn alone by much more
        assert np.abs(draws @ size - p @ size).max() <= size.max()
        assert np.abs(draws @ size - p @ size).mean() < 0.5 * np.sqrt((p * (1 - p)) @ size**2)


def test_small_sources_fly_and_large_documents_are_settled_first():
    import random

    rng = np.random.default_rng(3)
    size = np.ceil(rng.lognormal(4, 1.2, 300))  # up to thousands
    p = np.full(len(size), 0.4)
    missed = [abs(mixing.settle(p, size, random.Random(i)) @ size - p @ size) for i in range(20)]
    assert max(missed) <= 20
    few = np.array([5, 9, 2, 7, 30])
    draws = {tuple(mixing.settle(np.full(5, 0.5), few, random.Random(i))) for i in range(60)}
    assert len(draws) > 3


def test_mixing_over_seeds_and_of_equal_rows(spark):
    rows = [(i, "w " * (i % 9 + 1), "a") for i in range(30)] + [(100, "same words here", "b")] * 40 + [(200 + i, "x y", "c") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    taken = collections.Counter()
    for seed in range(12):
        out = mixing.mix(docs, seed=seed).collect()
        assert len(out) == len(rows)
        taken.update({r.doc_id: r.copies for r in out if r.source == "c"})
        target = {r.source: r.target for r in out}
        for source, aim in target.items():
            assert abs(sum(r.size * r.copies for r in out if r.source == source) - aim) <= 9
    share = target["c"] / 600
    assert len(set(taken.values())) > 1 and abs(np.mean(list(taken.values())) / 12 - share) < 0.02


def test_language_id(spark, odd, empty):
    words = {"en": "the thing is that this was with them ", "de": "und der schöne nicht für über das ", "fr": "être les était où ça qu'une très "}
    rows = [(n * 3 + i, (w * (n % 7 + 1)), lang, "s", 0, "", "", "", "", "") for n in range(80) for i, (lang, w) in enumerate(words.items())]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language_id.train(docs)
    got = language_id.identify(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    truth = {r[0]: r[2] for r in rows}
    assert all(r.lang_pred == truth[r.doc_id] and 0.5 < r.score <= 1 for r in got)
    odd_rows = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert all(odd_rows[i].lang_pred == "und" and odd_rows[i].score == 0 for i in (3, 4, 10, 12))
    assert odd_rows[8].lang_pred == "de" and odd_rows[None].held_out is False
    assert language_id.train(empty) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_code_lengths_are_those_of_the_tree(spark):
    import pandas as pd

    texts = {"a": [b"abracadabra", b"abrakadabra abra"], "b": [b"hocus pocus", b"hokus pokus"]}
    counted = [(lang, int(g), 1) for lang, own in texts.items() for t in own for g in language_id.grams(np.frombuffer(language_id.START + t, np.uint8))]
    frame = pd.DataFrame(counted, columns=["lang", "gram", "n"]).groupby(["lang", "gram"], as_index=False).sum()
    scorer = language_id.Model.fit(frame).scorer()

    def plain(text, lang):
        trees = [collections.defaultdict(collections.Counter) for _ in range(4)]
        for t in texts[lang]:
            d = language_id.START + t
            for i in range(3, len(d)):
                for k in range(4):
                    trees[k][d[i - k : i]][d[i]] += 1
        bits, d = 0.0, language_id.START + text
        for i in range(3, len(d)):
            for k in (3, 2, 1, 0, -1):
                if k < 0:
                    bits += 8
                    break
                seen = trees[k][d[i - k : i]]
                if not seen:
                    continue
                whole = sum(seen.values()) + len(seen)
                if d[i] in seen:
                    bits -= np.log2(seen[d[i]] / whole)
                    break
                bits -= np.log2(len(seen) / whole)
        return bits

    probe = [b"abra", b"pocus abra", b"\xff\x00zz", b"a" * 3]
    assert scorer.lengths(probe) == pytest.approx(np.array([[plain(t, "a"), plain(t, "b")] for t in probe]))


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(4)
    words = ["able", "bird", "cloud", "door", "east", "farm", "goat", "hill"]
    rows, marks = [], []
    for i in range(600):
        own = rng.choice(words, 30).tolist()
        bad = i % 5 == 0
        if bad:
            own[rng.integers(30)] = "vileword," if i % 2 else "Vilewords"
        rows.append((i, " ".join(own)))
        marks.append((i, int(i % 7 == 0), int(bad)) if i < 400 else (i, None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (9999, 1, 1), (None, 1, 1)], "doc_id long, low long, toxic long")
    chain = toxicity.train(docs, labels, ["low", "toxic"])
    got = {r.doc_id: r.p_toxic for r in toxicity.classify(docs, chain, ["low", "toxic"]).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(600))
    assert toxicity.classify(odd, chain, ["low", "toxic"]).count() == len(BASE)
    assert toxicity.train(empty, labels, ["low", "toxic"]) is None
    assert {r.p_toxic for r in toxicity.classify(odd, None, ["low", "toxic"]).collect()} == {0.0}
    assert toxicity.classify(empty, chain, ["low", "toxic"]).count() == 0


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(6)
    x = (rng.random((800, 6)) < 0.5).astype(np.float32)
    first = x[:, 0]
    second = np.where(rng.random(800) < 0.95, first, 1 - first)
    chain = toxicity.Chain(["a", "b"], {b"%d" % i: i for i in range(6)}).fit(x, np.column_stack([first, second]).astype(float), np.arange(800) % 3)
    assert len(chain.weights[1]) == 7 and chain.weights[1][6] > 0


def plain_features(text):
    """By the definition, a word at a time."""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\r\x0b\x0c" or (c.isascii() and not c.isalnum() and c.isprintable()):
            words += [word] if word else []
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    found = {w.encode() for w in words}
    out = set(found)
    for w in found:
        out |= {b"%d:%s" % (n, w[:n]) for n in (4, 5, 6) if len(w) >= n}
    raw = text.encode()
    counted = {
        b"capitals": sum(65 <= c <= 90 for c in raw) / len(raw),
        b"digits": sum(48 <= c <= 57 for c in raw) / len(raw),
        b"marks": sum(chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in raw) / len(raw),
        b"repeats": 1 - len(found) / len(words) if words else 0.0,
    }
    for name, share in counted.items():
        out |= {b":%s:%d:" % (name, i) for i, step in enumerate((0.02, 0.05, 0.1, 0.2, 0.4, 0.7)) if share >= step - 1e-12}
    return out


@pytest.mark.parametrize("text", ["A b-c, A! 12 naïve ÉTÉ", "same same same", "...", "word_word don't STOP 2024", "x" * 50])
def test_features_are_those_of_the_definition(text):
    assert toxicity.features(text.encode()) == plain_features(text)


def test_logistic_fit_is_at_the_least_loss():
    rng = np.random.default_rng(8)
    x = (rng.random((300, 5)) < 0.4).astype(np.float32)
    y = (rng.random(300) < 0.1 + 0.4 * x[:, 0]).astype(np.float32)
    positives = y.sum()
    odds = np.sqrt(max(1.0, (300 - positives) / positives))

    def loss(w, b):
        total = 0.0
        for row, mark in zip(x.astype(float), y, strict=True):
            z = float(row @ w + b)
            total += odds * np.log1p(np.exp(-z)) if mark else np.log1p(np.exp(z))
        return total / 300 + 1e-4 * float(w @ w)

    w, b = toxicity.fit_logistic(x, y)
    best = loss(w.astype(float), b)
    for i in range(5):
        for move in (-0.05, 0.05):
            other = w.astype(float)
            other[i] += move
            assert loss(other, b) > best
    assert loss(w.astype(float), b + 0.05) > best < loss(w.astype(float), b - 0.05)


def test_chain_is_that_of_the_definition():
    rng = np.random.default_rng(7)
    n, d = 240, 5
    x = (rng.random((n, d)) < 0.5).astype(np.float32)
    marks = np.column_stack([(rng.random(n) < 0.2 + 0.6 * x[:, i]).astype(float) for i in range(3)])
    marks[rng.random((n, 3)) < 0.1] = np.nan
    fold = np.arange(n) % toxicity.FOLDS
    vocabulary = {b"f%d" % i: i for i in range(d)}
    chain = toxicity.Chain(["a", "b", "c"], vocabulary).fit(x, marks, fold)
    seen = [list(row) for row in x]
    for i in range(3):
        def fit(rows):
            return toxicity.fit_logistic(np.array([seen[r] for r in rows], np.float32), np.array([marks[r, i] for r in rows], np.float32))

        known = [r for r in range(n) if not np.isnan(marks[r, i])]
        w, b = fit(known)
        np.testing.assert_allclose(chain.weights[i], w, atol=1e-4)
        assert abs(chain.biases[i] - b) < 1e-4
        models = [fit([r for r in known if fold[r] != k]) for k in range(toxicity.FOLDS)]
        for r in range(n):  # from the model that has not seen the document's fold
            w, b = models[fold[r]]
            seen[r] = [*seen[r], 1 / (1 + np.exp(-(sum(a * c for a, c in zip(seen[r], w, strict=True)) + b)))]
    sets = [{b"f%d" % i for i in range(d) if row[i]} | {b"unknown"} for row in x[:40]] + [set()]
    got = chain.score(sets)
    for row, own in zip(got, sets, strict=True):
        earlier = []
        for w, b in zip(chain.weights, chain.biases, strict=True):
            z = b + sum(float(w[vocabulary[f]]) for f in own if f in vocabulary) + sum(float(w[d + j]) * p for j, p in enumerate(earlier))
            earlier.append(1 / (1 + np.exp(-z)))
        np.testing.assert_allclose(row, earlier, atol=1e-5)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=x>Menu, one</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, of course, on this site.</p></div>
<article class="post"><h1>Head &amp; line</h1><p>First   paragraph,
with <b>bold, words</b> and a &lt;tag&gt; in it.<br>Next line<p>Unclosed second, with commas, and some length to it.
<ul><li>One item</li><li>Two</li></ul><aside>Aside, aside, aside text here</aside><figure><img src=a alt="x > y"><figcaption>Caption</figcaption></figure>
<div class=share-buttons><a>Share</a></div></article>
<section id="comments"><p>A reader comment, with commas, that is rather long, and longer still, yes.</p></section>
<div class="sidebar"><p>Related, links, and more of them, all here in the sidebar, yes indeed.</p></div><footer>Foot &copy;</footer></body></html>"""


def test_html_extraction(spark):
    want = "Head & line First paragraph, with bold, words and a <tag> in it. Next line Unclosed second, with commas, and some length to it. One item Two Caption"
    assert html_extract.extract(PAGE) == want
    assert html_extract.extract(None) == html_extract.extract("") == ""
    assert html_extract.extract("plain text only") == "plain text only"
    body = "<div id=wrap><div class=nav-links><a>Home, sweet</a></div><div class=content><p>%s</p><p>%s</p></div><div class=ad>Buy, now, this, thing!</div></div>"
    text = "A sentence, with commas, that goes on for a while, and then ends."
    assert html_extract.extract(body % (text, text)) == f"{text} {text}"
    assert html_extract.extract("<p " * 2000 + "<b>" * 3000 + text)
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, n_chars string")
    rows = html_extract.main_text(pages).collect()
    assert sorted((r.text, r.n_chars) for r in rows) == sorted([(want, len(want)), ("", 0), ("", 0), (want, len(want))])
    assert html_extract.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("names", ["class='layout with-sidebar'", "class='post has-comments'", "id='page' class='no-ads'"])
def test_wrappers_named_after_boilerplate_stay(names):
    text = "A sentence, with commas, that goes on for a while, and then ends."
    side = "<div class=sidebar><p>Related, links, and more of them, all here in the sidebar.</p></div>"
    assert html_extract.extract(f"<body><div {names}><p>{text}</p><p>{text}</p>{side}</div></body>") == f"{text} {text}"
    halves = f"<div {names}><p>{text}</p></div>"
    assert text in html_extract.extract(f"<body>{halves}{halves}</body>")


SENTENCE = "A sentence, with commas, that goes on for a while, and then ends."


@pytest.mark.parametrize("names", ["class='layout no-sidebar'", "class='page header-fixed'", "class='site menu-open'", "class='market-share'", "class='sidebar'"])
@pytest.mark.parametrize("tag", ["div", "form"])
def test_ancestors_of_prose_stay(names, tag):
    side = f"<div class=related-posts><p>{SENTENCE}</p></div><div class=discussion><p>{SENTENCE}</p></div><form><p>{SENTENCE}</p></form>"
    for container in ("article", "main"):
        page = f"<body><{tag} {names}><{container}><h1>Head</h1><p>{SENTENCE}</p><p>{SENTENCE}</p><p>{SENTENCE}</p>{side}</{container}></{tag}></body>"
        assert html_extract.extract(page) == f"Head {SENTENCE} {SENTENCE} {SENTENCE}"


@pytest.mark.parametrize(("name", "said"), [("cookie-notice", True), ("siteFooter", True), ("ads_300x250", True), ("comments-area", True), ("tags-explained", False), ("notice-board-history", False), ("ad-free", False), ("has-comments", False), ("entry-header", False), ("shared", False)])
def test_names_say_boilerplate_as_a_whole(name, said):
    page = f"<body><article><p>{SENTENCE}</p><p>{SENTENCE}</p><div class='{name}'><p>{SENTENCE}</p></div></article></body>"
    assert html_extract.extract(page).count(SENTENCE) == (2 if said else 3)


@pytest.mark.parametrize("page", ["<i>" * 20000 + "<h1>a</h1>" * 20000, "<b>" * 20000 + "</x>" * 20000, "<div>" * 20000 + f"<p>{SENTENCE}" * 5000, "<b><div>" + "<i>" * 20000 + "</b>" * 20000, "<ul>" + "<li><i>" * 20000])
def test_deep_and_unclosed_markup_is_read_in_time(page):
    import time

    began = time.time()
    text = html_extract.extract(page)
    assert time.time() - began < 20  # a walk up the whole page for each element takes minutes
    assert text.count(SENTENCE) == page.count(SENTENCE)


def plain_points(page):
    """(name, points) of the elements that a tree of well-formed markup gives points to, by the definition."""
    from html.parser import HTMLParser

    nodes = [{"name": "#root", "up": None, "parts": []}]

    class Tree(HTMLParser):
        at = 0

        def handle_starttag(self, tag, attrs):
            nodes.append({"name": tag, "up": self.at, "parts": []})
            nodes[self.at]["parts"].append(len(nodes) - 1)
            self.at = len(nodes) - 1

        def handle_endtag(self, tag):
            self.at = nodes[self.at]["up"]

        def handle_data(self, data):
            nodes[self.at]["parts"].append(data)

    Tree().feed(page)

    def prose(i, inside=False):
        """Length of the text of an element, and of that in links."""
        inside = inside or nodes[i]["name"] == "a"
        both = [(len(p.strip()), len(p.strip()) if inside else 0) if isinstance(p, str) else prose(p, inside) for p in nodes[i]["parts"]]
        return sum(b[0] for b in both), sum(b[1] for b in both)

    def own(i):
        """Text outside the blocks within."""
        return "".join(p if isinstance(p, str) else own(p) if nodes[p]["name"] in ("a", "b", "i") else "" for p in nodes[i]["parts"])

    start = {"article": 25, "main": 25, "div": 5, "section": 5, "blockquote": 3, "ul": -3, "#root": -50, "html": -50, "body": -5}
    points = {}
    for i, node in enumerate(nodes):
        text = own(i)
        if node["name"] in ("p", "li", "h2", "div", "section", "article", "main", "blockquote") and len(text.strip()) >= 25:
            worth, up = 1 + text.count(",") + min(len(text) / 100, 3), node["up"]
            for share in (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12):
                if up is not None:
                    points[up] = points.get(up, start.get(nodes[up]["name"], 0)) + worth * share
                    up = nodes[up]["up"]
    density = {i: prose(i)[1] / prose(i)[0] if prose(i)[0] else 0 for i in points}
    return sorted((nodes[i]["name"], round(p * (1 - density[i]), 9)) for i, p in points.items())


@pytest.mark.parametrize("seed", range(12))
def test_points_are_those_of_the_definition(seed):
    import random

    rng = random.Random(seed)
    words = "one, two three four, five six seven eight nine ten".split()

    def text(n):
        return " ".join(rng.choice(words) for _ in range(rng.randrange(n)))

    def inline(depth):
        return "".join(rng.choice([text(12), f" <b>{text(6)}</b> ", f" <a>{text(8)}</a> ", f" <i>{text(3)}<a>{text(3)}</a></i> "]) for _ in range(rng.randrange(1, 5)))

    def block(depth):
        name = rng.choice(["p", "p", "p", "div", "section", "article", "blockquote", "ul", "h2"] if depth < 6 else ["p"])
        if name in ("p", "h2"):
            return f"<{name}>{inline(depth)}</{name}>"
        if name == "ul":
            return "<ul>" + "".join(f"<li>{inline(depth)}</li>" for _ in range(rng.randrange(1, 4))) + "</ul>"
        return f"<{name}>" + (text(10) if name != "blockquote" else "") + "".join(block(depth + 1) for _ in range(rng.randrange(1, 5))) + f"</{name}>"

    page = "<html><body>" + "".join(block(0) for _ in range(12)) + "</body></html>"
    got = sorted((n.name, round(n.points, 9)) for n in html_extract.score(html_extract.parse(page)))
    assert got == plain_points(page) and got


def test_long_comments_do_not_displace_an_article():
    text = "A sentence, with commas, that goes on for a while, and then ends."
    comments = f"<section id=comments>{'<p>A reader comment, with commas, that is rather long, yes.</p>' * 20}</section>"
    assert html_extract.extract(f"<body><article><p>{text}</p></article>{comments}</body>") == text


def brute_search(ids, x, asked, k):
    """The best k ids for each of asked (id, vector): by its best rows, without its own."""
    out = {}
    for query_id, q in asked:
        best = out.setdefault(query_id, {})
        for i, score in zip(ids.tolist(), (x @ q).tolist(), strict=True):
            if i != query_id:
                best[i] = max(score, best.get(i, -np.inf))
    return {q: sorted(best.items(), key=lambda b: (-b[1], b[0]))[:k] for q, best in out.items()}


def found_by(rows):
    got = collections.defaultdict(list)
    for r in rows:
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    return {q: sorted(own) for q, own in got.items()}


def test_vector_search(spark, monkeypatch):
    """With cells and blocks so small that the coarse partition and the codes both leave out most rows."""
    monkeypatch.setattr(vector_search, "CELL_ROWS", 150)
    monkeypatch.setattr(vector_search, "RERANK_LEAST", 25)
    monkeypatch.setattr(vector_search, "BLOCK", 100)
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(40, 24))[rng.integers(40, size=3000)] + 0.6 * rng.normal(size=(3000, 24))).astype(np.float32)
    x[50:90] = x[50]  # more copies than are asked for
    x[120] = 0.0 * x[120] - 0.0
    rows = [(i, [float(v) for v in row], "c") for i, row in enumerate(x) if i != 120]
    odd = [(5000, None, "c"), (5001, [0.0] * 24, "c"), (5002, [float("nan")] * 24, "c"), (5003, [1.0, None] + [0.5] * 22, "c"), (5004, [1.0] * 3, "c"), (None, [1.0] * 24, "c"), (5006, [float("inf")] * 24, "c")]
    again = [(60, [float(v) for v in x[60]], "c"), (61, [float(v) for v in x[9]], "c"), (200, [float(v) for v in x[200]], "c"), (200, [float(v) for v in x[900]], "c")]
    df = spark.createDataFrame(rows + odd + again, "vec_id long, embedding array<float>, rank string")
    got = found_by(vector_search.search(df, df.where("vec_id % 100 = 0 or vec_id in (60, 61) or vec_id > 4999"), 20).collect())
    known = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows + again]
    want = brute_search(np.array([i for i, _ in known]), np.stack([v for _, v in known]), [k for k in known if k[0] % 100 == 0 or k[0] in (60, 61)], 20)
    assert set(got) == set(want)
    hit = 0
    for q, own in got.items():
        assert [r for r, *_ in own] == list(range(1, 21)) and [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        exact = dict(want[q])
        hit += sum(v in exact and abs(s - exact[v]) < 1e-9 for _, v, s in own)
    assert hit >= 0.95 * 20 * len(got)
    assert [v for _, v, _ in got[60]][:18] == [v for v, _ in want[60]][:18]
    few = df.where("vec_id < 5")
    assert vector_search.search(few, few, 20).count() == 20
    assert vector_search.search(df.limit(0), df.limit(0), 20).count() == 0


def test_units_and_sets_of_queries_lose_nothing(spark, monkeypatch):
    """One cell in many units and many sets, every row of a block reranked: exactly what brute force gives."""
    monkeypatch.setattr(vector_search, "UNIT_BYTES", 8 * 6 * 90)
    monkeypatch.setattr(vector_search, "BLOCK", 40)
    monkeypatch.setattr(vector_search, "QUERIES", 7)
    monkeypatch.setattr(vector_search, "HELD", 12)
    monkeypatch.setattr(vector_search, "RERANK_LEAST", 1000)
    rng = np.random.default_rng(14)
    x = rng.integers(-3, 4, size=(700, 6)).astype(float)  # many ties and copies
    x[~x.any(1)] = 1.0
    df = spark.createDataFrame([(i, row.tolist(), 0) for i, row in enumerate(x)], "vec_id long, embedding array<double>, cell int")
    shorter = spark.createDataFrame([(9000 + i, [1.0, 2.0], 0) for i in range(650)], "vec_id long, embedding array<double>, cell int")
    df = df.unionByName(shorter)
    got = found_by(vector_search.search(df, df.where("vec_id % 10 = 0"), 9).collect())
    want = brute_search(np.arange(700), x, [(i, x[i]) for i in range(0, 700, 10)], 9)
    assert {q: [(v, s) for _, v, s in own] for q, own in got.items()} == want


def test_queries_unlike_the_rows_miss_nothing(spark, monkeypatch):
    """Rows in tight clusters, queries anywhere: neither cells nor codes that were fitted to the rows fit the queries."""
    monkeypatch.setattr(vector_search, "CELL_ROWS", 100)
    monkeypatch.setattr(vector_search, "RERANK_LEAST", 25)
    rng = np.random.default_rng(16)
    x = rng.normal(size=(60, 24))[rng.integers(60, size=3000)] + 0.2 * rng.normal(size=(3000, 24))
    x[::50] = rng.normal(size=(60, 24))
    x[1::7] *= np.exp(rng.normal(size=(429, 1)))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = found_by(vector_search.search(df, df.where("vec_id % 50 = 0"), 20).collect())
    want = brute_search(np.arange(3000), x, [(i, x[i]) for i in range(0, 3000, 50)], 20)
    assert {q: [v for _, v, _ in own] for q, own in got.items()} == {q: [v for v, _ in own] for q, own in want.items()}


def test_wide_vectors_bound_the_sample(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "SAMPLE_BYTES", 8 * 32 * 64)
    monkeypatch.setattr(vector_search, "CELL_ROWS", 50)
    rng = np.random.default_rng(15)
    x = rng.normal(size=(5, 32))[rng.integers(5, size=600)] + 0.1 * rng.normal(size=(600, 32))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    seen = []
    fit = vector_search.Cells.fit.__func__
    monkeypatch.setattr(vector_search.Cells, "fit", classmethod(lambda cls, train, cells, k: seen.append((len(train), cells)) or fit(cls, train, cells, k)))
    got = found_by(vector_search.search(df, df.where("vec_id % 100 = 0"), 10).collect())
    assert seen == [(64, 4)]
    want = brute_search(np.arange(600), x, [(i, x[i]) for i in range(0, 600, 100)], 10)
    assert sum(v in dict(want[q]) for q, own in got.items() for _, v, _ in own) >= 0.9 * 60


def test_a_vector_that_most_rows_share(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CELL_ROWS", 100)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(900, 8))
    x[:600] = x[0]
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)] + [(0, x[0].tolist())] * 30, "vec_id long, embedding array<double>")
    got = found_by(vector_search.search(df, df.where("vec_id % 20 = 0"), 20).collect())
    assert set(got) == set(range(0, 900, 20))
    for q in range(0, 600, 20):
        assert [v for _, v, _ in got[q]] == [v for v, _ in brute_search(np.arange(900), x, [(q, x[q])], 20)[q]]


def test_cells_are_visited_as_the_sample_needs():
    rng = np.random.default_rng(13)
    tight = rng.normal(size=(64, 16))[rng.integers(64, size=6000)] + 0.05 * rng.normal(size=(6000, 16))
    loose = rng.normal(size=(6000, 16))
    assert vector_search.Cells.fit(tight, 64, 20).visits < 12 < vector_search.Cells.fit(loose, 64, 20).visits
    assert vector_search.Cells.fit(loose[:3], 64, 20).visits <= 3


def test_equal_vectors_take_one_place_in_the_rerank():
    rng = np.random.default_rng(10)
    n, k = 8192, 20
    x = rng.normal(size=(n, 16))
    q = rng.normal(size=16)
    ids = rng.permutation(n).astype(np.int64)
    copies = rng.choice(n, n // 3, replace=False)
    order = np.argsort(-(x @ q))
    x[copies] = x[order[10]]  # more of them than are reranked
    books = vector_search.Codebooks.fit(x[:2000])
    block = vector_search.Block(ids, x, books.pack(books.encode(x)))
    assert len(copies) > block.most
    for query_id in (-1, int(ids[copies].min())):
        got, scores = block.nearest(query_id, q, block.near(books.tables(q[None]))[0], k)
        others = ids != query_id
        exact = (x * q).sum(1)
        best = np.lexsort((ids[others], -exact[others]))[:k]
        assert got.tolist() == ids[others][best].tolist()
        assert scores == pytest.approx(exact[others][best])


def test_rows_tied_at_the_cut_are_all_reranked():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 8))
    books = vector_search.Codebooks.fit(x)
    q = rng.normal(size=8)
    block = vector_search.Block(np.arange(4000), x, np.zeros((4000, 2), np.uint8))  # one code for all
    got, _ = block.nearest(-1, q, block.near(books.tables(q[None]))[0], 20)
    assert got.tolist() == np.argsort(-(x * q).sum(1))[:20].tolist()


def test_anisotropic_codes_lower_the_parallel_error():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 16))
    books = vector_search.Codebooks.fit(x)
    codes = books.encode(x)
    flat = np.stack([((x[:, 2 * s : 2 * s + 2][:, None] - books.words[s]) ** 2).sum(2).argmin(1) for s in range(8)], 1)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def parallel(c):
        made = np.concatenate([books.words[s][c[:, s]] for s in range(8)], 1)
        return float((((x - made) * unit).sum(1) ** 2).mean())

    assert parallel(codes) < parallel(flat)
    q = rng.normal(size=16)
    packed, table = books.pack(codes), books.tables(q[None])[0]
    made = np.concatenate([books.words[s][codes[:, s]] for s in range(8)], 1)
    assert sum(table[j][packed[:, j]] for j in range(4)) == pytest.approx(made @ q, rel=1e-3, abs=1e-3)


def brute_tokens(text):
    from tokenizers import Tokenizer

    if not hasattr(brute_tokens, "made"):
        brute_tokens.made = Tokenizer.from_file(TOKENIZER)
    return len(brute_tokens.made.encode(text, add_special_tokens=False).ids)


PIECES = ["a", "The", " the", " ", "  ", "\n", "\t", "'", "'re", "'ll", "é", "ß", "日", "1", "23", "!", "!!", "<|endoftext|>", "<|end", "ing", "\x1c", "\xa0", "́", "😀", "don't"]


def test_token_counts_of_every_prefix():
    known = token_counts.Vocabulary(TOKENIZER)
    rng = np.random.default_rng(2)
    for _ in range(250):
        text = "".join(rng.choice(PIECES, rng.integers(0, 12)).tolist())
        want = [brute_tokens(text[:i]) for i in range(len(text) + 1)]
        made = token_counts.Prefixes(known, text)
        assert [made.count(i) for i in range(len(text) + 1)] == want and known.count(text) == want[-1], text
        for budget in range(6):
            assert made.longest(budget) == max(i for i, n in enumerate(want) if n <= budget), (text, budget)


def test_token_counts_follow_the_library(odd, empty, monkeypatch):
    monkeypatch.setattr(token_counts, "SLICE", 100)
    known = token_counts.Vocabulary(TOKENIZER)
    long = "x" * 5000 + " word\n\n  and more'" * 300
    assert known.count(long) == brute_tokens(long)
    monkeypatch.undo()
    got = collections.Counter(map(tuple, token_counts.count(odd, TOKENIZER, 1024).collect()))
    want = collections.Counter((i, len((t or "").encode()), brute_tokens(t or ""), brute_tokens(t or "") > 1024) for i, t, *_ in BASE)
    assert got == want and any(k[3] for k in want)
    assert token_counts.count(empty, TOKENIZER).count() == 0
    cut = {r.doc_id: r for r in token_counts.truncate(odd, TOKENIZER, 7).collect()}
    assert all(r.n_kept == brute_tokens(r.text) <= 7 for r in cut.values()) and LONG.startswith(cut[5].text) and brute_tokens(LONG[: len(cut[5].text) + 1]) > 7
    tables = token_counts.prefix_tables(odd, TOKENIZER).collect()
    assert len(tables) == len(BASE) and all(len(r.starts) == len(r.before) for r in tables)


def test_small_caches_give_the_same_counts(monkeypatch):
    for name in ("UNITS_KEPT", "PREFIXES_KEPT", "PAIRS_KEPT"):
        monkeypatch.setattr(token_counts, name, 3)
    known = token_counts.Vocabulary(TOKENIZER)
    for _, text, *_ in BASE:
        assert known.count(text or "") == brute_tokens(text or "")


TURNS = [
    *[(0, t, "user", f"t{t}") for t in range(4)],
    *[(c, t, "user", f"own {t if t < 3 else c}") for c in range(1, 40) for t in range(8)],
    *[(200, 1, None, None), (200, None, "b", "first"), (200, 1, None, None), (200, 1, "a", "é"), (200, 1, "a", "b")],
    *[(250, t, "user", "x") for t in range(3)],
    *[(251, t, "user", "x") for t in range(3)],
    (777, 0, "user", "alone"),
    (None, 0, "user", "nobody's"),
    (-105, 0, "user", "negative"),
]


def brute_trie(rows):
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    said = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        paths[c] = said.get(base, [])[:h] + own[h:]
    nodes = collections.defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    out = set()
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in nodes)]
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(node))
        out.add((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), sum(len(n) == len(node) + 1 for n in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_prefix_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 8)  # ends in many chunks
    schema = "conv_id long, turn long, role string, text string, depth string, len string, conv string, x1 string"
    rows = spark.createDataFrame([(*r, "d", "l", "c", "x") for r in TURNS], schema).repartition(5)
    got = [tuple(r) for r in prefix_trie.prefix_trie(rows).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_trie(TURNS)
    assert prefix_trie.prefix_trie(rows.limit(0)).count() == 0


def test_running_totals_go_on_from_range_to_range(spark):
    rng = np.random.default_rng(7)
    keys = np.sort(np.concatenate([np.zeros(700, np.int64), rng.integers(1, 9, 300)]))  # one key over many ranges
    rows = [(int(k), i, int(v), int(w)) for i, (k, v, w) in enumerate(zip(keys, rng.integers(-9, 9, 1000), rng.integers(-(2**62), 2**62, 1000), strict=True))]
    df = spark.createDataFrame(rows, "k long, i int, v long, w long").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.i: (r.number, r.v, r.w) for r in common.running(df, [F.col("k"), F.col("i")], by="k", sums=("v",), xors=("w",)).collect()}
        whole = {r.i: r.number for r in common.running(df, [F.desc("v"), F.col("i")]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, n, total, x, last = {}, 0, 0, 0, None
    for k, i, v, w in rows:
        n, total, x = (n + 1, total + v, x ^ w) if k == last else (1, v, w)
        last, want[i] = k, (n, total, x)
    assert got == want
    assert whole == {i: n for n, (_, i) in enumerate(sorted((-v, i) for _, i, v, _ in rows), 1)}
    assert common.running(df.limit(0), [F.col("k")], by="k", sums=("v",)).count() == 0


def brute_resample(docs, target, longest, buckets):
    import math

    def features(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return ws, [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]

    at = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(at(f) for _, t in docs for f in features(t)[1])
    t = collections.Counter(at(f) for x in target for f in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        ws, fs = features(text)
        weight = sum(gain[at(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(ws), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    drawn = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for n, r in enumerate(drawn[: 30 * len(drawn) // 100], 1):
        r[5] = n
    return sorted(map(tuple, out), key=repr)


def test_importance_resampling(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(importance, "SLICE", 64)
    rng = np.random.default_rng(3)
    vocabulary = ["Wörter", "a1", "be", "日本", "x_y", "THE", "the", "12", "née"]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60)).tolist())) for i in range(150)] + [(7, "the " * 30), (7, "the " * 30), (None, "word " * 25), (900, None), (901, "x" * 500 + " y" * 30)]
    target = ["the be the be a1", "Wörter 日本", None]
    df = spark.createDataFrame([(*d, "w", "s") for d in docs], "doc_id long, text string, weight string, score string").repartition(4)
    want_df = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for longest, buckets in ((1, 50), (3, 997)):
        got = importance.resample(df, want_df, longest, buckets, percent=30)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_resample(docs, target, longest, buckets)
    totals = lambda most: {r.bucket: r.n for r in importance.bucket_totals(df, 2, 97, most_nodes=most).collect()}
    assert totals(5) == totals(10**6)  # tries that are emptied often
    assert importance.resample(empty, want_df).count() == 0
    assert importance.resample(df, want_df.limit(0)).where("rank is not null").count() > 0
    assert importance.resample(odd, want_df).count() == len(BASE)


PROSE = [
    "The committee met on Tuesday, and after a long debate, which nobody had expected, it put off the vote until the spring of the next year.",
    "Several members said, in the corridor and later to the press, that the figures were not yet complete, and that no one could decide on such grounds.",
    "A spokesman for the other side, who had waited outside, called this a pretext, and announced that they would go to court before the month was over.",
]


@pytest.mark.parametrize(
    "wrap",
    [
        lambda ps: "".join(f'<div class="row"><div class="col"><p>{p}</p></div></div>' for p in ps),
        lambda ps: "".join(f"<section><div><div><p>{p}</p></div></div></section>" for p in ps),
        lambda ps: "<table>" + "".join(f"<tr><td>{p}</td></tr>" for p in ps) + "</table>",
        lambda ps: "<div><div>" + "".join(f'<div class="block"><div><p>{p}</p></div></div>' for p in ps) + "</div></div>",
    ],
)
def test_split_articles_stay_whole(wrap):
    menu = '<div class="col"><ul>' + "".join(f'<li><a href="/{i}">Section number {i} of the paper</a></li>' for i in range(8)) + "</ul></div>"
    page = f"<html><body><nav>{menu}</nav><div class='row'>{menu}</div>{wrap(PROSE)}<footer><p>Copyright, all rights reserved, and so on and so forth.</p></footer></body></html>"
    assert html_extract.extract(page) == " ".join(PROSE)
