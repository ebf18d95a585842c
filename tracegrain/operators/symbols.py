"""Search by symbol: names at HEAD, names in history, and attribution of hunks to symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracegrain.functions import text as T

from . import fulltext, trigrams

#: What kinds of attribution count, and how they rank.
ATTRIBUTION_SIMILARITY = {"exact_span": 1.0, "hunk_header": 0.6, "file_fallback": 0.3}


def attribution_rank(kind):
    out = F.lit(3)
    for i, name in enumerate(ATTRIBUTION_SIMILARITY):
        out = F.when(kind == name, F.lit(i)).otherwise(out)
    return out


def head_symbol_hunks(index: fulltext.TextIndex, symbols: DataFrame, hunks: DataFrame, query: str, k: int, lenient: bool = False) -> DataFrame:
    """hunk_id, score: hunks of the files whose HEAD symbols match, best first.

    The best score of a file is found before the join, so the fan-out is one
    row a hunk rather than one for each symbol and hunk.
    """
    best = fulltext.search(index, query, lenient).join(symbols.select(F.col("symbol_id").alias("doc_id"), "file_path"), "doc_id").groupBy("file_path").agg(F.min("score").alias("score"))
    return hunks.select("hunk_id", "file_path").join(best, "file_path").groupBy("hunk_id").agg(F.min("score").alias("score")).orderBy("score", "hunk_id").limit(k)


def historical_symbol_hunks(hunk_symbols: DataFrame, commits_of: DataFrame, query: str, k: int, grams: DataFrame | None = None) -> DataFrame:
    """hunk_id, similarity, ord: hunks with a symbol whose name holds the whole query, lower-cased.

    % and _ of the query are wildcards, as LIKE has them.  The limit comes
    before a hunk's rows are reduced to its first, so fewer than k may be left.
    commits_of: hunk_id, ts; grams: trigrams.GRAMS of the names, if there are any.
    """
    if grams is None:
        named = hunk_symbols.where(trigrams.holds(F.col("symbol_name"), query))
    else:
        names = trigrams.matching(grams, query)
        named = hunk_symbols.join(names, F.lower("symbol_name") == names["name"], "left_semi")
    hits = named.join(commits_of, "hunk_id")
    rank = attribution_rank(F.col("attribution_kind"))
    top = hits.select("hunk_id", "symbol_name", "attribution_kind", "ts", rank.alias("rank")).orderBy("rank", F.desc("ts"), "hunk_id", "symbol_name").limit(k)
    place = F.row_number().over(Window.orderBy("rank", F.desc("ts"), "hunk_id", "symbol_name"))  # of k rows at most
    similarity = F.lit(0.3)
    for name, value in ATTRIBUTION_SIMILARITY.items():
        similarity = F.when(F.col("attribution_kind") == name, F.lit(value)).otherwise(similarity)
    return top.withColumn("ord", place).groupBy("hunk_id").agg(F.min("ord").alias("ord"), F.min_by(similarity, F.col("ord")).alias("similarity"))


#: Pairs of hunks and symbols that a task makes, about, and the parts that a file's hunks are dealt to at most.
PAIRS, MOST_PARTS = 2_000_000, 4096


def live_attribution(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every symbol of a hunk's file, as exact: hunk_id, symbol_kind, symbol_name, attribution_kind.

    Both sides are made distinct before they meet, so that the pairs of a hunk that has
    one file are too and are not shuffled.  A file with more than PAIRS of them is dealt to many tasks.
    """
    files = hunks.where("file_path is not null").groupBy("hunk_id").agg(F.collect_set("file_path").alias("files"))
    named = symbols.where("file_path is not null").select("file_path", F.col("kind").alias("symbol_kind"), F.col("name").alias("symbol_name")).distinct()
    counted = hunks.groupBy("file_path").agg(F.count("*").alias("n")).join(named.groupBy("file_path").agg(F.count("*").alias("m")), "file_path")
    pairs = F.col("n").cast("double") * F.col("m")
    parts = counted.select("file_path", F.least(F.ceil(pairs / PAIRS), "n", F.lit(MOST_PARTS)).cast("int").alias("parts"))
    dealt = named.join(parts, "file_path").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    more = parts.agg(F.sum(F.col("parts") - 1)).first()[0] or 0
    tasks = int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions")) + min(more, MOST_PARTS)

    def met(owned: DataFrame) -> DataFrame:
        at = owned.join(parts, "file_path").withColumn("part", F.pmod(F.xxhash64("hunk_id"), "parts").cast("int")).drop("parts")
        # so many partitions in any case: few rows go in, and very many come out
        left, right = (x.repartition(tasks, "file_path", "part") for x in (at, dealt))
        return left.join(right.hint("merge"), ["file_path", "part"]).select("hunk_id", "symbol_kind", "symbol_name")

    alone = met(files.where(F.size("files") == 1).select("hunk_id", F.col("files")[0].alias("file_path")))
    several = met(files.where(F.size("files") > 1).select("hunk_id", F.explode("files").alias("file_path"))).distinct()
    return alone.unionByName(several).withColumn("attribution_kind", F.lit("exact_span"))


#: Lines of the narrowest bucket, how much wider each level is, and the number of levels.
NARROW, WIDER, LEVELS = 64, 16, 7


def _bucketed(rows: DataFrame, start: str, end: str, wider: int | None) -> DataFrame:
    """rows with width and bucket, once for each bucket of their own level that they touch; or of all levels from `wider` above it on.

    Their own level is the narrowest that has a bucket as long as they are.
    """
    lo, hi = F.least(start, end).cast("long"), F.greatest(start, end).cast("long")
    level = F.lit(LEVELS - 1)
    for j in reversed(range(LEVELS - 1)):
        level = F.when(hi - lo < NARROW * WIDER**j, F.lit(j)).otherwise(level)
    levels = F.array(level) if wider is None else F.filter(F.array(*[F.lit(j) for j in range(LEVELS)]), lambda j: j >= level + wider)
    at = rows.where(lo.isNotNull()).withColumn("level", F.explode(levels))
    width = F.element_at(F.array(*[F.lit(NARROW * WIDER**j) for j in range(LEVELS)]), F.col("level") + 1).cast("long")
    return at.withColumn("width", width).withColumn("bucket", F.explode(F.sequence(F.floor(lo / F.col("width")), F.floor(hi / F.col("width"))))).drop("level")


def overlapping(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left (key, s, e) and right (key, line_start, line_end) of one key that share a line: each pair once.

    Two intervals meet at the level of the longer one, in the bucket where their
    overlap begins: either the left one at its own level, or the right one where
    that is wider.  So the work follows the pairs found and not those of a key, and
    a key with very many intervals is as many groups as it has buckets.
    """
    begins = F.greatest(F.least("s", "e"), F.least("line_start", "line_end")).cast("long")

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        # neither side is broadcast: Spark's sizes leave out how many buckets a row has
        pairs = a.join(b.hint("merge"), [key, "width", "bucket"]).where("line_start <= e and s <= line_end")
        return pairs.where(F.floor(begins / F.col("width")) == F.col("bucket")).drop("width", "bucket")

    def sides(ours: int | None, theirs: int | None) -> DataFrame:
        return met(_bucketed(left, "s", "e", ours), _bucketed(right, "line_start", "line_end", theirs))

    return sides(None, 0).unionByName(sides(1, None))


def attribute(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols whose lines a hunk changes, and else those its headers name.

    hunks: hunk_id, file_path, diff_text; symbols: file_path, kind, name,
    line_start, line_end.  A name found both ways is exact.  Spans that repeat
    are one before they meet.
    """
    ranges = hunks.select("hunk_id", "file_path", F.explode(T.post_image_ranges(F.col("diff_text"))).alias("r"))
    changed = ranges.select("hunk_id", "file_path", F.col("r.start").alias("s"), (F.col("r.start") + F.col("r.count") - 1).alias("e"))
    spans = symbols.select("file_path", "kind", "name", "line_start", "line_end").distinct()
    exact = overlapping(changed, spans, "file_path").select("hunk_id", F.col("kind").alias("symbol_kind"), F.col("name").alias("symbol_name"), F.lit("exact_span").alias("attribution_kind"))
    named = hunks.select("hunk_id", F.explode(T.header_suffixes(F.col("diff_text"))).alias("suffix")).select("hunk_id", T.header_symbol(F.col("suffix")).alias("s")).where("s is not null")
    header = named.select("hunk_id", F.col("s.kind").alias("symbol_kind"), F.col("s.name").alias("symbol_name"), F.lit("hunk_header").alias("attribution_kind"))
    both = exact.unionByName(header)
    return both.groupBy("hunk_id", "symbol_kind", "symbol_name").agg(F.min("attribution_kind").alias("attribution_kind"))


#: Which kind stands for a span that two patterns name.
SPAN_KINDS = ("method", "class", "function", "const")


#: Languages whose patterns never name a span twice, and all of whose symbols stay.
EACH_STAYS = ("rust", "java")


def dedup_spans(symbols: DataFrame) -> DataFrame:
    """One symbol for each span of a file: methods and classes before functions; with a language, all of EACH_STAYS."""
    order = F.lit(len(SPAN_KINDS))
    for i, kind in enumerate(SPAN_KINDS):
        order = F.when(F.col("kind") == kind, F.lit(i)).otherwise(order)
    first = F.row_number().over(Window.partitionBy("file_path", "span_start", "span_end").orderBy(order, "name"))
    stays = F.coalesce(F.col("language").isin(*EACH_STAYS), F.lit(False)) if "language" in symbols.columns else F.lit(False)
    return symbols.withColumn("__n", first).where((F.col("__n") == 1) | stays).drop("__n")


def symbols_by_hunk(hits: DataFrame, hunk_symbols: DataFrame) -> DataFrame:
    """hits with the ordered names of their symbols; an empty list where there are none."""
    rank = attribution_rank(F.col("attribution_kind"))
    own = hunk_symbols.groupBy("hunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col("symbol_name").alias("n")))), lambda x: x["n"]).alias("related_head_symbols"))
    return hits.join(own, "hunk_id", "left").withColumn("related_head_symbols", F.coalesce("related_head_symbols", F.array().cast("array<string>")))
