"""Which names hold a string, without reading all names: LIKE '%q%' over trigrams.

`grams` (gram, name) has a row for each three characters of a distinct lower-cased
name, and one with an empty gram for the name itself, sorted by gram.  A pattern's
parts between wildcards give the grams that a name must have; the names that have
all are held against the whole pattern.  A pattern without three characters in a row
reads the empty gram's rows, which are all names, once each.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 3
GRAMS = "gram string, name string"


def grams_of(symbols: DataFrame, name_col: str = "symbol_name") -> DataFrame:
    """GRAMS of the distinct names."""
    name = F.lower(F.col(name_col)).alias("name")
    names = symbols.where(F.col(name_col).isNotNull()).select(name).distinct()
    places = F.when(F.char_length("name") >= SIZE, F.sequence(F.lit(1), F.char_length("name") - SIZE + 1)).otherwise(F.array().cast("array<int>"))
    own = F.transform(places, lambda i: F.substr(F.col("name"), i, F.lit(SIZE)))
    return names.select(F.explode(F.array_distinct(F.concat(F.array(F.lit("")), own))).alias("gram"), "name")


def write(symbols: DataFrame, path: str, name_col: str = "symbol_name") -> None:
    grams_of(symbols, name_col).repartitionByRange("gram", "name").sortWithinPartitions("gram", "name").write.parquet(path)


def like(query: str) -> str:
    """The pattern of a query: anywhere in the name, lower-cased; % and _ of the query are wildcards."""
    return "%" + query.lower().replace("\\", "\\\\") + "%"


def wanted(query: str) -> list[str]:
    """The grams that a name must have."""
    parts = re.split("[%_]", query.lower())
    return sorted({p[i : i + SIZE] for p in parts for i in range(len(p) - SIZE + 1)})


def candidates(grams: DataFrame, query: str) -> DataFrame:
    """name of those that have all grams of a query; only these are held against it."""
    need = wanted(query)
    if not need:
        return grams.where(F.col("gram") == "").select("name").distinct()
    met = grams.where(F.col("gram").isin(need)).distinct()  # parts of an index may repeat a name
    return met.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") == len(need)).select("name")


def matching(grams: DataFrame, query: str) -> DataFrame:
    """name of the distinct lower-cased names that hold the query."""
    return candidates(grams, query).where(F.col("name").like(like(query)))


def holds(name: Column, query: str) -> Column:
    return F.lower(name).like(like(query))
