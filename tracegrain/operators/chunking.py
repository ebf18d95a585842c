"""Merging neighbouring symbols of a file into chunks, and embedding texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

MAX_TOKENS = 500
#: Texts that an embedder gets at a time, at most.
AT_ONCE = 256
CHUNK_SCHEMA = "file_path string, kind string, name string, sibling_names array<string>, span_start int, span_end int, tokens int"


def chunk_symbols(symbols: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Symbols (file_path, kind, name, span_start, span_end, n_chars) merged, in order, while the tokens allow.

    A fold over a file's symbols, which depends on their order; files are
    groups, so the symbols of one file are in memory at a time.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in pdf.sort_values(["span_start", "span_end", "name"], kind="stable").itertuples():
            size = int(r.n_chars) // 4
            if out and out[-1][6] + size <= max_tokens:
                out[-1][3].append(r.name)
                out[-1][5], out[-1][6] = r.span_end, out[-1][6] + size
            else:
                out.append([r.file_path, r.kind, r.name, [], r.span_start, r.span_end, size])
        return pd.DataFrame(out, columns=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

    return symbols.groupBy("file_path").applyInPandas(fold, CHUNK_SCHEMA)


def hashing_embedder(texts: pd.Series, dim: int) -> list[np.ndarray]:
    """Unit vectors of hashed byte trigrams: a stand-in for a model, the same everywhere."""
    out = []
    for text in texts:
        raw = np.frombuffer((text or "").lower().encode(), np.uint8).astype(np.uint64)
        h = (raw[:-2] << np.uint64(16) | raw[1:-1] << np.uint64(8) | raw[2:]) + np.uint64(1)
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        signs = np.where(h & np.uint64(1 << 20), 1.0, -1.0)
        v = np.bincount((h % np.uint64(dim)).astype(np.int64), weights=signs, minlength=dim).astype(np.float32)
        norm = float(np.linalg.norm(v))
        out.append(v / norm if norm else v)
    return out


def embed(rows: DataFrame, text_col: str = "text", dim: int = 384, embedder=hashing_embedder) -> DataFrame:
    """rows with diff_emb; the embedder gets (texts, dim), as many as Arrow's batches have but AT_ONCE at most, and gives a vector of dim for each."""
    schema = StructType([*rows.schema, StructField("diff_emb", ArrayType(FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (whole.iloc[i : i + AT_ONCE] for whole in batches for i in range(0, len(whole), AT_ONCE)):
            made = embedder(pdf[text_col], dim)
            if len(made) != len(pdf) or any(len(v) != dim for v in made):
                raise ValueError(f"an embedder gave {len(made)} vectors for {len(pdf)} texts, or one that has not {dim} numbers")
            yield pdf.assign(diff_emb=[np.asarray(v, np.float32) for v in made])

    return rows.mapInPandas(run, schema)


def embed_missing(inputs: DataFrame, cache: DataFrame, model: str, text_col: str = "text", dim: int = 384, embedder=hashing_embedder) -> tuple[DataFrame, DataFrame]:
    """Inputs with vectors, each distinct text embedded once, and the new rows of the cache."""
    from .tables import cache_lookup

    met, todo = cache_lookup(inputs, cache, model, text_col)
    fresh = embed(todo, "text", dim, embedder).select("content_hash", F.lit(model).alias("embed_model"), "diff_emb")
    filled = met.join(fresh.select("content_hash", F.col("diff_emb").alias("__new")), "content_hash", "left")
    return filled.withColumn("diff_emb", F.coalesce("diff_emb", "__new")).drop("__new"), fresh
