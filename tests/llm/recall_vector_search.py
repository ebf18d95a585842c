"""Recall of the vector search against brute force, where cells and codes both leave out rows.

    python tests/llm/recall_vector_search.py [rows] [parquet of embeddings]

Prints, for each kind of vectors, the recall of 20 nearest of 400 queries, the
cells visited and the share of rows whose products are computed exactly.
"""

import os
import sys
import tempfile

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
os.environ["PYTHONPATH"] = sys.path[0]

import pyarrow as pa  # noqa: E402
import pyarrow.parquet as pq  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from tracegrain.llm import vector_search  # noqa: E402


def kinds(n: int, rng: np.random.Generator):
    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    yield "uniform on the sphere, 64-d", unit(rng.normal(size=(n, 64)))
    yield "600 clusters, 64-d", unit(rng.normal(size=(600, 64))[rng.integers(600, size=n)] + 0.7 * rng.normal(size=(n, 64)))
    yield "600 clusters, 128-d, norms 0.5 to 2", unit(rng.normal(size=(600, 128))[rng.integers(600, size=n)] + 0.5 * rng.normal(size=(n, 128))) * rng.uniform(0.5, 2, (n, 1))


def main() -> None:
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 131_072
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "32").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    rng = np.random.default_rng(1)
    given = [("given", np.array(pq.read_table(sys.argv[2]).column("embedding").to_pylist(), float))] if len(sys.argv) > 2 else []
    for name, x in [*given, *kinds(n, rng)]:
        x = x.astype(np.float32)
        with tempfile.TemporaryDirectory() as folder:
            at = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": at}), f"{folder}/v.parquet", row_group_size=8192)
            df = spark.read.parquet(f"{folder}/v.parquet")
            step = len(x) // 400
            rows = vector_search.search(df, df.where(f"vec_id % {step} = 0"), 20).collect()
        wide, got = x.astype(float), {}
        for r in rows:
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hit = 0
        for q, own in got.items():
            score = wide @ wide[q]
            score[q] = -np.inf
            hit += len(own & set(np.argpartition(score, len(x) - 20)[-20:].tolist()))
        cells = -(-len(x) // vector_search.CELL_ROWS)
        sample = wide[rng.permutation(len(x))[: max(vector_search.SAMPLE, vector_search.PER_CELL * cells)]]
        visits = vector_search.Cells.fit(sample, cells, 20).visits
        share = max(vector_search.RERANK_LEAST / vector_search.CELL_ROWS, vector_search.RERANK_SHARE)
        print(f"{name}: {len(x)} rows, {len(got)} queries, recall {hit / (20 * len(got)):.4f}, about {visits} of {cells} cells visited, {100 * share * visits / cells:.1f} % of rows reranked", flush=True)


if __name__ == "__main__":
    main()
