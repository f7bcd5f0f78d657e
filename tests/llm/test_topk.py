import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runweave.llm import topk

SF = "/root/testdata/sf0.01"


def brute(rows, asks, k=5):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, own) in enumerate(whole):
        if asks(q):
            scored = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), c) for m, (c, v) in enumerate(whole) if m != n)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    return sorted(out)


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_query_against_brute_force(spark):
    import __spark_entry__ as e

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert rows_of(e.queries()["op9_exact_top_k"](spark, SF)) == brute(rows, lambda q: q % 50 == 0)


@pytest.mark.parametrize("block,shard", [(4, 2), (256, 32)])
def test_ties_and_odd_rows(spark, monkeypatch, block, shard):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SHARD", shard)
    rng = random.Random(block)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(90)]
    rows += [(100, None), (150, [1.0, None, 2.0]), (151, [math.nan, 0.0, 0.0]), (152, [math.inf]), (None, [1.0]), (153, []), (154, [1.5]), (155, [1.0, 2.0, 3.0, 4.0]), (200, [2.0, 2.0, 2.0]), (201, [2.0, 2.0, 2.0])]
    rows += [(10, [1.0, 2.0, -1.0]), (10, [1.0, 2.0, -1.0]), (11, [2.0, 2.0, 2.0]), (11, [2.0, 2.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, id int")
    assert rows_of(topk.top_k(df, F.col("id") % 10 == 0)) == brute(rows, lambda q: q % 10 == 0)


def test_large_components_stay_exact(spark):
    rows = [(0, [1e7, 3.0]), (1, [1e7, -1.0]), (2, [1e7 + 1 / 256, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(topk.top_k(df, F.col("id") == 0)) == brute(rows, lambda q: q == 0)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("id") % 50 == 0).count() == 0


def test_clustered_vectors_are_pruned():
    """Fewer than half of all inner products are made, and the best are those of brute force."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((100, 32))
    vectors = np.floor(256 * (centres[rng.integers(0, 100, 8000)] + 0.1 * rng.standard_normal((8000, 32)))).astype(np.int64)
    cell = topk.nearest(vectors, topk.fit_cells(vectors[::2]))
    order = np.argsort(cell, kind="stable")
    shard = topk.Shard(np.arange(8000)[order], np.arange(8000)[order], vectors[order])
    asked = np.arange(0, 8000, 50)
    top, who = shard.best(asked, vectors[asked], np.full(len(asked), np.iinfo(np.int64).min), 5)
    whole = vectors[asked] @ vectors.T
    whole[np.arange(len(asked)), asked] = np.iinfo(np.int64).min
    want = [np.lexsort((np.arange(8000), -1 - s))[:5] for s in whole]
    assert (who == want).all() and (top == np.take_along_axis(whole, np.array(want), 1)).all()
    assert shard.scored < 0.5 * whole.size
