"""Top-k search against all pairs."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm.mtree import Tree, _between, rings_of, top_k


def brute(rows, k):
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, q in fine:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i)[:k]
            out.update({(i, r + 1): (j, -s) for r, (s, j) in enumerate(best)})
    return out


@pytest.mark.parametrize(("seed", "n", "sizes"), [(1, 400, {}), (2, 400, {"page_rows": 30, "block_rows": 7, "leaf": 8, "routers": 40}), (3, 12, {})])
def test_top_k(spark, seed, n, sizes):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.3) for _ in range(6)] for _ in range(5)]
    rows = [(i, [float(x + rnd.gauss(0, 0.05)) for x in rnd.choice(centres)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(9000, None), (9020, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (9040, [float("nan")] * 6), (9041, [float("inf")] * 6), (9060, [0.0] * 6), (9061, [5.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(df, F.col("vec_id") % 20 == 0, **sizes).collect()}
    assert got == brute(rows, 20)


def test_nothing(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect() == []


def test_lengths_and_repeated_ids(spark):
    """Each length has its own rows; of the rows of one id the smallest asks; rows of one id are never each other's candidates."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (2, [0.5, 0.5]), (20, [1.0, 1.0, 1.0]), (3, [1.0, 2.0, 0.0]), (40, [7.0]), (60, []), (None, [9.0, 9.0])]
    want = [(0, 1, 2, 3 * 64 * 64), (0, 2, 2, 32 * 64), (0, 3, 1, 0), (20, 1, 3, 3 * 64 * 64)]
    for turn in (rows, rows[::-1]):
        df = spark.createDataFrame([(*r, "x", 1) for r in turn], "vec_id long, embedding array<double>, page string, kth int").repartition(3)
        got = top_k(df, F.col("vec_id") % 20 == 0).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want


def test_tree_prunes():
    """In a table of far clusters, bounds leave only a small part of the pages, and never one that holds a better row."""
    rnd = np.random.default_rng(5)
    x = np.floor(64 * np.concatenate([rnd.normal(0, 5, 8) + rnd.normal(0, 0.1, (200, 8)) for _ in range(40)]))
    top = (x * x).sum(axis=1).max()
    tree = Tree.over(x[rnd.permutation(len(x))[:80]], top)
    d = _between(np.column_stack((x, np.sqrt(top - (x * x).sum(axis=1)))), tree.routers)
    router, parent = d.argmin(axis=1), d.min(axis=1)
    frame = pd.DataFrame({"router": router, "bin": (parent / 50).astype(int), "p": parent}).groupby(["router", "bin"])["p"].agg(["size", "min", "max"]).reset_index().set_axis(["router", "bin", "n", "least", "most"], axis=1)
    tree.rings, of = rings_of(frame, 60)
    ring = of[frame.reset_index().set_index(["router", "bin"]).loc[list(zip(router, (parent / 50).astype(int)))]["index"].to_numpy()]
    assert (tree.rings[:, 4] == np.concatenate(([0], np.cumsum(tree.rings[:, 5])[:-1]))).all()
    assert np.bincount(ring).tolist() == tree.rings[:, 3].astype(int).tolist()
    q = x[::97]
    scores = q @ x.T
    kth = np.sort(scores, axis=1)[:, -20]
    far = np.sqrt((q * q).sum(axis=1) + top - 2 * kth) + tree.slack(q)
    open_ = np.isfinite(tree.bounds(q, far))
    assert all(open_[i, ring[scores[i] >= kth[i]]].all() for i in range(len(q)))
    assert open_.mean() < 0.3
    assert all(tree.rings[f, 3].sum() > 20 for f in tree.nearest(q, 20))
