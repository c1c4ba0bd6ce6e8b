"""The Jaccard join against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerlake.llm import jaccard
from ledgerlake.llm.jaccard import Trees, early, forest, jaccard_components, one_per_component, point_of


def sets_of(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets = [sets_of(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["The", "OF", "é"]
    rows = []
    for base in range(12):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 4, 7, 15, 40, 120, 300]))]
        for _ in range(rnd.choice([1, 3, 8])):
            w = list(words)
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                i = rnd.randrange(max(1, len(w)))
                w[i : i + 1] = rnd.choice([[], [rnd.choice(vocab)], [*w[i : i + 1], rnd.choice(vocab)]])
            rows.append((len(rows) * 3 % 1009, rnd.choice([" ", "\n", " \t"]).join(w)))
    words = [rnd.choice(vocab) for _ in range(80)]
    for _ in range(60):  # one large group of near copies
        w = list(words)
        for _ in range(rnd.choice([1, 2, 3])):
            w[rnd.randrange(80)] = rnd.choice(vocab)
        rows.append((5000 + len(rows), " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "THE of"), (2004, "the OF"), (2004, "the OF"), (None, "the of"), (None, "only here and nowhere else"), (2005, "long " * 200_000)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "k", "percent", "block"), [(1, 3, 90, 1000), (2, 5, 80, 1000), (3, 3, 90, 7), (4, 5, 80, 9), (5, 4, 50, 1000), (6, 3, 60, 6), (7, 2, 30, 1000)])
def test_components(spark, seed, k, percent, block):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard_components(df, k, percent, block).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows, k, percent)


def test_nothing(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hot_shingles(spark, monkeypatch):
    """With nearly all shared shingles taken for frequent ones."""
    monkeypatch.setattr(jaccard, "OFTEN", 2)
    rows = corpus(8)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80, 12).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows, 5, 80)


def test_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(100))
    names = ["row", "k1", "k2", "one", "i1", "component", "least", "n"]
    df = spark.createDataFrame([(i, t, *[f"{i}{n}" for n in names]) for i, t in enumerate([text, text, "quite other words", None])], ["doc_id", "text", *names])
    out = one_per_component(df)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in df.collect() if r["doc_id"] != 1)
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_components(df).collect()} == {(0, 0), (1, 0), (2, 2), (3, 3)}


@pytest.mark.parametrize("percent", [30, 80, 95])
def test_trees_and_early_shingles(percent):
    rnd = np.random.default_rng(percent)
    sets = []
    for n in [1, 2, 9, 300, 900, 1000, 1100, 1300, 3900, 4300, 17000]:
        base = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        for _ in range(9):
            keep = base[rnd.random(len(base)) > rnd.choice([0, 0.02, 0.1, 0.4])]
            sets.append(np.unique(np.concatenate((keep, rnd.integers(0, 1 << 63, rnd.integers(0, 3 + n // 20), dtype=np.uint64), base[:1]))))
    sets += [np.unique(rnd.integers(0, 1 << 63, 50, dtype=np.uint64)) for _ in range(1200)]
    size, points = np.array([len(s) for s in sets]), [point_of(s) for s in sets]
    trees, every = Trees(size, points, percent, sets), np.ones(len(sets), bool)
    assert len(trees.trees[0][1].levels) > 1
    for i in range(0, 99, 2):
        both = np.array([len(np.intersect1d(sets[i], s, assume_unique=True)) for s in sets])
        linked = np.flatnonzero(100 * both >= percent * (size[i] + size - both))
        assert trees.search(int(size[i]), points[i], every, sets[i]).tolist() == linked.tolist()
        for j in linked:  # any order will do: the early shingles meet
            assert set(sets[i][: early(int(size[i]), percent)].tolist()) & set(sets[j][: early(int(size[j]), percent)].tolist())
    root = forest(trees)
    assert all(root[root[i]] == root[i] for i in range(len(sets)))
