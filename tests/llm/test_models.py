"""Toxicity and suffix-tree scoring."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import suffix_tree, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_scores(rows, held, least, least_context, divergence, max_depth):
    seqs = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [None] for _, t in rows]
    train = [s for s, (d, _) in zip(seqs, rows) if not held(d)]
    count = [Counter(tuple(s[i : i + g]) for s in train for i in range(len(s) - g + 1)) for g in range(max_depth + 2)]
    n, v = sum(count[1].values()), len(count[1])
    p0 = lambda w: (count[1][w,] + 1) / (n + v + 1)
    nodes = {}

    def prob(w, ctx):
        if ctx == ():
            return p0(w)
        if ctx not in nodes:
            return prob(w, ctx[1:])
        total, kids, rest = nodes[ctx]
        return (kids.get(w, 0) + (rest + 1) * prob(w, ctx[1:])) / (total + 1)

    for g in range(1, max_depth + 1):
        for ctx, total in count[g].items():
            kids = {k[-1]: c for k, c in count[g + 1].items() if k[:-1] == ctx and c >= least} if total >= least_context else {}
            if kids:
                kept = sum(kids.values())
                parent = {w: prob(w, ctx[1:]) for w in kids}
                gap = sum(c / total * math.log(c / total / parent[w]) for w, c in kids.items())
                rest, rest_p = 1 - kept / total, 1 - sum(parent.values())
                if rest > 0 and rest_p > 0:
                    gap += rest * math.log(rest / rest_p)
                if gap >= divergence:
                    nodes[ctx] = (total, kids, total - kept)
    out = []
    for (d, _), s in zip(rows, seqs):
        base = sum(math.log10(p0(w)) for w in s)
        score = sum(math.log10(prob(w, tuple(s[max(0, i - max_depth) : i]))) for i, w in enumerate(s))
        out.append((d, held(d), len(s), sum(count[1][w,] > 0 for w in s), n, base, score))
    return out, nodes


@pytest.mark.parametrize(("seed", "max_depth"), [(1, 4), (2, 2)])
def test_suffix_tree(spark, seed, max_depth):
    rnd = random.Random(seed)
    vocab = ["The", "the", "of", "a", "é", "x,", "y"] + [f"r{i}" for i in range(40)]
    rows = []
    for i in range(120):
        w = []
        while len(w) < rnd.randrange(60):
            w += rnd.choice([[rnd.choice(vocab)], ["new", "york", "city"], ["old", "york", "town"], ["the", "end"], ["a", "very", "long", "phrase", "that", "ends"], ["some", "very", "long", "phrase", "here"]])
        rows.append((i, rnd.choice([" ", "\n"]).join(w)))
    rows += [(500, None), (501, ""), (502, "\t"), (None, "the end"), (7, rows[7][1]), (503, "only once here"), (504, "the " * 5_000)]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    want, nodes = brute_scores(rows, held, 2, 3.5, 0.05, max_depth)
    assert {len(k) for k in nodes} == set(range(1, max_depth + 1))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix_tree.score_texts(df, toxicity.part_of(F.col("doc_id"), 7) == 2, word_share=1e-4, term_share=1e-3, min_next=0, min_context=3.5 * 1e9 / want[0][4], corpus=1e9, max_depth=max_depth).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_suffix_tree_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_tree.score_texts(df, F.lit(False)).collect() == []
    one = spark.createDataFrame([(1, "never seen")], "doc_id long, text string")
    r = suffix_tree.score_texts(one, F.lit(True)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)


def test_toxicity(spark):
    rnd = random.Random(3)
    plain, rude = [f"w{i}" for i in range(200)], ["Idiot", "scum", "clown"]
    rows, labels = [], []
    for i in range(900):
        w = [rnd.choice(plain) for _ in range(rnd.choice([5, 30, 200]))]
        bad = rnd.random() < 0.2
        for _ in range(3 if bad else 0):
            w[rnd.randrange(len(w))] = rnd.choice(rude) + rnd.choice(["", ",", "!"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(2000, None), (2001, ""), (None, "idiot idiot scum"), (2002, "scum " + "w1 " * 100_000)]
    labels += [(3, 0), (None, 1), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = toxicity.part_of(F.col("doc_id"), 3) == 1
    got = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), held).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    truth = dict(labels[:900])
    out = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == t for p, t in out) >= 0.95 * len(out)
    assert [r["predicted"] for r in got if r["doc_id"] is None] == [1]
    none = toxicity.score_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"), held).collect()
    assert all(0 <= r["score"] <= 1 for r in none)
    assert toxicity.score_toxicity(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int"), held).collect() == []


def test_ftrl_is_sparse_and_separates():
    rnd = np.random.default_rng(1)
    rows = [np.unique(rnd.integers(0, 1 << toxicity.BITS, 30)) for _ in range(400)]
    y = np.arange(400) % 2
    rows = [np.unique(np.append(r, 7)) if t else r for r, t in zip(rows, y)]
    w, b = toxicity.ftrl(rows, y)
    assert w[7] > 0
    assert (w != 0).sum() < 50


def test_suffix_tree_keeps_contexts_by_count(spark):
    """Nothing makes up the shares, so nothing is broadcast; in a corpus of the floors' own size, contexts and next words come by those counts."""
    rnd = random.Random(5)
    rows = [(i, " ".join(w for _ in range(20) for w in rnd.choice([["new", "york", "city"], ["old", "york", "town"], ["the", "end"], [f"r{rnd.randrange(400)}"]]))) for i in range(200)]
    held = lambda d: d % 7 == 2
    want, nodes = brute_scores(rows, held, 16, 80, 0.05, 5)
    assert {len(k) for k in nodes} >= {1, 2}
    got = suffix_tree.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.col("doc_id") % 7 == 2, word_share=1.0, term_share=1.0, corpus=want[0][4]).collect()
    for g, w in zip(sorted(map(tuple, got)), sorted(want)):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_floors_rise_with_the_root_of_the_corpus():
    assert suffix_tree.floors(4_000_000, 16, 80, 4e6) == (16, 80)
    assert suffix_tree.floors(400_000_000, 16, 80, 4e6) == (160, 800)
    assert suffix_tree.floors(1_000_000, 16, 80, 4e6) == (4, 20)
    assert suffix_tree.floors(10, 16, 80, 4e6) == (2, 2)
