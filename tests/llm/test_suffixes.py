"""Suffix deduplication against all positions."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from ledgerlake.llm.queries import op3_suffixes
from ledgerlake.llm.suffixes import suffix_dedup

SHAPES = [{"length": 40, "gram": 12, "block": 16}, {"length": 90, "gram": 12, "block": 64}]


def brute(rows, keep, length):
    starts = defaultdict(list)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    texts = [(t or "").encode() for _, t in rows]
    for i in order:
        for s in range(len(texts[i]) - length + 1):
            starts[texts[i][s : s + length]].append((i, s))
    gone = [set() for _ in rows]
    for places in starts.values():
        if len(places) > 1:
            for i, s in places[1:] if keep == "first" else places:
                gone[i].update(range(s, s + length))
    out = []
    for i, t in enumerate(texts):
        runs = sum(p - 1 not in gone[i] for p in gone[i])
        out.append((rows[i][0], len(t), bytes(b for p, b in enumerate(t) if p not in gone[i]), runs))
    return Counter(out)


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abcdeé \n") for _ in range(n))
    passages = [text(n) for n in (30, 38, 40, 45, 90, 200, 700)]
    rows = []
    for i in range(60):
        t = ""
        for _ in range(rnd.randrange(6)):
            t += rnd.choice(["", text(rnd.randrange(80)), rnd.choice(passages)])
        rows.append((i, t))
    near = text(500)
    for i in range(30):
        at = rnd.randrange(500)
        rows.append((100 + i, near[:at] + rnd.choice(["", "x", "yz"]) + near[at + rnd.randrange(3) :]))
    return [*rows, (200, rows[-1][1]), (201, "q" * 150), (202, "ab" * 120), (206, "q" * 300), (203, None), (204, ""), (205, text(39)), (None, passages[5])]


@pytest.mark.parametrize(("seed", "keep", "most", "shape"), [(1, "none", 20000, 0), (2, "first", 20000, 0), (3, "none", 2, 0), (4, "first", 2, 0), (5, "none", 20000, 1), (6, "first", 3, 1)])
def test_suffixes(spark, seed, keep, most, shape):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup(df, keep=keep, most=most, **SHAPES[shape]).collect()
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_bytes"] - len(r["kept"]) for r in got)
    assert Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in got) == brute(rows, keep, SHAPES[shape]["length"])


def test_long_text_and_nothing(spark):
    rnd = random.Random(9)
    part = "".join(rnd.choice("abcdefghij") for _ in range(3000))
    long = "".join(rnd.choice("abcdefghij") for _ in range(1_300_000))
    at = (1 << 20) - 700
    rows = [(1, long[:at] + part + long[at:]), (2, "x" + part), (2, "short")]
    got = {(r["doc_id"], r["n_bytes"]): r["spans"] for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep="none").collect()}
    span = got[1, 1_303_000]
    assert len(span) == 1
    assert span[0]["end"] - span[0]["start"] in range(3000, 3003)
    assert got[2, 5] == []
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_on_passages_of_over_50_words(spark, tmp_path):
    """The contract counts 400 bytes, not words: of repeated passages of 51 words and more just those that reach them go."""
    rnd = random.Random(12)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(6))
    text = lambda n, letters: " ".join(word(letters) for _ in range(n))
    cut = lambda t, n: t.encode()[:n].decode(errors="ignore")
    plain = [cut(text(60, "abcdefgh"), n) for n in (51 * 7, 399, 400)]
    passages = [*plain, text(70, "abcdefgh"), text(51, "éñüç")]
    assert all(len(p.split()) > 50 for p in passages)
    rows, holds = [], {}
    for i in range(60):
        # One byte beside a passage that no other document has, so that no repeat is longer than its passage.
        k = i % 10
        holds[i] = len(passages[k].encode()) if k < len(passages) else 0
        rows.append((i, chr(33 + i).join([text(rnd.randrange(5, 90), "klmnop"), passages[k] if holds[i] else text(60, "klmnop"), text(rnd.randrange(5, 90), "klmnop")])))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_suffixes(spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == Counter((d, n, n - len(kept), runs, hashlib.sha256(kept).hexdigest()) for d, n, kept, runs in brute(rows, "none", 400))
    assert {r["doc_id"]: r["n_removed"] for r in got} == {d: n if n >= 400 else 0 for d, n in holds.items()}


def test_query_on_given_table(spark):
    """Every 400-byte window of the smallest table. The passages of `benchmark` that it holds stay, as such: those of over 50 words have fewer bytes than that."""
    sf = "/root/testdata/sf0.001"
    got = op3_suffixes(spark, sf).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, "none", 400)
    assert Counter(tuple(r) for r in got) == Counter((d, n, n - len(kept), runs, hashlib.sha256(kept).hexdigest()) for d, n, kept, runs in want.elements())
    assert any(r["n_removed"] for r in got)
    passages = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(r["text"].split()) > 50]
    assert passages
    assert max(len(p.encode()) for p in passages) < 400
