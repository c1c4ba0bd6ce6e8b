"""Independent checks: url aliases against SQL, the quality ratio and FTRL against plain counts, suffix order, tables that stay."""

import math
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlake.llm import common, mixing, quality, queries, suffixes, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_aliases_decide(spark, tmp_path):
    canon, again = '<link rel="canonical" href="{}">', '<META http-equiv="refresh" content="0; url={}">'
    rows = [
        ("https://mirror.net/a", canon.format("https://x.com/de/1")),  # blocked by what it is an alias of
        ("https://mirror.net/b", again.format("/c")), ("https://mirror.net/c", canon.format("https://example.org/en/1")),  # two steps
        ("https://both.net/1", canon.format("https://x.com/de/2")), ("https://both.net/2", canon.format("https://x.com/de/2")), ("https://both.net/2?", canon.format("https://y.org/z")),
        ("https://both.net/3", canon.format("https://both.net/1")), ("https://both.net/3", canon.format("https://y.org/z")),  # allowed and blocked: allowed
        ("https://x.com/de/2", ""), ("https://free.net/", "<p>nothing</p>"), ("HTTPS://Mirror.NET/a#top", ""), (None, canon.format("https://x.com/de/1")), ("no url", canon.format("https://x.com/de/1")),
        ("https://x.com/de/9", canon.format("https://y.org/z")),  # its own rule comes first
    ]
    spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = queries.op7_urls(spark, str(tmp_path))
    cols = sorted(out.columns)
    got = sorted(map(repr, (tuple(r) for r in out.select(*cols).collect())))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = duck.sql(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in cols)} FROM ({queries.OP7_SQL})").fetchall()
    assert got == sorted(map(repr, want))
    verdict = {r["page_id"]: (r["by"], r["verdict"]) for r in out.collect()}
    assert [verdict[i] for i in (0, 1, 2)] == [("alias", "block")] * 3
    assert verdict[6] == ("alias", "allow")
    assert verdict[13] == ("rule", "block")
    assert verdict[9] == ("default", "allow")


def test_quality_ratio_is_that_of_plain_counts(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice([f"w{k}" for k in range(80)]) for _ in range(rnd.choice([0, 1, 70, 200])))) for i in range(60)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 60, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    grams = {i: [(w,) for w in t.split()] + list(zip(t.split(), t.split()[1:])) for i, t in rows}
    kinds = sorted({g for gs in grams.values() for g in gs})
    table = spark.createDataFrame([(list(g),) for g in kinds], "g array<string>")
    hashed = F.when(F.size("g") == 1, F.xxhash64(F.get("g", F.lit(0)))).otherwise(F.xxhash64(F.get("g", F.lit(0)), F.get("g", F.lit(1))))
    bucket = {tuple(r["g"]): r["b"] for r in table.select("g", F.pmod(hashed, F.lit(quality.BUCKETS)).alias("b")).collect()}
    good = {i for i, q, _ in labels if q}
    raw, target = Counter(), Counter()
    for i, gs in grams.items():
        for g in gs:
            raw[bucket[g]] += 1
            target[bucket[g]] += i in good
    n_raw, n_target = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    ratio = {b: math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in raw}
    out = quality.quality(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows)
    for r in out:
        gs = grams[r["doc_id"]]
        assert r["score"] == pytest.approx(sum(ratio[bucket[g]] for g in gs) / len(gs) if gs else 0, abs=1e-7)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= r["threshold"])
    scores = {r["doc_id"]: r["score"] for r in out if not r["base_failed"]}
    cost = lambda cut: 4 * sum(scores[i] < cut for i, q, _ in labels if q and i in scores) / max(1, sum(q and i in scores for i, q, _ in labels)) + sum(scores[i] >= cut for i, q, _ in labels if not q and i in scores) / max(1, sum(not q and i in scores for i, q, _ in labels))
    steps = [round(k * quality.STEP, 6) for k in range(-400, 400)]
    cut = out[0]["threshold"]
    assert cost(cut) <= min(cost(c) for c in steps) + 1e-9


def test_ftrl_is_the_plain_one():
    rnd = np.random.default_rng(7)
    rows = [np.unique(rnd.integers(0, 50, rnd.integers(0, 12))) for _ in range(60)]
    y = np.array([int(3 in r or rnd.random() < 0.1) for r in rows])
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if i == "bias":
            return -z[i] / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA)
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for x, t in zip(rows, y):
            at = [*x.tolist(), "bias"]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - t
            for i in at:
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - s * w[i]
                n[i] += g * g
    w, b = toxicity.ftrl(rows, y)
    assert b == pytest.approx(weight("bias"))
    assert w[:50] == pytest.approx([weight(i) for i in range(50)])


def test_suffix_order():
    rnd = np.random.default_rng(3)
    cells = rnd.integers(0, 3, (400, 9)).astype(np.uint8)
    cells[::7] = cells[0]
    order, lcp = suffixes.suffix_order(cells)
    rows = [bytes(cells[i]) for i in order]
    assert rows == sorted(rows)
    assert lcp.tolist() == [0] + [next((k for k in range(9) if a[k] != b[k]), 9) for a, b in zip(rows, rows[1:])]


def test_tables_stay_until_their_maker_is_done(spark, tmp_path):
    """What one operator returns can be read after another, or a stage, has run."""
    docs = spark.createDataFrame([(i, f"some words of {i} " * 20, "a") for i in range(5)], "doc_id long, text string, source string")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    first = mixing.mix_sources(docs)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).count()
    assert first.count() == 5


def test_a_cluster_names_its_folder():
    conf = {"spark.checkpoint.dir": None}
    held = SimpleNamespace(get=lambda k, d=None: conf[k], set=conf.__setitem__)
    session = lambda master: SimpleNamespace(conf=held, sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(session("spark://host:7077"))
    assert common.shared_folder(session("local[2]")).startswith("file://")


def test_pipeline_of_nothing_and_clashing_names(spark, tmp_path):
    names = ["row", "k1", "id", "key", "n_lines", "n_removed", "gone_id", "skey", "_text_key"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rnd = random.Random(1)
    text = lambda: " ".join(f"w{rnd.randrange(900)}" for _ in range(90))
    rows = [(i, text(), "en", "a", 7, *[f"{n}{i}" for n in names]) for i in range(8)]
    for held in ([], rows):
        state = spark.createDataFrame(held, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            state = stage(spark, state, str(tmp_path))
            assert state.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], name
            got = {r["doc_id"]: r for r in state.collect()}
            assert all(tuple(r) == rows[i] for i, r in got.items())
        assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, state, str(tmp_path)).collect()} == set(got)
        assert len(got) == len(held)
