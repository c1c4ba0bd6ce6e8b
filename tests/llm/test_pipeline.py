"""The pipeline over a small table of its own, and queries over the smallest test data."""

import random

import duckdb
import pytest

import corpus_pipeline
from ledgerlake.llm import jaccard, queries


def test_one_per_component(spark):
    text = " ".join(f"w{i}" for i in range(100))
    near = text.replace("w50 ", "other ")
    rows = [(5, text, "a"), (3, near, "b"), (3, near, "b"), (9, "quite another text of some words", "c"), (None, text, "d"), (1, None, "e"), (1, None, "e"), (2, "", "f"), (None, "alone here without any id at all", "g")]
    out = jaccard.one_per_component(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert out.columns == ["doc_id", "text", "source"]
    assert sorted((r["source"], r["doc_id"] or 0) for r in out.collect()) == [("b", 3), ("c", 9), ("e", 1), ("e", 1), ("f", 2), ("g", 0)]


def test_pipeline(spark, tmp_path):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(500)]
    prose = lambda n: "\n".join(" ".join(rnd.choice(vocab) for _ in range(12)) for _ in range(n // 12 + 1))
    shared = " ".join(rnd.choice(vocab) for _ in range(60))
    rows = [(i, prose(rnd.choice([80, 200])), rnd.choice("ab")) for i in range(60)]
    rows += [(100 + i, prose(80) + "\n" + shared, "a") for i in range(3)]
    words = prose(120).replace("\n", " ").split()
    for i in range(3):  # near copies, in one line each
        words[10 * i] = f"new{i}"
        rows.append((200 + i, " ".join(words), "b"))
    rows += [(300, "too short", "a"), (301, "again and again " * 40, "a"), (302, None, None), (303, rows[0][1], "a")]
    docs = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(301, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    state, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, state, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        state = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        seen[name] = state.collect()
        if name != "packing":
            assert state.columns == docs.columns
    kept = {r["doc_id"] for r in seen["quality rules"]}
    assert kept.isdisjoint({300, 301, 302})
    assert len(kept) > 55
    lined = {r["doc_id"]: r for r in seen["line dedup"]}
    assert kept - set(lined) <= {303}
    assert sum(shared in r["text"] for r in lined.values()) == 1
    assert all(r["n_chars"] == len(r["text"]) for r in lined.values())
    assert len({200, 201, 202} & {r["doc_id"] for r in seen["n-gram Jaccard join"]}) == 1
    assert {r["doc_id"] for r in seen["packing"]} == {r["doc_id"] for r in seen["mixing"]}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.queries()))
def test_queries_over_the_smallest_tables(spark, name):
    out = queries.queries()[name](spark, SF)
    cols = sorted(out.columns)
    got = sorted(map(repr, (tuple(r) for r in out.select(*cols).collect())))
    if name in queries.oracle_sql():
        duck = duckdb.connect()
        for t in ("documents", "pages", "embeddings"):
            duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = duck.sql(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
        assert got == sorted(map(repr, want))
    else:
        assert len(got) >= spark.read.parquet(f"{SF}/documents.parquet").count()


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before has kept: line runs and near duplicates by all windows and all pairs, copies and pieces by plain counts."""
    import test_jaccard
    import test_lines

    from ledgerlake.llm import mixing, quality

    rnd = random.Random(11)
    prose = lambda n: "\n".join(" ".join(rnd.choice([f"w{i}" for i in range(700)]) for _ in range(rnd.choice([3, 12, 25]))) for _ in range(n))
    shared = [prose(6) for _ in range(4)]
    rows = [(i, prose(rnd.randrange(8)) + "\n" + rnd.choice([*shared, "", ""]) + "\n" + prose(5), rnd.choice("abc")) for i in range(70)]
    for i in range(20):  # near and exact copies
        words = rows[i][1].split()
        for _ in range(rnd.choice([0, 1, 2, 40])):
            words[rnd.randrange(len(words))] = f"new{rnd.randrange(99)}"
        rows.append((100 + i, " ".join(words), "b"))
    rows += [(300, "few words", "a"), (301, None, "a"), (None, prose(9), None)]
    state = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(70)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept, seen = None, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, state, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        had, out = [(r["doc_id"], r["text"]) for r in state.collect()], spark.read.parquet(f"{tmp_path}/{len(seen)}")
        got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) if "text" in out.columns else None
        if name == "quality rules":
            kept = {r["doc_id"] for r in quality.quality(state, labels).where("kept").collect()}
            assert got == sorted(((d, t) for d, t in had if d in kept), key=repr)
            assert {300, 301}.isdisjoint(kept)
        elif name == "line dedup":
            assert got == sorted(((d, t) for d, t, _, _ in test_lines.brute(had, 50).elements() if (t or "").split()), key=repr)
        elif name == "n-gram Jaccard join":
            least = {(d, n): c for d, n, c in test_jaccard.brute(had, 5, 80)}
            sizes = {d: len(test_jaccard.sets_of(t, 5)) for d, t in had}
            assert {d for d, _ in got} == {d for d, _ in had if least[d, sizes[d]] in (d, None)}
            assert len(got) < len(had)
        elif name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(state).collect()}
            assert got == sorted(((d, t) for d, t in had for _ in range(copies[d])), key=repr)
        else:
            pieces = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"]) for r in out.collect())
            assert pieces == sorted((d is None, d or 0, len(t.split())) for d, t in had)
        seen.append(name)
        state = out
