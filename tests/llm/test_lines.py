"""Line dedup against all runs of lines."""

import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerlake.llm.lines import dedup_lines, delete_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, min_words):
    """Lines of every run of lines, of any length, that has enough words and starts earlier too; blank ones in a shortest run."""
    docs = []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (t or "").split("\n")
        docs.append((d, t, lines, [(i, x) for i, x in enumerate(lines) if WORD.search(x)]))
    seen, gone = defaultdict(list), [set() for _ in docs]
    for k, (_, _, _, f) in enumerate(docs):
        for s in range(len(f)):
            words = 0
            for e in range(s, min(len(f), s + 60)):
                words += len(WORD.findall(f[e][1]))
                if words >= min_words:
                    last, first = len(WORD.findall(f[e][1])), len(WORD.findall(f[s][1]))
                    shortest = words - last < min_words or words - first < min_words
                    inside = range(f[s][0], f[e][0] + 1) if shortest else [i for i, _ in f[s : e + 1]]
                    seen[tuple(x for _, x in f[s : e + 1])].append((k, inside))
    for places in seen.values():
        for k, inside in places[1:]:
            gone[k].update(inside)
    return Counter((d, t if not gone[k] else "\n".join(x for i, x in enumerate(lines) if i not in gone[k]), len(lines), len(gone[k])) for k, (d, t, lines, _) in enumerate(docs))


@pytest.mark.parametrize(("seed", "min_words"), [(1, 6), (2, 11), (3, 1)])
def test_lines(spark, seed, min_words):
    rnd = random.Random(seed)
    some = [" ".join(rnd.choice("abcdef") for _ in range(rnd.choice([1, 1, 2, 3, 7, 15]))) for _ in range(14)] + ["", " \t", "\r"]
    runs = [[rnd.choice(some) for _ in range(rnd.choice([2, 5, 9]))] for _ in range(5)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rnd.randrange(5)):
            lines += rnd.choice([rnd.choice(runs), [rnd.choice(some)], [f"own {i} {rnd.random()}"]])
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, rows[3][1]), (103, rows[3][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_lines_before string").repartition(3)
    got = dedup_lines(df, min_words).collect()
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got) == brute(rows, min_words)


def test_nothing_and_long(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    run = "\n".join(f"w{i}" for i in range(60))
    rows = [(1, "a\n" + run), (2, run + "\nz"), (2, "same " * 60), (2, "same " * 60), (3, "\n".join(str(i) for i in range(30_000)))]
    got = sorted((r["doc_id"], r["n_removed"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0), (2, 0), (2, 0), (2, 60), (3, 0)]


def test_clashing_columns(spark):
    run = "\n".join(f"w{i}" for i in range(60))
    names = ["id", "row", "k1", "k2", "_k1", "_lines", "lines", "gone", "stay", "old", "s", "n_lines", "n_removed"]
    df = spark.createDataFrame([(i, run + f"\nown {i}", *[f"{n}{i}" for n in names]) for i in range(2)], ["doc_id", "text", *names])
    out = dedup_lines(df)
    assert out.columns == [*df.columns[:-2], "n_lines", "n_removed"]
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(i, ["", "own 1"][i] or run + "\nown 0", *[f"{n}{i}" for n in names[:-2]], 61, 60 * i) for i in range(2)]
    assert delete_runs(df).select("row.*").columns == df.columns
