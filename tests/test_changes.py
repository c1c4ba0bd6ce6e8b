"""Differences, identities, events and state over literal frames."""

from pyspark.sql import functions as F

from ledgerlake.operators import changes


def test_diff_of_every_case(spark):
    old = spark.createDataFrame([("re", "missing", 1, "m"), ("ch", "present", 1, "m"), ("un", "present", 1, "m"), ("mi", "present", 1, "m"), ("still", "missing", 1, "m"), ("mod", "present", 1, "m")], "path_key string, status string, size long, modified string")
    new = spark.createDataFrame([("new", 1, "m"), ("re", 1, "m"), ("ch", 2, "m"), ("un", 1, "m"), ("mod", 1, "n")], "path_key string, size long, modified string")
    d = changes.diff(old, new)
    assert {r["path_key"]: r["change_type"] for r in d.collect()} == {"new": "NEW", "re": "REAPPEARED", "ch": "CHANGED", "mod": "CHANGED", "un": "UNCHANGED", "mi": "MISSING", "still": "STILL_MISSING"}
    assert changes.diff_counts(d).first().asDict() == {"new": 2, "reappeared": 1, "changed": 2, "missing": 1, "unchanged": 1}
    same = changes.diff(new.withColumn("status", F.lit("present")), new)
    assert same.where("change_type <> 'UNCHANGED'").isEmpty()


def test_aggregates(spark):
    old = spark.createDataFrame([("a", 10, 1), ("b", 10, 1), ("c", 10, 1), ("d", 10, 1), ("e", 10, 1)], "k string, total_size long, file_count long")
    new = spark.createDataFrame([("b", 12, 1), ("c", 8, 1), ("d", 10, 2), ("e", 10, 1), ("f", 5, 1)], "k string, total_size long, file_count long")
    got = {r["k"]: (r["event_type"], r["size_delta"]) for r in changes.aggregate_diff(old, new, "k").collect()}
    assert got == {"a": ("AGGREGATE_REMOVED", -10), "b": ("AGGREGATE_SIZE_GROWTH", 2), "c": ("AGGREGATE_SIZE_SHRINK", -2), "d": ("AGGREGATE_SIZE_GROWTH", 0), "f": ("AGGREGATE_CREATED", 5)}


def test_events(spark):
    gib = 1 << 30
    rows = [
        ("big", "NEW", None, 5 * gib, False, False), ("model", "NEW", None, gib // 4, False, True), ("small", "NEW", None, 5, False, False), ("grown", "CHANGED", 100, 130, False, False),
        ("little", "CHANGED", 100, 110, False, False), ("shrunk", "CHANGED", 100, 20, False, False), ("gone", "MISSING", gib, None, False, False), ("noise", "NEW", None, 5, True, False), ("back", "REAPPEARED", 3, 4, False, False),
    ]
    df = spark.createDataFrame(rows, "path_key string, change_type string, before_size long, after_size long, volatile boolean, model_role boolean")
    got = sorted((r["path_key"], r["event_type"], r["size_delta"]) for r in changes.change_events(df).collect())
    assert got == sorted([
        ("big", "FILE_CREATED", 5 * gib), ("big", "LARGE_ASSET_CREATED", 5 * gib), ("model", "FILE_CREATED", gib // 4), ("model", "LARGE_ASSET_CREATED", gib // 4), ("small", "FILE_CREATED", 5),
        ("grown", "FILE_CHANGED", 30), ("grown", "FILE_SIZE_GROWTH", 30), ("little", "FILE_CHANGED", 10), ("shrunk", "FILE_CHANGED", -80), ("shrunk", "FILE_SIZE_SHRINK", -80),
        ("gone", "FILE_MISSING", -gib), ("gone", "LARGE_ASSET_REMOVED", -gib), ("back", "FILE_REAPPEARED", 4),
    ])


def test_five_hundred_temporary_files_are_one_event(spark):
    df = spark.range(500).select(F.lit("runtime_log").alias("volatile_class"), F.lit(None).cast("long").alias("before_size"), F.lit(3).cast("long").alias("after_size"))
    assert changes.collapse_volatile(df).first().asDict() == {"volatile_class": "runtime_log", "aggregate_count": 500, "size_delta": 1500}


def test_identities(spark):
    row = lambda side, path, rank, size=16, native=None, sha=None, sample=None: (side, path, size, native, sha, sample, rank)
    rows = [
        row("missing", "a/old.txt", "", sha="s1"), row("arrival", "a/new.txt", "1", sha="s1"), row("arrival", "b/second.txt", "2", sha="s1"),
        row("missing", "a/nat.txt", "", 20, native="n1"), row("arrival", "c/nat.txt", "1", 20, native="n1"), row("missing", "x/hash.txt", "", 20, sha="s9"),
        row("present", "p/src.txt", "", 30, sample="q"), row("arrival", "p/copy.txt", "1", 30, sample="q"),
        row("missing", "m/report_2020.txt", "", 40), row("arrival", "n/report_2021.txt", "1", 40), row("arrival", "n/zzz.txt", "2", 40),
        row("arrival", "lonely.txt", "1", 50, sha="s1"),
    ]
    df = spark.createDataFrame(rows, "side string, path_key string, size long, native_id string, sha256 string, sample string, rank string")
    got = {r["target_path_key"]: (r["event_type"], r["source_path_key"], r["confidence"]) for r in changes.correlate_identities(df).collect()}
    assert got["a/new.txt"] == ("RENAMED", "a/old.txt", 1.0)
    assert "b/second.txt" not in got
    assert got["c/nat.txt"] == ("MOVED", "a/nat.txt", 0.995)
    assert got["p/copy.txt"] == ("COPIED", "p/src.txt", 0.96)
    assert got["n/report_2021.txt"][:2] == ("POSSIBLE_MOVE", "m/report_2020.txt")
    assert "n/zzz.txt" not in got
    assert "lonely.txt" not in got


def test_full_hash_outranks_native_id(spark):
    rows = [("missing", "a/1", 5, "n", None, None, ""), ("missing", "a/2", 5, None, "s", None, ""), ("arrival", "b/3", 5, "n", "s", None, "1")]
    df = spark.createDataFrame(rows, "side string, path_key string, size long, native_id string, sha256 string, sample string, rank string")
    assert [r["source_path_key"] for r in changes.correlate_identities(df).collect()] == ["a/2"]


def test_moves_copies_and_survivors(spark):
    f = lambda rows: spark.createDataFrame(rows, "path_key string, size long, sha256 string, sample string")
    gone, come, here = f([("a/x", 1, "s1", "p1"), ("a/y", 2, "s2", "p2"), ("a/z", 3, "s3", "p3")]), f([("a/w", 1, "s1", "p1"), ("b/y", 2, "s2", "p2")]), f([("h/1", 2, "s2", "p2"), ("h/0", 2, "s2", "p2"), ("h/3", 3, "s4", "p3")])
    assert {tuple(r) for r in changes.exact_moves(gone, come).collect()} == {("a/x", "a/w", "RENAMED"), ("a/y", "b/y", "MOVED")}
    assert [tuple(r) for r in changes.copy_candidates(come, here).collect()] == [("b/y", "h/0")]
    assert {tuple(r) for r in changes.survivors(gone, here).collect()} == {("a/x", "unresolved_missing"), ("a/y", "content_copy_verified"), ("a/z", "content_copy_candidate")}


def test_alerts_cards_assertions(spark):
    alerts = spark.createDataFrame([("f", 1), ("g", 5), ("h", 1)], "k string, at long")
    assert {r["k"] for r in changes.open_alerts(alerts, spark.createDataFrame([("f", 2), ("g", 4)], "k string, at long"), "k", "at").collect()} == {"g", "h"}
    old, new = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, p string, q string"), spark.createDataFrame([(2, "c", None), (3, "d", "z")], "id long, p string, q string")
    assert sorted(map(tuple, changes.merge_cards(old, new, "id").collect())) == [(1, "a", "x"), (2, "c", "y"), (3, "d", "z")]
    inferred = spark.createDataFrame([(1, "figure", 0.4), (2, "code", 0.4)], "id long, role string, confidence double")
    said = spark.createDataFrame([(1, "final", True, 1), (1, "primary", True, 2), (2, "x", False, 9)], "id long, value string, active boolean, updated_at long")
    got = {r["id"]: (r["role"], r["confidence"], r["explicit_user"]) for r in changes.apply_assertions(inferred, said, "id", "role").collect()}
    assert got == {1: ("primary", 1.0, True), 2: ("code", 0.4, False)}
