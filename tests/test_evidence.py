"""Gates, grids, graphs, audits, histories, sources and streams over literal frames."""

import itertools
import json
import random
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import audit, gates, graphs, grids, history, matching
from ledgerlake.sources import files
from ledgerlake.streaming import events as streams


def lattice(states):
    by = {s: [f"{s}{i}" for i, x in enumerate(states) if x == s] for s in ("FAIL", "PARTIAL", "SKIPPED")}
    if by["FAIL"]:
        return "FAIL", ["REQUIRED_GATE_FAILED", *by["FAIL"]]
    if by["PARTIAL"]:
        return "PARTIAL", ["REQUIRED_GATE_PARTIAL", *by["PARTIAL"], *by["SKIPPED"]]
    if by["SKIPPED"]:
        return ("SKIPPED", ["ALL_REQUIRED_GATES_SKIPPED", *by["SKIPPED"]]) if len(by["SKIPPED"]) == len(states) else ("PARTIAL", ["REQUIRED_GATE_SKIPPED", *by["SKIPPED"]])
    return "PASS", []


def test_gate_lattices(spark):
    combos = [c for n in (2, 3) for c in itertools.product(["PASS", "FAIL", "PARTIAL", "SKIPPED"], repeat=n)]
    rows = [(g, i, True, s, [] if s == "PASS" else [f"{s}{i}"]) for g, c in enumerate(combos) for i, s in enumerate(c)]
    rows += [(g, 99, False, "FAIL", ["OPTIONAL"]) for g in range(len(combos))]
    df = spark.createDataFrame(rows, "g long, ord long, required boolean, status string, reason_codes array<string>").repartition(5)
    got = {r["g"]: (r["status"], r["reason_codes"]) for r in gates.required_gates(df, ["g"]).collect()}
    assert got == {g: lattice(c) for g, c in enumerate(combos)}
    merged = {r["g"]: (r["status"], r["reason_codes"]) for r in gates.merge_readiness(df.where("required"), ["g"]).collect()}
    for g, c in enumerate(combos):
        want = "FAIL" if "FAIL" in c else "PARTIAL" if set(c) & {"PARTIAL", "SKIPPED"} else "PASS"
        codes = [f"{s}{i}" for i, s in enumerate(c) if (s == "FAIL" if want == "FAIL" else s in ("PARTIAL", "SKIPPED"))]
        assert merged[g] == (want, codes)


def test_conservation(spark):
    rows = [("z", 0.0, 0.0), ("u", 0.0, 1.0), ("ok", 10.0, 10.1), ("neg", -10.0, -10.1), ("bad", 10.0, 20.0)]
    df = spark.createDataFrame([(i, a, b, "relative_error", "lte", 0.02, None) for i, a, b in rows], "check_id string, source_value double, target_value double, metric string, operator string, low double, high double")
    got = {r["check_id"]: (r["status"], r["reason_codes"]) for r in gates.conservation(df).collect()}
    assert got == {"z": ("PASS", []), "u": ("PARTIAL", ["ZERO_REFERENCE_VALUE"]), "ok": ("PASS", []), "neg": ("PASS", []), "bad": ("FAIL", ["CONSERVATION_CRITERION_FAILED"])}


def test_regressions(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, "PASS", [], False, 0, t, "a"), (2, "FAIL", ["X"], True, 0, t, "a"), (3, "FAIL", ["X"], True, 1, t, "a"), (4, "PASS", [], True, 1, t, "a"), (5, "SKIPPED", ["S"], True, 0, t, "a"), (6, "PASS", [], True, None, t, "a"), (7, "PASS", [], True, 0, t, "a")]
    df = spark.createDataFrame(rows, "regression_id long, status string, reason_codes array<string>, authorized boolean, exit_code int, executed_at timestamp, actual_ref string")
    got = {r["regression_id"]: (r["status"], r["reason_codes"]) for r in gates.regressions(df).collect()}
    assert got == {1: ("FAIL", ["UNAUTHORIZED_REGRESSION_RECORD"]), 2: ("FAIL", ["X"]), 3: ("FAIL", ["X", "UPSTREAM_RUN_FAILED"]), 4: ("FAIL", ["UPSTREAM_RUN_FAILED"]), 5: ("PARTIAL", ["S"]), 6: ("PARTIAL", ["REGRESSION_RECORD_INCOMPLETE"]), 7: ("PASS", [])}


@pytest.mark.parametrize(("n", "m", "spacing"), [(3, 4, 2.0), (10, 7, 0.1)])
def test_regrid_conserves(spark, n, m, spacing):
    source = grids.Grid((n, n), (spacing, spacing), (0.3, -1.0))
    target = grids.Grid((m, m), (n * spacing / m, n * spacing / m), (0.3, -1.0))
    rnd = random.Random(1)
    f = spark.createDataFrame([(i, j, rnd.random()) for i in range(n) for j in range(n)], "i int, j int, value double")
    out = grids.regrid(f, source, target)
    assert out.count() == m * m
    assert out.where("abs(coverage - 1) > 1e-9").isEmpty()
    check = grids.integral_check(f, source, out, target, 1e-9).first()
    assert check["status"] == "PASS"


def test_field_defects(spark):
    grid = grids.Grid((2, 2), (1.0, 1.0), (0.0, 0.0))
    raw = spark.createDataFrame([(1, "0.5", "0.5", "1"), (2, "", "0.5", "1"), (3, "0.5", "abc", "1"), (4, "1.5", "1.5", "nan"), (5, "1.5", "0.5", "2"), (6, "1.5", "0.5", "3"), (7, "0.7", "1.5", "1")], "row long, x string, y string, value string")
    t = grids.validate_table(raw, grid)
    got = {r["row"]: r["reason_codes"] for r in t.collect()}
    assert got == {1: [], 2: ["MISSING_VALUE"], 3: ["NONNUMERIC_VALUE"], 4: ["NONFINITE_VALUE"], 5: ["DUPLICATE_COORDINATE"], 6: ["DUPLICATE_COORDINATE"], 7: ["GRID_COORDINATE_MISMATCH"]}
    assert {tuple(r) for r in grids.missing_cells(t.where("size(reason_codes) = 0"), grid).collect()} == {(1, 0), (0, 1), (1, 1)}
    moved = grids.normalize(t.where("row = 1"), (1, 0), (2.0, 3.0), (1.0, 0.0)).first()
    assert (moved["x"], moved["y"]) == (2.0, 1.5)


def test_graphs(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "node long")
    chain = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6)], "src long, dst long")
    start = spark.createDataFrame([(0,), (6,)], "start long")
    assert {tuple(r) for r in graphs.reachable(chain, start).collect()} == {(0, 0), (0, 1), (0, 2), (0, 3), (6, 6)}
    assert {tuple(r) for r in graphs.weak_components(nodes, chain).collect()} == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 4), (5, 5), (6, 5), (7, 7)}
    four = nodes.where("node < 4")
    assert not graphs.all_connected(four, chain, True).first()["connected"]
    assert graphs.all_connected(four, chain, False).first()["connected"]
    assert graphs.all_connected(four, chain.union(spark.createDataFrame([(3, 0)], chain.schema)), True).first()["connected"]
    pairs = spark.createDataFrame([(0, 3), (3, 0)], "src long, dst long")
    assert {tuple(r) for r in graphs.pairs_connected(chain, pairs).collect()} == {(0, 3, True), (3, 0, False)}


def test_audit(spark):
    label = lambda p, kind="file": spark.createDataFrame([(p, kind)], "p string, k string").select(audit.classify(F.col("p"), F.col("k"), ["cache"], ["src"], ["results"])).first()[0]
    assert [label(p) for p in ("a/Cache/x.py", "src/x.py", "results/x", "a/c.yaml", "a/x.py", "a/x.md", "a/ReadMe", "a/x.zzz")] == ["cache", "source", "result", "config", "code", "report", "report", "unknown"]
    assert label("src", "directory") == "unknown"
    docs = spark.createDataFrame([("d/a.md", "[a](b.md) [x]( ) [h](http://e) [f](c.md#s) [o](../../out.md) [g](./e/../h.md)")], "path string, text string")
    entries = spark.createDataFrame([("d/b.md",), ("d/a.md",)], "path string")
    assert {r["missing"] for r in audit.broken_links(docs, entries, "path", "text").collect()} == {"d/c.md#s", "d/h.md"}
    mentions = spark.createDataFrame([("Fluent", "primary", 3), ("COMSOL", "reference", 9)], "tool string, kind string, n long")
    native = spark.createDataFrame([("Fluent", 1 << 30, False)], "tool string, size long, in_reference boolean")
    assert {r["tool"]: r["centrality"] for r in audit.tool_centrality(native, mentions).collect()} == {"Fluent": "PRIMARY_TOOL", "COMSOL": "REFERENCE_TOOL"}


def test_histories(spark):
    t = lambda d: datetime(2024, 1, d)
    p = [(1, None, None, 0, 0.0, t(1)), (2, None, None, 0, 0.0, t(20)), (3, None, None, 0, 0.0, t(30)), (4, None, None, 2, 80.0, None), (5, None, "FROZEN", 5, 9.0, None), (6, "PAUSED", "FROZEN", 0, 0.0, None), (7, None, None, 0, 0.0, None)]
    df = spark.createDataFrame(p, "project_id long, asserted string, lifecycle string, run_events long, run_score double, last_meaningful timestamp")
    now = history.activity(df, F.lit("2024-01-31 12:00:00").cast("timestamp"))
    got = {r["project_id"]: (r["status"], r["activity_score"]) for r in now.collect()}
    assert got == {1: ("DORMANT", 10.0), 2: ("LOW_ACTIVITY", 48.0), 3: ("ACTIVE", 68.0), 4: ("ACTIVE", 85.0), 5: ("FROZEN", 95.0), 6: ("PAUSED", 100.0), 7: ("UNKNOWN", 20.0)}
    before = spark.createDataFrame([(1, "ACTIVE"), (3, "DORMANT"), (5, "ACTIVE"), (7, "ACTIVE")], "project_id long, status string")
    assert {tuple(r) for r in history.activity_transitions(before, now).collect()} == {(1, "PROJECT_BECAME_DORMANT"), (3, "PROJECT_BECAME_ACTIVE"), (5, "PROJECT_FROZEN"), (7, "PROJECT_ACTIVITY_STOPPED")}
    ev = spark.createDataFrame([(1, "VOLATILE", False, t(1)), (2, "VOLATILE", True, t(1)), (3, "LOW", False, t(1)), (4, "VOLATILE", False, t(31))], "event_id long, semantic_importance string, permanent boolean, occurred_at timestamp")
    assert [r["event_id"] for r in history.retention(ev, F.lit("2024-02-15 00:00:00").cast("timestamp")).collect()] == [1]
    snaps = spark.createDataFrame([("a", t(1)), ("b", t(5)), ("c", t(9))], "snapshot_id string, created_at timestamp")
    pick = lambda d: history.snapshot_as_of(snaps, F.lit(f"2024-01-{d:02d} 00:00:00").cast("timestamp")).first()[0]
    assert (pick(6), pick(9)) == ("b", "c")
    assert history.snapshot_as_of(snaps, F.lit("2023-01-01").cast("timestamp")).first()[0] == "a"


def test_matching(spark):
    rows = spark.createDataFrame([("a/b/c.txt",), ("a/x.txt",), ("z/y.txt",), ("ab/q.txt",)], "p string")
    roots = spark.createDataFrame([("a", 1), ("a/b", 2)], "root string, id long")
    assert {r["p"]: r["id"] for r in matching.longest_prefix(rows, roots, "p", "root").collect()} == {"a/b/c.txt": 2, "a/x.txt": 1, "z/y.txt": None, "ab/q.txt": None}
    t = spark.createDataFrame([("n", "k1"), ("m", "k2"), ("m", "k3")], "name string, key string")
    assert {r["name"]: r["key"] for r in matching.unique_match(spark.createDataFrame([("n",), ("m",)], "name string"), t, "name", "key").collect()} == {"n": "k1", "m": None}
    a = spark.createDataFrame([("u", 5), ("u", 1), ("v", 9)], "k string, at long")
    f = spark.createDataFrame([("u", 2, "x"), ("u", 5, "y"), ("u", 7, "z")], "k string, at long, value string")
    assert {(r["k"], r["at"]): r["value"] for r in matching.latest_at(a, f, "k", "at").collect()} == {("u", 5): "y", ("u", 1): None, ("v", 9): None}


def test_files(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "a" / "logs").mkdir(parents=True)
    (tree / "a" / "x.md").write_text("# T\n[l](y.md)")
    (tree / "a" / "logs" / "r.log").write_text("noise")
    big = bytearray(400_000)
    (tree / "one.bin").write_bytes(big)
    big[200_000] = 1
    (tree / "two.bin").write_bytes(big)
    with zipfile.ZipFile(tree / "d.docx", "w") as z:
        z.writestr("word/document.xml", "<w><p>Hello</p><p>there</p></w>")
    (tree / "bad.docx").write_bytes(b"no zip")
    (tree / "n.ipynb").write_text(json.dumps({"cells": [{"cell_type": "code", "source": ["x = 1\n", "y"]}, {"cell_type": "raw", "source": ["no"]}]}))
    scanned = files.scan_files(spark, str(tree), with_content=True)
    got = {r["path"].rpartition("/")[2]: r for r in files.inspect_files(files.fingerprints(scanned)).collect()}
    assert len(got) == 7
    assert got["r.log"]["volatile_class"] == "runtime_log"
    assert got["d.docx"]["text"] == "Hello there"
    assert got["d.docx"]["magic"] == "zip"
    assert got["bad.docx"]["error"]
    assert got["n.ipynb"]["text"] == "x = 1\ny"
    assert got["one.bin"]["sample_fingerprint"] != got["two.bin"]["sample_fingerprint"]
    assert "content" not in files.scan_files(spark, str(tree)).columns


def test_inventories_logs_and_reports(spark, tmp_path):
    row = ("a", "file", ".txt", "1", "", "", "PASS", "PASS", "", "")
    files.write_csv(spark.createDataFrame([row], ", ".join(f"{c} string" for c in files.INVENTORY_COLUMNS)), f"{tmp_path}/inv")
    inv = files.read_inventory(spark, f"{tmp_path}/inv")
    assert files.load_inventory_files(inv).count() == 1
    with pytest.raises(ValueError, match="repeated"):
        files.load_inventory_files(inv.union(inv))
    files.write_csv(spark.range(1), f"{tmp_path}/odd")
    with pytest.raises(ValueError, match="columns"):
        files.read_inventory(spark, f"{tmp_path}/odd")
    log = spark.createDataFrame([(1, datetime(2024, 1, 1)), (1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 2))], "event_id long, occurred_at timestamp")
    for _ in range(2):
        files.append_events(log, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    assert files.markdown_table(spark.createDataFrame([("x|y", 1)], "a string, b long"), ["a"]) == "| a | b |\n| --- | --- |\n| x\\|y | 1 |\n"
    (tmp_path / "d.json").write_text('{"a": 1}')
    assert files.json_document(spark, f"{tmp_path}/d.json") == {"a": 1}
    (tmp_path / "n.json").write_text('{"a": NaN}')
    with pytest.raises(ValueError, match="NaN"):
        files.json_document(spark, f"{tmp_path}/n.json")


def test_streams(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)

    def drain(df, mode):
        name = f"t{random.randrange(1 << 40)}"
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    n = batch.count()
    assert drain(streams.windowed_counts(streams.read_events(spark, src), size="1 day"), "complete").agg(F.sum("n")).first()[0] == n
    assert drain(streams.once(streams.read_events(spark, src)), "append").count() == n
    state = drain(streams.activity_state(streams.read_events(spark, src)), "update")
    assert state.agg(F.sum("events")).first()[0] == n
