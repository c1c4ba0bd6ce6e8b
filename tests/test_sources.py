"""Scans, inventories, catalogs and writers over files of their own."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import paths
from ledgerlake.functions.text import any_glob
from ledgerlake.operators import maintenance
from ledgerlake.sources import files
from ledgerlake.sources.catalog import Catalog
from ledgerlake.sources.reports import Section, markdown, page


def write(root, names):
    for n, text in names.items():
        p = root / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


TREE = {"a/x.py": "print()", "a/__init__.py": "", "a/.env": "x", "a/.git/config": "no", "a/node_modules/m/i.js": "12345", "a/node_modules/j.js": "1", "b/run.log": "log", "b/deep/Readme.md": "# hi", "b/deep/w.cas.h5": "wing"}


def test_scan_collapses_trees(spark, tmp_path):
    write(tmp_path, TREE)
    found, backend = files.scan(spark, str(tmp_path))
    assert backend == "filesystem"
    found = found.withColumn("path", F.regexp_replace("path", "^file:", ""))
    roots = files.scopes([f"{tmp_path}/a", f"{tmp_path}/b"], [f"{tmp_path}/b/", f"{tmp_path}/b/deep"])
    assert [r["kind"] for r in roots] == ["primary", "primary+communication", "communication"]
    rows = files.in_scopes(found, roots)
    assert {r["relative_path"]: (r["scope_kind"], r["volatile_class"], r["extension"]) for r in rows.collect()}["deep/w.cas.h5"] == ("primary+communication", None, ".cas.h5")
    kept, trees = files.collapse_trees(rows)
    assert {r["relative_path"] for r in kept.collect()} == {"x.py", "__init__.py", ".env", "run.log", "deep/Readme.md", "deep/w.cas.h5"}
    assert [(r["path"], r["kind"], r["total_size"], r["file_count"]) for r in trees.collect()] == [("node_modules", "javascript_dependencies", 6, 2)]
    with pytest.raises(ValueError, match="one root"):
        files.scopes([], [])


def test_scan_falls_back(spark, tmp_path):
    write(tmp_path, {**TREE, "index.json": json.dumps([{"name": f"{tmp_path}/a/x.py", "size": "", "date_modified": "1"}, {"name": "/elsewhere/y", "size": "3", "date_modified": "1"}])})
    found, backend = files.scan(spark, str(tmp_path), f"{tmp_path}/index.json")
    assert backend == "index"
    assert [(r["path"], r["size"]) for r in found.collect()] == [(f"{tmp_path}/a/x.py", 0)]
    assert files.scan(spark, str(tmp_path), f"{tmp_path}/none.json")[1] == "filesystem-fallback"
    with pytest.raises(ValueError, match="no index"):
        files.scan(spark, str(tmp_path), backend="index")


def test_inventory(spark, tmp_path):
    write(tmp_path, TREE)
    scanned = files.scan_files(spark, str(tmp_path), with_content=True).withColumn("relative_path", F.substring_index("path", f"{tmp_path}/", -1))
    inv = files.build_inventory(scanned, exclude=["*.LOG"], hash_mode="below-size", max_bytes=5)
    assert inv.columns == files.INVENTORY_COLUMNS
    rows = {r["relative_path"]: r for r in inv.collect()}
    assert rows["b/run.log"]["entry_kind"] == "excluded"
    assert (rows["b/run.log"]["scan_status"], rows["b/run.log"]["reason_codes"], rows["b/run.log"]["sha256"]) == ("SKIPPED", "EXCLUDED_BY_POLICY", "")
    assert rows["b/deep"]["entry_kind"] == "directory"
    assert rows["b/deep/w.cas.h5"]["sha256"] == hashlib.sha256(b"wing").hexdigest()
    assert (rows["a/.env"]["hash_status"], rows["a/.env"]["reason_codes"]) == ("PARTIAL", "HASH_READ_FAILED")
    assert (rows["b/deep/w.cas.h5"]["file_type"], rows["a/x.py"]["hash_status"]) == (".h5", "SKIPPED")
    assert rows["a/x.py"]["modified_at"].endswith("Z")
    files.write_csv(inv, f"{tmp_path}/inv")
    assert files.load_inventory_files(files.read_inventory(spark, f"{tmp_path}/inv")).count() == 7


def test_fingerprints_and_texts(spark, tmp_path):
    big = bytes(range(256)) * 1024
    write(tmp_path, {"big.bin": big, "small.txt": "tiny", "u.txt": "ü".encode("utf-16"), "g.txt": "中文a".encode("gb18030"), "p.pdf": b"%PDF-1.4", "h.h5": b"\x89HDF\r\n\x1a\n"})
    scanned = files.scan_files(spark, str(tmp_path), with_content=True)
    quick = {r["path"].rpartition("/")[2]: r["quick_fingerprint"] for r in files.quick_fingerprint(scanned).collect()}
    assert quick["small.txt"] == hashlib.sha256(b"4tiny").hexdigest()
    assert quick["big.bin"] == hashlib.sha256(str(len(big)).encode() + big[:65536] + big[-65536:]).hexdigest()
    text = {r["path"].rpartition("/")[2]: (r["text"], r["error"]) for r in files.inspect_files(scanned.where(~F.col("path").endswith("big.bin"))).collect()}
    assert text["small.txt"][0] == "tiny"
    assert text["u.txt"][0] == "ü"
    assert text["g.txt"][0] == "中文a"
    assert text["p.pdf"][0] is None
    assert text["h.h5"][1]


def test_writers(spark, tmp_path):
    files.write_json({"b": 1, "a": "é"}, f"{tmp_path}/o.json", spark)
    files.write_json({"b": 2, "a": "é"}, f"{tmp_path}/o.json", spark)
    assert (tmp_path / "o.json").read_text() == '{\n  "a": "é",\n  "b": 2\n}\n'
    with pytest.raises(ValueError, match="JSON compliant"):
        files.write_json({"a": float("nan")}, f"{tmp_path}/n.json", spark)
    assert files.digest_of({"b": 1, "a": 2, "digest": "x"}) == files.digest_of({"a": 2, "b": 1})
    rows = spark.createDataFrame([(1.0, 2.0, 0.1), (0.0, 1 / 3, 1e22)], "x double, y double, value double")
    assert [r["line"] for r in files.field_rows(rows, ["x", "y", "value"], ["y", "x"]).collect()] == ["0,0.33333333333333331,1e+22", "1,2,0.10000000000000001"]


def test_event_log(spark, tmp_path):
    e = lambda *ids: spark.createDataFrame([(i, f"2024-01-0{d} 00:00:00") for i, d in ids], "event_id string, at string").withColumn("occurred_at", F.to_timestamp("at")).drop("at")
    for batch in (e(("a", 1), ("b", 2)), e(("b", 2), ("c", 2)), e(("a", 1))):
        files.append_events(batch, f"{tmp_path}/log")
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/log").collect()) == ["a", "b", "c"]


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"{tmp_path}/cat")
    assert c.read("projects").count() == 0
    c.replace("projects", spark.createDataFrame([("p", "P")], "project_id string, name string"))
    c.replace("projects", c.read("projects").withColumn("name", F.lit("Q")))
    assert [r["name"] for r in Catalog(spark, f"{tmp_path}/cat").read("projects").collect()] == ["Q"]
    c.rollback("projects")
    assert [r["name"] for r in c.read("projects").collect()] == ["P"]
    with pytest.raises(ValueError, match="no earlier"):
        c.rollback("projects")
    assert c.migrate()["tables"] == []
    state = c._state()
    c._save({**state, "schema_version": 2})
    assert c.migrate() == {"from": 2, "to": 3, "tables": ["projects"]}
    assert (c._state()["schema_version"], c.versions("projects"), c.read("projects").count()) == (3, [1, 2], 1)


@pytest.mark.parametrize(("path", "key"), [("a/wing_iter3.cas.h5", ".cas.h5|wing cas"), ("b/wing_iter4.cas.h5", ".cas.h5|wing cas"), ("a/Thesis_final_v2.docx", ".docx|thesis"), ("a/report.md", "unique|a/report.md")])
def test_family_key(spark, path, key):
    assert spark.range(1).select(paths.family_key(F.lit(path))).first()[0] == key


@pytest.mark.parametrize(("rel", "ext", "kind"), [("a/b", None, "relative_path"), (None, "doi:10/x", "external_ref"), ("a", "doi:1", None), ("../a", None, None), (None, "x", None), (None, None, None)])
def test_locators(spark, rel, ext, kind):
    assert spark.range(1).select(paths.locator_kind(F.lit(rel).cast("string"), F.lit(ext).cast("string"))).first()[0] == kind


@pytest.mark.parametrize(("folder", "project", "name"), [("20240101_my-paper", "x", "my paper"), ("Wing_flutter", "wing", "flutter"), ("...", "x", "...")])
def test_workstream_name(spark, folder, project, name):
    assert spark.range(1).select(paths.workstream_name(F.lit(folder), F.lit(project))).first()[0] == name


def test_globs(spark):
    got = spark.createDataFrame([("A/b.PY",), ("c.txt",)], "p string").select(any_glob(F.col("p"), ["a/*.py"], fold=True)).collect()
    assert [r[0] for r in got] == [True, False]


def test_survivors_in_archives(spark):
    row = "path_key string, size long, sha256 string, sample string"
    lost = spark.createDataFrame([("a", 1, "h", "s"), ("b", 2, "x", "t"), ("c", 3, "y", "u")], row)
    here = spark.createDataFrame([("old/archive/a", 1, "h", "s"), ("new/a", 1, "h", "s"), ("k/b", 2, "z", "t")], row)
    got = {r["path_key"]: (r["survivor"], r["verified"]) for r in maintenance.surviving_copies(lost, here).collect()}
    assert got == {"a": ("new/a", True), "b": ("k/b", False), "c": (None, False)}


def test_reports(spark):
    rows = spark.createDataFrame([("b", 2, ["x", "y"]), ("a|<i>", None, []), ("c", 1, None)], "name string, n int, codes array<string>")
    parts = [Section("Found", rows, ["name"], ["read <only>"], limit=2), Section("Nothing", rows.where("n > 9"), ["name"])]
    text = markdown("Audit", parts)
    assert text == markdown("Audit", parts)
    assert text.splitlines() == ["# Audit", "", "## Found", "", "- read <only>", "", "| name | n | codes |", "| --- | --- | --- |", "| a\\|<i> |  |  |", "| b | 2 | x, y |", "", "1 more.", "", "## Nothing", "", "| name | n | codes |", "| --- | --- | --- |", "| none | | |"]
    assert "<td>a|&lt;i&gt;</td>" in page("Audit", parts)
    assert "read &lt;only&gt;" in page("Audit", parts)
