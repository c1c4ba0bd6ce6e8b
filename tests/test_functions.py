"""Expressions over literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import checks, importance, paths, text


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return df.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(("path", "want"), [("a/b.TXT", ".txt"), ("a/run.cas.h5", ".cas.h5"), ("x.tar.gz", ".tar.gz"), (".x", ""), ("a.", ""), ("a/b", ""), ("a.b/c", ""), ("m.scdocx", ".scdocx")])
def test_extension(spark, path, want):
    assert one(spark, paths.extension(F.col("p")), p=path) == want


@pytest.mark.parametrize(("path", "want"), [("a/b.wal", "database_wal"), ("a/~$x.docx", "lock_file"), ("a/x.lockfile", "lock_file"), ("a/logs/x", "runtime_log"), ("chrome/x/History", "browser_state"), ("a/QQ/my.logs", "communication_runtime"), ("onedrive/sync", "cloud_metadata"), ("a/b.py", None)])
def test_volatile(spark, path, want):
    assert one(spark, paths.volatile_class(F.col("p")), p=path) == want


ROLES = [
    ("src/model.py", "code", "UNKNOWN", 0.45), ("a/readme.md", "documentation", "REFERENCE", 0.9), ("run/recovery/active.mph", "recovery", "ACTIVE", 0.82), ("run/checkpoint/a.mph", "checkpoint", "HISTORICAL", 0.82),
    ("tmp/a.csv", "temporary", "DERIVED", 0.84), ("old/rejected/a.docx", "rejected_route", "HISTORICAL", 0.76), ("raw/a.csv", "raw_data", "UNKNOWN", 0.82), ("my paper/a.docx", "manuscript", "UNKNOWN", 0.84),
    ("x/final_model.mph", "canonical_model", "CANONICAL", 0.86), ("x/official_notes.docx", "final", "CANONICAL", 0.86), ("x/official.log", "final", "DERIVED", 0.86), ("handoff/a.pdf", "deliverable", "CANONICAL", 0.84),
    ("delivery/a.pptx", "presentation", "CANONICAL", 0.84), ("a/b.xyz", "unknown", "UNKNOWN", 0.2), ("old/final.docx", "historical_provenance", "HISTORICAL", 0.76),
]


@pytest.mark.parametrize(("path", "role", "authority", "confidence"), ROLES)
def test_roles(spark, path, role, authority, confidence):
    got = one(spark, paths.asset_role(F.col("p"), paths.extension(F.col("p"))), p=path)
    assert (got["role"], got["authority"], got["confidence"]) == (role, authority, confidence)


def test_family_keys(spark):
    key = lambda p: one(spark, paths.family_key(F.col("p")), p=p)
    assert key("a/thermal_model_v2.docx") == key("b/thermal_model_final.docx") == ".docx|thermal model"
    assert key("a/report_v1.pdf") == "unique|a/report_v1.pdf"


SCORES = [("FILE_CREATED", None, None, 5 << 30, 0, 32.0), ("FILE_CHANGED", "CANONICAL", "manuscript", 0, 3, 94.0), ("FILE_COPIED", "UNKNOWN", "working_model", 1 << 30, 0, 52.0), ("POSSIBLE_ASSET_LOSS", "CANONICAL", "canonical_model", 5 << 30, 100, 100.0), ("OTHER", None, "final", 0, 0, 22.0)]


@pytest.mark.parametrize(("kind", "authority", "role", "size", "n", "want"), SCORES)
def test_importance(spark, kind, authority, role, size, n, want):
    df = spark.createDataFrame([(kind, authority, role, size, n)], "k string, a string, r string, s long, n long")
    args = [F.col(c) for c in "karsn"]
    no = F.lit(False)
    assert df.select(importance.score(*args, no, no, no)).first()[0] == want
    assert df.select(importance.score(*args, no, no, F.lit(True))).first()[0] == 0.0
    assert df.select(importance.score(*args, F.lit(True), no, no)).first()[0] <= want


def test_compare(spark):
    rows = [("lt", 1.0, 2.0, None, True), ("lte", 2.0, 2.0, None, True), ("eq", 2.0, 2.0, None, True), ("gte", 1.0, 2.0, None, False), ("gt", 3.0, 2.0, None, True), ("between", 3.0, 2.0, 3.0, True), ("odd", 1.0, 1.0, None, None), ("lt", math.nan, 2.0, None, None)]
    df = spark.createDataFrame(rows, "op string, v double, low double, high double, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", checks.compare(F.col("v"), F.col("op"), F.col("low"), F.col("high"))).collect())


def test_relative_difference(spark):
    rel = lambda a, b, ref: one(spark, checks.relative_difference(F.col("a"), F.col("b"), ref), a=a, b=b)
    assert (rel(0.0, 0.0, "case-a"), rel(0.0, 1.0, "case-a"), rel(2.0, 1.0, "max-absolute"), rel(2.0, 1.0, "case-b")) == (0.0, None, 0.5, 1.0)


def test_globs(spark):
    hit = lambda p, g, fold=False: one(spark, text.any_glob(F.col("p"), [g], fold), p=p)
    assert hit("a/b/c.py", "*.py")
    assert hit("excluded/x/y", "excluded/**")
    assert not hit("excluded", "excluded/**")
    assert not hit("A/b.PY", "*.py")
    assert hit("A/b.PY", "*.py", True)
    assert hit("x1.txt", "x[0-9].txt")
    assert not hit("xa.txt", "x[!a-z].txt")


def test_references_and_authority(spark):
    doc = "# Authoritative model\n- `models/final.mph` is it\n- plain item\n# Notes\n- `other.csv`\nThe canonical file is 'a.csv'.\nnot canonical: `b.csv`\nsee [x](c.md), [x](c.md) and file:///C:/d.txt\r\n`old.csv` is superseded by `new.csv`"
    lines = text.lines(spark.createDataFrame([(1, doc), (2, None)], "id long, t string"), "id", "t")
    refs = {(r["line_no"], r["target"]) for r in text.references(lines, "id").collect()}
    assert {(2, "models/final.mph"), (5, "other.csv"), (6, "a.csv"), (8, "c.md"), (9, "old.csv"), (9, "new.csv")} <= refs
    said = {r["line_no"]: (r["section"], r["targets"], r["confidence"]) for r in text.authority_declarations(lines, "id").collect()}
    assert said == {1: (None, [], 0.82), 2: ("Authoritative model", ["models/final.mph"], 0.98), 6: (None, ["a.csv"], 0.97)}
    assert [(r["predecessor"], r["successor"]) for r in text.supersessions(lines, "id").collect()] == [("old.csv", "new.csv")]


def test_findings(spark):
    doc = 'mail me@example.org\nC:\\Users\\x\npassword = "hunter2hunter2"\nghp_abcdefghijklmnop1234 wxid_abcdef \'qq_id\': 123456'
    got = {r["category"]: r["line_numbers"] for r in text.findings(text.lines(spark.createDataFrame([(1, doc)], "id long, t string"), "id", "t"), "id", text.PRIVACY_PATTERNS).collect()}
    assert got == {"email": [1], "windows_path": [2], "credential": [3], "known_token": [4], "wxid": [4], "qq_field": [4]}
