"""Joins that need more than equality: prefixes, unique matches, references, sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.functions.paths import ancestors, resolved


def longest_prefix(rows: DataFrame, roots: DataFrame, path: str, root: str) -> DataFrame:
    """Left join of each path with the longest root that contains it: equality on exploded ancestors, best depth by a grouped maximum."""
    keyed = rows.select(path).distinct().withColumn("_anc", F.explode(ancestors(F.col(path))))
    met = keyed.join(roots, keyed["_anc"] == roots[root])
    cols = [F.col(c) for c in roots.columns]
    best = met.groupBy(path).agg(F.max_by(F.struct(*cols), F.struct(F.length("_anc"), F.col("_anc"))).alias("_r")).select(path, "_r.*")
    return rows.join(best, path, "left")


def unique_match(rows: DataFrame, targets: DataFrame, key: str, value: str) -> DataFrame:
    """Left join on keys that name exactly one target."""
    one = targets.groupBy(key).agg(F.count("*").alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")
    return rows.join(one, key, "left")


def resolve_references(references: DataFrame, files: DataFrame, target: str, path: str) -> DataFrame:
    """References with their status: unresolved ones stay."""
    known = files.select(F.col(path).alias(target)).distinct().withColumn("_known", F.lit(True))
    return references.join(known, target, "left").withColumn("resolution_status", F.when(F.col("_known"), "resolved_existing").otherwise("resolved_missing")).drop("_known")


def in_degree(edges: DataFrame, target: str) -> DataFrame:
    return edges.groupBy(target).agg(F.count("*").alias("in_degree"))


def compare_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of the intersection and both differences of two key sets, and whether they are equal."""
    j = left.select(key).distinct().withColumn("_l", F.lit(1)).join(right.select(key).distinct().withColumn("_r", F.lit(1)), key, "full_outer")
    both, l, r = F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()), F.count_if(F.col("_r").isNull()), F.count_if(F.col("_l").isNull())
    return j.agg(both.alias("common"), l.alias("only_left"), r.alias("only_right"), ((l == 0) & (r == 0)).alias("equal"))


def duplicates(rows: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Rows whose keys are there more than once: how many there are, and the first path of the group. Groups are counted, not gathered."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(path).alias("first")).where("n > 1")
    return rows.join(groups, keys).select(*keys, path, "n", "first")


def staged_duplicates(rows: DataFrame, path: str, rank: list[Column]) -> DataFrame:
    """Equal contents by size, sample, then full hash: later stages only see rows that share what comes before.

    The first row in the order of rank is its group's canonical one.
    """
    shared = lambda d, keys: d.join(d.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), keys, "left_semi")
    same = shared(shared(rows, ["size"]), ["size", "sample"])
    w = Window.partitionBy("size", "sha256")
    out = same.withColumn("group_size", F.count("*").over(w)).where("group_size > 1")
    return out.withColumn("canonical", F.first(path).over(w.orderBy(*rank)))


def version_families(rows: DataFrame, family: str, order: list[Column], path: str) -> DataFrame:
    """Rank within each family of more than one, and the row that supersedes all but the first."""
    w = Window.partitionBy(family)
    ranked = rows.withColumns({"family_size": F.count("*").over(w), "family_rank": F.row_number().over(w.orderBy(*order)), "_top": F.first(path).over(w.orderBy(*order))})
    return ranked.where("family_size > 1").withColumn("superseded_by", F.when(F.col("family_rank") > 1, F.col("_top"))).drop("_top")


def superseded(rows: DataFrame, family: str, order: list[Column], path: str) -> DataFrame:
    """Members of families of more than one, and which member supersedes them, under conditions.

    rows: (path, family, folder, strong, version_signalled, historical, and optionally workstream). Strong members are never superseded; others are if they are historical, or
    if they share the first member's folder or line of work and a name tells of versions.
    """
    w = Window.partitionBy(family)
    here = [c for c in ("folder", "workstream") if c in rows.columns]
    top = F.first(F.struct(F.col(path).alias("path"), "version_signalled", *here)).over(w.orderBy(*order))
    ranked = rows.withColumns({"_n": F.count("*").over(w), "_rank": F.row_number().over(w.orderBy(*order)), "_top": top}).where("_n > 1")
    same = F.lit(False)
    for c in here:
        same = same | F.coalesce(F.col(c) == F.col(f"_top.{c}"), F.lit(False))
    lost = (F.col("_rank") > 1) & ~F.col("strong") & (F.col("historical") | (same & (F.col("version_signalled") | F.col("_top.version_signalled"))))
    return ranked.withColumn("superseded_by", F.when(lost, F.col("_top.path"))).drop("_n", "_rank", "_top")


def latest_at(rows: DataFrame, facts: DataFrame, key: str, at: str) -> DataFrame:
    """As-of join: each row with the latest fact of its key at or before its time (facts: key, at, value).

    Both sides go through one window, sorted within keys; no row meets more than the last fact.
    """
    a = rows.withColumns({"_side": F.lit(1), "_fact": F.lit(None).cast(dict(facts.dtypes)["value"])})
    b = facts.select(*[F.col(c) if c in (key, at) else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes], F.lit(0).alias("_side"), F.col("value").alias("_fact"))
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("value", F.last("_fact", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_fact")


def contained_phrases(docs: DataFrame, phrases: DataFrame, doc: str, phrase: str, text: str = "text", head: int = 8) -> DataFrame:
    """(doc, phrase): which texts hold which phrases whole, as runs of words between single blanks. Phrases may have any length.

    Hashes of a phrase's first words (`head`, or all of a shorter one) meet those of all runs of as many words; what meets is compared in full.
    """
    p = phrases.select(phrase, F.col(text).alias("_phrase")).where("_phrase is not null").withColumn("_n", F.least(F.size(F.split("_phrase", " ")), F.lit(head)))
    p = p.withColumn("_h", F.xxhash64("_n", F.array_join(F.slice(F.split("_phrase", " "), F.lit(1), F.col("_n")), " ")))
    sizes = [r["_n"] for r in p.select("_n").distinct().collect()]  # at most `head` values
    w = docs.select(doc, F.col(text).alias("_text"), F.split(text, " ").alias("_w")).where("_w is not null")

    def runs_of(n: int) -> Column:
        starts = F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice("_w", i, F.lit(n)), " ")))

    runs = [runs_of(n) for n in sorted(sizes)]
    if not runs:
        return docs.where("false").select(doc, F.lit(None).cast(dict(phrases.dtypes)[phrase]).alias(phrase))
    keys = w.select(doc, F.explode(F.array_distinct(F.concat(*runs))).alias("_h"))
    met = keys.join(p.select(phrase, "_phrase", "_h"), "_h").select(doc, phrase, "_phrase").distinct()
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return met.join(docs.select(doc, F.col(text).alias("_text")), doc).where(F.contains(padded(F.col("_text")), padded(F.col("_phrase")))).select(doc, phrase).distinct()


# Extensions of what a reference may name.
REFERENCE_EXTENSIONS = [
    ".py", ".ps1", ".bat", ".cmd", ".md", ".txt", ".json", ".yaml", ".yml",
    ".xml", ".java", ".ipynb", ".csv", ".mph", ".cas", ".h5", ".dat",
    ".msh", ".docx", ".pptx", ".pdf", ".xlsx", ".mat", ".zip", ".step",
    ".stp", ".scdoc", ".scdocx", ".png", ".jpg", ".jpeg", ".svg", ".gif",
]


def place_references(references: DataFrame, files: DataFrame, target: str, source: str, path: str) -> DataFrame:
    """References (source, target) with the path that they mean and their status.

    Absolute targets, and file: ones without their scheme, stand for themselves. Others lie beside their source, or below the root if they are only there; known files and
    the folders above them exist. What ends in an extension that no file of interest has is not_file_like and has no path.
    """
    known = files.select(F.explode(ancestors(F.col(path))).alias("_at")).distinct().withColumn("_in", F.lit(True))
    bare = F.regexp_replace(F.regexp_replace(target, r"(?i)^file:/+([A-Za-z]:)", "$1"), r"(?i)^file://", "")
    own = references.select(source, target).distinct().withColumn("_t", F.when(F.rlike(bare, F.lit("^[A-Za-z]:")), F.replace(bare, F.lit("\\"), F.lit("/"))).otherwise(bare))
    whole = F.rlike("_t", F.lit("^(/|[A-Za-z]:)"))
    own = own.withColumns({"_near": F.when(whole, F.col("_t")).otherwise(resolved(F.concat(F.regexp_replace(source, r"[^/]*$", ""), F.col("_t")))), "_root": F.when(~whole, resolved(F.col("_t")))})
    j = own.join(known.select(F.col("_at").alias("_near"), F.col("_in").alias("_n")), "_near", "left").join(known.select(F.col("_at").alias("_root"), F.col("_in").alias("_r")), "_root", "left")
    there = F.col("_n").isNotNull() | F.col("_r").isNotNull()
    last = F.lower(F.regexp_extract(F.regexp_replace("_t", "[#?].*$", ""), r"[^/.][^/]*(\.[^./]+)$", 1))
    odd = (last != "") & ~last.isin(REFERENCE_EXTENSIONS) & ~there
    at = F.when(F.col("_n").isNull() & F.col("_r").isNotNull(), F.col("_root")).otherwise(F.col("_near"))
    return j.select(source, target, F.when(~odd, at).alias("resolved"), F.when(odd, "not_file_like").when(there, "resolved_existing").otherwise("resolved_missing").alias("resolution_status"))
