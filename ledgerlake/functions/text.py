"""Line-wise text: references, sections, findings. One line table feeds all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Patterns of references in prose, the first group (or all) being the target.
REFERENCE_PATTERNS = [
    (r"(?<![A-Za-z0-9_])([A-Za-z]:[\\/][^\r\n\"'<>|*?]+)", 1),
    (r"(?i)file:///[A-Za-z]:/[^\s\"'<>]+", 0),
    (r"[\"']([^\"'\r\n]{1,600}\.[A-Za-z0-9.]{1,12})[\"']", 1),
    (r"\[[^\]]*\]\(([^)\r\n]{1,600})\)", 1),
    (r"`([^`\r\n]{1,600}\.[A-Za-z0-9.]{1,12})`", 1),
    (r"`([^`\r\n]{1,600}[\\/])`", 1),
]
# Patterns of private content. The first two need look-behind; the plain ones do without.
PRIVACY_PATTERNS = {
    "windows_path": r"(?<![A-Za-z0-9])[A-Za-z]:[\\/](?:[^\s<>:\"|?*]+[\\/])*[^\s<>:\"|?*]*",
    "email": r"(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![\w.-])",
    "credential": r"(?i)(?:api[_-]?key|password|secret|access[_-]?token)\s*[:=]\s*['\"][^'\"\s]{8,}['\"]",
    "known_token": r"(?:ghp_|github_pat_|sk-)[A-Za-z0-9_-]{16,}",
    "wxid": r"(?i)wxid_[A-Za-z0-9_-]{5,}",
    "qq_field": r"(?i)['\"]?qq[_-]?id['\"]?\s*[:=]\s*['\"]?[1-9][0-9]{4,11}['\"]?",
}
# Absolute paths, lines of authority and of succession.
WINDOWS_ABSOLUTE = r"(?<![A-Za-z0-9_])[A-Za-z]:[\\/][^\s\"'<>]+"
POSIX_ABSOLUTE = r"(?<![A-Za-z0-9_])/(?:home|Users|mnt|var|tmp)/[^\s\"'<>]+"
AUTHORITY_LINE = (
    r"(?i)(canonical|authority|authoritative|source\s+of\s+truth|final\s+(?:model|manuscript|ppt|presentation)|"
    r"official\s+(?:model|document|presentation)|权威|正式(?:模型|稿件|报告|数据|文件|PPT|演示)|最终|基准模型|源模型).{0,240}"
)
NEGATED_AUTHORITY = (
    r"(?i)(not\s+(?:canonical|authoritative|final)|do\s+not\s+use|failed|failure|rejected|retired|"
    r"non.authoritative|not\s+as.{0,100}authorit|without.{0,80}authorit|authority\s+candidates?|"
    r"candidate\s+only|human\s+confirmation\s+required|confirm\s+whether|review\s+only|reject(?:ed)?|"
    r"不可作为|不能作为|非权威|失败|废弃|淘汰)"
)
SUPERSESSION = r"(?i)superseded\s+by|replaced\s+by|replaces?|取代|替代"
LINE_BREAK = r"\r\n|\r|\n"


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line)."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), LINE_BREAK)).alias("_p", "line")).select(key, (F.col("_p") + 1).alias("line_no"), "line")


def references(line_table: DataFrame, key: str) -> DataFrame:
    """(key, line_no, target): every candidate reference once per line, stripped."""
    found = F.flatten(F.array(*[F.regexp_extract_all("line", F.lit(p), F.lit(g)) for p, g in REFERENCE_PATTERNS]))
    one = line_table.select(key, "line_no", F.explode(found).alias("target"))
    return one.select(key, "line_no", F.regexp_replace("target", r"^[`\s,;:)]+|[`\s,;:)]+$", "").alias("target")).where("target <> ''").distinct()


def authority_declarations(line_table: DataFrame, key: str) -> DataFrame:
    """Lines that declare an authority: by their own words, or as list items with a reference in an authority section.

    A heading opens or closes the section; it holds for the lines after it, up to the next heading.
    """
    is_heading = F.startswith(F.trim("line"), F.lit("#"))
    says = F.rlike("line", F.lit(AUTHORITY_LINE)) & ~F.rlike("line", F.lit(NEGATED_AUTHORITY))
    title = F.trim(F.regexp_replace(F.trim("line"), "^#+", ""))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(is_heading, F.struct(F.when(says, title).alias("title"))), ignorenulls=True).over(w)["title"]
    t = line_table.withColumns({"direct": says, "section": section, "item": F.rlike(F.trim("line"), F.lit(r"^[-*+|]"))})
    refs = references(line_table, key).groupBy(key, "line_no").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    t = t.join(refs, [key, "line_no"], "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))
    in_section = F.col("section").isNotNull() & F.col("item") & (F.size("targets") > 0)
    t = t.where((F.col("direct") | in_section) & ~F.rlike("line", F.lit(NEGATED_AUTHORITY)))
    confidence = F.when(in_section, 0.98).when(F.size("targets") > 0, 0.97).otherwise(0.82)
    return t.select(key, "line_no", F.when(in_section, F.col("section")).alias("section"), F.substring(F.trim("line"), 1, 500).alias("excerpt"), "targets", confidence.alias("confidence"))


def supersessions(line_table: DataFrame, key: str) -> DataFrame:
    """(key, line_no, predecessor, successor): first and last of at least two references on a line of succession.

    The order of references in a line is that of their places in it.
    """
    hit = line_table.where(F.rlike("line", F.lit(SUPERSESSION)))
    refs = references(hit, key).join(hit, [key, "line_no"]).withColumn("at", F.instr("line", F.col("target")))
    both = refs.groupBy(key, "line_no").agg(F.min_by("target", F.struct("at", "target")).alias("predecessor"), F.max_by("target", F.struct("at", "target")).alias("successor"))
    return both.where("predecessor <> successor")


def findings(line_table: DataFrame, key: str, patterns: dict[str, str]) -> DataFrame:
    """(key, category, hits, line_numbers) per category that has a hit; contents are not repeated."""
    per = F.array(*[F.struct(F.lit(c).alias("category"), F.regexp_count("line", F.lit(p)).cast("long").alias("hits")) for c, p in patterns.items()])
    one = line_table.select(key, "line_no", F.explode(F.filter(per, lambda x: x["hits"] > 0)).alias("f"))
    return one.groupBy(key, F.col("f.category").alias("category")).agg(F.sum("f.hits").alias("hits"), F.array_sort(F.collect_set("line_no")).alias("line_numbers"))


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression; * and ? cross slashes."""
    out, i = "", 0
    while i < len(glob):
        c, i = glob[i], i + 1
        if c == "[" and (end := glob.find("]", i + 1)) > 0:
            body, i = glob[i:end].replace("\\", "\\\\"), end + 1
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
        else:
            out += {"*": "(?s:.*)", "?": "(?s:.)"}.get(c) or ("\\" + c if c in r"\.^$+{}()|[]" else c)
    return f"^{out}$"


def any_glob(path: Column, globs: list[str], fold: bool = False) -> Column:
    path = F.lower(path) if fold else path
    hits = [F.rlike(path, F.lit(glob_pattern(g.lower() if fold else g))) for g in globs]
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out


# Names of files in prose.
FILE_NAME_TOKEN = (
    r"(?i)(?<![\w])([\w\-+.()一-鿿]{3,}\.(?:mph|cas(?:\.h5)?|dat(?:\.h5)?|msh(?:\.h5)?|docx|pptx|pdf|"
    r"json|ya?ml|csv|xlsx|py|m|java|md|txt|zip|scdocx?|step|stp))(?![\w])"
)


def file_names_in(line_table: DataFrame, key: str) -> DataFrame:
    """(key, line_no, name): file names in running text, each once a line."""
    return line_table.select(key, "line_no", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(FILE_NAME_TOKEN), F.lit(1)))).alias("name"))


def human_size(value: Column) -> Column:
    """A size with one decimal in the largest of B to TiB that leaves at least 1."""
    v = value.cast("double")
    # Ties go to the even digit. A size over a power of two, times ten, is exact, so they can be seen.
    at = lambda n, unit: F.concat(F.format_string("%.1f", F.rint(v / float(1024**n) * 10) / 10), F.lit(f" {unit}"))
    out = F.when(v < 1024, at(0, "B"))
    for n, unit in enumerate(("KiB", "MiB", "GiB"), 1):
        out = out.when(v < float(1024 ** (n + 1)), at(n, unit))
    return out.otherwise(at(4, "TiB"))


def html_escaped(value: Column) -> Column:
    """Text for HTML; null is empty."""
    out = F.coalesce(value, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def markdown_escaped(value: Column) -> Column:
    """Text for a cell of a Markdown table; null is empty."""
    return F.replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"\r\n|\r|\n", " "), F.lit("|"), F.lit("\\|"))


def iso_time(value: Column) -> Column:
    """An ISO 8601 time as a timestamp: Z and offsets count, none is UTC (the session's zone); null where it is none."""
    fine = F.when(F.rlike(value, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$")), value)
    return F.try_to_timestamp(fine)


def iso_text(value: Column) -> Column:
    """A timestamp as ISO 8601 in UTC, whole seconds."""
    return F.date_format(F.to_utc_timestamp(value, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def dotted(json: Column, path: str) -> Column:
    """Struct (found, value) of a dotted path in JSON text: a null that is there is found, a step into what is no object finds nothing."""
    head, _, last = path.rpartition(".")
    parent = F.get_json_object(json, f"$.{head}" if head else "$")
    found = F.coalesce(F.array_contains(F.json_object_keys(parent), last), F.lit(False))
    return F.struct(found.alias("found"), F.get_json_object(json, f"$.{path}").alias("value"))
