"""URL filters with redirect equivalence. DataFrame functions only.

Explicit rules judge a url by host and path, the longest fitting rule first. Redirects and canonical links, read from
each page (or given as a table), join urls into classes of aliases, the connected components of these edges. A url that no
rule fits takes its class's decision: allowed if any alias is explicitly allowed, else blocked if any is
blocked, else allowed. A url's own rule always comes before what its aliases say.

Aliases are compared without scheme and fragment. Defined cases: a null url, or one without "://", has empty host and path,
fits no rule and has no aliases; equal urls get equal verdicts; a null page id is carried
like any other; no columns but id, url and html are read; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, components, filled, scratch

MAX_RULES = 1000
AFTER = r"(?s)^.*?://"
TAGS = r"(?i)<(?:link|meta)\b[^>]*>"
CANONICAL = r"""(?i)\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""
REFRESH_TO = r"""(?i)\bcontent\s*=\s*["']?\s*\d+\s*;\s*url\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(filled(url), AFTER + r"([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(filled(url), AFTER + r"[^/?#]*([^?#]*)", 1)


def alias_key(url: Column) -> Column:
    """Host, path and query; null without "://"."""
    key = F.concat(host_of(url), F.regexp_extract(filled(url), AFTER + r"[^/?#]*([^#]*)", 1))
    return F.when(F.instr(filled(url), "://") > 0, key)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does. rules: (host, path, verdict)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules are compiled into a plan")
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    cases = [
        F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1], r[2]))
    ]
    return F.coalesce(*cases)


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (a, b) between alias keys: canonical links and refresh redirects found in the pages."""
    tags = F.regexp_extract_all(filled(F.col(html_col)), F.lit(TAGS), F.lit(0))
    one = pages.select(F.col(url_col).alias("_url"), F.explode(tags).alias("_tag"))
    to = F.when(F.regexp_like("_tag", F.lit(CANONICAL)), F.regexp_extract("_tag", HREF, 1)).when(F.regexp_like("_tag", F.lit(REFRESH)), F.regexp_extract("_tag", REFRESH_TO, 1))
    one = scratch(one.select("_url", F.replace(to, F.lit("&amp;"), F.lit("&")).alias("_to"))).where("_to <> '' and instr(_url, '://') > 0")
    scheme = F.regexp_extract("_url", r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(F.col("_url")))
    folder = F.regexp_replace(path_of(F.col("_url")), r"[^/]*$", "")
    full = (
        F.when(F.instr("_to", "://") > 0, F.col("_to"))
        .when(F.startswith("_to", F.lit("//")), F.concat(scheme, F.lit(":"), F.col("_to")))
        .when(F.startswith("_to", F.lit("/")), F.concat(site, F.col("_to")))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), F.col("_to")))
    )
    return one.select(alias_key(F.col("_url")).alias("a"), alias_key(full).alias("b"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, by (rule, alias or default).

    redirects: further edges (from_url, to_url), for redirects that a crawler has followed.
    """
    edges = scratch(alias_edges(pages, url_col, html_col))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(alias_key(F.col("from_url")).alias("a"), alias_key(F.col("to_url")).alias("b")))
    classes = components(edges)
    # An alias key is host, path and query, so rules judge it as they judge a page.
    as_url = F.concat(F.lit("://"), F.col("node"))
    said = fitting_rule(host_of(as_url), path_of(as_url), rules).getField("verdict")
    judged = classes.select("node", "component", said.alias("said"))
    ruled = judged.where("said is not null").groupBy("component").agg(F.max(F.col("said") == "allow").alias("allowed"), F.max(F.col("said") == "block").alias("blocked"))
    decided = scratch(judged.join(ruled, "component").select(F.col("node").alias("_key"), F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("_alias")))
    own = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), alias_key(F.col(url_col)).alias("_key"))
    own = own.withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules))
    out = own.join(decided, "_key", "left")
    verdict = F.coalesce(F.col("_fit.verdict"), F.col("_alias"), F.lit("allow"))
    by = F.when(F.col("_fit.rule").isNotNull(), "rule").when(F.col("_alias").isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), verdict.alias("verdict"), by.alias("by"))
