"""Change data: snapshot differences, identities, events, current state."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GIB, MIB = 1 << 30, 1 << 20


def diff(old: DataFrame, new: DataFrame, key: str = "path_key", compared: tuple[str, ...] = ("size", "modified")) -> DataFrame:
    """One full outer join of two snapshots (key, compared columns; old with status present or missing).

    change_type: NEW, REAPPEARED (was missing), CHANGED (a compared column differs), UNCHANGED, MISSING, or
    STILL_MISSING for rows carried forward. Both sides' columns come as before_* and after_*.
    """
    a = old.select(key, F.col("status").alias("_was"), *[F.col(c).alias(f"before_{c}") for c in compared])
    b = new.select(key, F.lit(True).alias("_now"), *[F.col(c).alias(f"after_{c}") for c in compared])
    j = a.join(b, key, "full_outer")
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}"))
    kind = (
        F.when(F.col("_was").isNull(), "NEW").when(F.col("_now").isNotNull() & (F.col("_was") == "missing"), "REAPPEARED")
        .when(F.col("_now").isNull() & (F.col("_was") == "missing"), "STILL_MISSING").when(F.col("_now").isNull(), "MISSING")
        .when(same, "UNCHANGED").otherwise("CHANGED")
    )
    return j.select(key, kind.alias("change_type"), *[f"{s}_{c}" for c in compared for s in ("before", "after")])


def diff_counts(changes: DataFrame) -> DataFrame:
    """One row of counts; a reappeared row counts as new too."""
    n = lambda *kinds: F.count_if(F.col("change_type").isin(*kinds)).cast("long")
    return changes.agg(n("NEW", "REAPPEARED").alias("new"), n("REAPPEARED").alias("reappeared"), n("CHANGED").alias("changed"), n("MISSING").alias("missing"), n("UNCHANGED").alias("unchanged"))


def aggregate_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Aggregates (key, total_size, file_count) of two snapshots: CREATED, REMOVED, SIZE_GROWTH, SIZE_SHRINK.

    A changed file count without a changed size is growth of 0.
    """
    a = old.select(key, F.col("total_size").alias("_s0"), F.col("file_count").alias("_n0"))
    b = new.select(key, F.col("total_size").alias("_s1"), F.col("file_count").alias("_n1"))
    j = a.join(b, key, "full_outer")
    delta = F.coalesce("_s1", F.lit(0)) - F.coalesce("_s0", F.lit(0))
    kind = F.when(F.col("_s0").isNull(), "AGGREGATE_CREATED").when(F.col("_s1").isNull(), "AGGREGATE_REMOVED").when(delta >= 0, "AGGREGATE_SIZE_GROWTH").otherwise("AGGREGATE_SIZE_SHRINK")
    moved = F.col("_s0").isNull() | F.col("_s1").isNull() | (F.col("_s0") != F.col("_s1")) | (F.col("_n0") != F.col("_n1"))
    return j.where(moved).select(key, kind.alias("event_type"), delta.cast("long").alias("size_delta"))


def change_events(changes: DataFrame) -> DataFrame:
    """Events of each change: (path_key, change_type, volatile, model_role, before_size, after_size) -> path_key, event_type, size_delta.

    One row makes several events in one pass. Volatile rows make none here; see collapse_volatile.
    """
    b, a = F.coalesce("before_size", F.lit(0)), F.coalesce("after_size", F.lit(0))
    d, kind = a - b, F.col("change_type")
    big = (a >= GIB) | (F.col("model_role") & (a >= GIB // 4))
    step = (F.abs(d) >= 64 * MIB) | (F.abs(d) * 4 >= F.greatest(F.lit(1), b))
    event = lambda when, name, delta: F.when(when, F.struct(F.lit(name).alias("event_type"), delta.cast("long").alias("size_delta")))
    made = F.array(
        event(kind == "NEW", "FILE_CREATED", a), event((kind == "NEW") & big, "LARGE_ASSET_CREATED", a), event(kind == "REAPPEARED", "FILE_REAPPEARED", a),
        event(kind == "CHANGED", "FILE_CHANGED", d), event((kind == "CHANGED") & step & (d > 0), "FILE_SIZE_GROWTH", d), event((kind == "CHANGED") & step & (d < 0), "FILE_SIZE_SHRINK", d),
        event(kind == "MISSING", "FILE_MISSING", -b), event((kind == "MISSING") & (b >= GIB), "LARGE_ASSET_REMOVED", -b),
    )
    return changes.where(~F.col("volatile")).select("path_key", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("e")).select("path_key", "e.*")


def collapse_volatile(changes: DataFrame) -> DataFrame:
    """One event per volatile class, whatever the number of files: aggregate_count and the size's change."""
    delta = F.coalesce("after_size", F.lit(0)) - F.coalesce("before_size", F.lit(0))
    return changes.where("volatile_class is not null").groupBy("volatile_class").agg(F.count("*").alias("aggregate_count"), F.sum(delta).cast("long").alias("size_delta"))


#: Keys that tell an identity, with the confidence that each gives.
IDENTITY_KEYS = [("native_id", 0.995, "native_file_metadata"), ("sha256", 1.0, "full_sha256"), ("sample", 0.96, "staged_fingerprint")]


class _Side:
    """Rows of one side in order, found by any of their keys; rows can be taken."""

    def __init__(self, rows: list[dict]):
        self.by: dict[str, dict[str, list[dict]]] = {k: {} for k, _, _ in IDENTITY_KEYS}
        self.taken: set[str] = set()
        for r in rows:
            for k, held in self.by.items():
                if r[k]:
                    held.setdefault(r[k], []).append(r)

    def best(self, t: dict, native: bool) -> tuple[float, dict, str] | None:
        """The surest free match of t; a row counts by the first of its keys that agrees, and of equals the first one."""
        found: list[tuple[float, dict, str]] = []
        agreed: list[str] = []
        for key, confidence, how in IDENTITY_KEYS:
            for r in self.by[key].get(t[key], ()) if t[key] else ():
                if r["path_key"] not in self.taken and r["path_key"] != t["path_key"] and not any(t[k] and r[k] == t[k] for k in agreed):
                    if native or key != "native_id":
                        found.append((confidence, r, how))
                    break
            agreed.append(key)
        return max(found, key=lambda f: f[0]) if found else None

    def take(self, r: dict) -> None:
        self.taken.add(r["path_key"])
        for k, held in self.by.items():
            if r[k]:
                held[r[k]].remove(r)


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """Arrivals in order take the best missing row of their size, else are copies, else may be weak candidates."""
    pdf = pdf.sort_values(["rank", "path_key"], kind="stable")
    miss, here, come = (pdf[pdf["side"] == s].to_dict("records") for s in ("missing", "present", "arrival"))
    gone, kept = _Side(miss), _Side(here)
    free, out = len(miss) + int(pdf["others"].iloc[0]), []
    folder = lambda p: p.rpartition("/")[0]
    name = lambda p: (lambda n: n.rpartition(".")[0] or n)(p.rpartition("/")[2]).casefold()
    for t in come:
        if found := gone.best(t, True):
            conf, s, how = found
            gone.take(s)
            free -= 1
            out.append(("RENAMED" if folder(s["path_key"]) == folder(t["path_key"]) else "MOVED", s["path_key"], t["path_key"], conf, how))
        elif found := kept.best(t, False):
            out.append(("COPIED", found[1]["path_key"], t["path_key"], found[0], found[2]))
        elif free == 1:
            last = next(s for s in miss if s["path_key"] not in gone.taken)
            if (ratio := SequenceMatcher(None, name(last["path_key"]), name(t["path_key"])).ratio()) >= 0.72:
                out.append(("POSSIBLE_MOVE", last["path_key"], t["path_key"], round(0.45 + 0.2 * ratio, 3), "weak_candidate"))
    return pd.DataFrame(out, columns=["event_type", "source_path_key", "target_path_key", "confidence", "method"])


def correlate_identities(rows: DataFrame) -> DataFrame:
    """Moves, renames, copies and weak candidates, greedy and one to one.

    rows: (side missing | present | arrival, path_key, size, native_id, sha256, sample, rank): rank is the order of arrival.
    Every match needs equal sizes, so groups of a size are independent, and exact. Only rows that can matter are grouped: of what is present, and of
    sizes with two missing rows or more that share no key with an arrival (no weak candidate can come of those), the rows that share a key with an arrival or a
    missing row. What is left of a group are files of one size that share keys, above all copies of one content.
    """
    cols = ["side", "path_key", "size", "native_id", "sha256", "sample", "rank"]
    rows = rows.select(*cols)
    keyed = rows.select("side", "path_key", "size", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k, _, _ in IDENTITY_KEYS])).alias("k")).where("k.value <> ''").select("side", "path_key", "size", "k.*")
    wanted = keyed.where("side = 'arrival'").select("size", "key", "value").distinct()
    offered = keyed.where("side <> 'arrival'").select("size", "key", "value").distinct()
    shares = keyed.where("side <> 'arrival'").join(wanted, ["size", "key", "value"], "left_semi").unionByName(keyed.where("side = 'arrival'").join(offered, ["size", "key", "value"], "left_semi")).select("side", "path_key", "size").distinct()
    tied = rows.join(shares, ["side", "path_key", "size"], "left_semi")
    loose = rows.where("side <> 'present'").join(shares, ["side", "path_key", "size"], "left_anti")
    lost = loose.groupBy("size").agg(F.count_if(F.col("side") == "missing").alias("lost"))
    sizes = rows.where("side = 'arrival'").select("size").distinct()
    held = tied.unionByName(loose.join(lost.where("lost < 2"), "size", "left_semi")).join(sizes, "size", "left_semi")
    held = held.join(lost.where("lost >= 2"), "size", "left").withColumn("others", F.coalesce("lost", F.lit(0)))
    return held.groupBy("size").applyInPandas(_greedy, "event_type string, source_path_key string, target_path_key string, confidence double, method string")


def exact_moves(missing: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Moves of contents (path_key, size, sha256) that are unique on both sides: two grouped counts and an equi-join, no Python."""
    only = lambda d, n: d.groupBy("size", "sha256").agg(F.count("*").alias("_n"), F.min("path_key").alias(n)).where("_n = 1").drop("_n")
    j = only(missing, "source_path_key").join(only(arrivals, "target_path_key"), ["size", "sha256"])
    folder = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    return j.select("source_path_key", "target_path_key", F.when(folder("source_path_key") == folder("target_path_key"), "RENAMED").otherwise("MOVED").alias("event_type"))


def copy_candidates(arrivals: DataFrame, present: DataFrame) -> DataFrame:
    """For each arrival the first present row (by path) of the same content, other than itself: the first path of each content, or the second where that is the arrival's own."""
    key = ["size", "sha256"]
    asked = present.join(arrivals.select(*key).distinct(), key, "left_semi")
    first = asked.groupBy(*key).agg(F.min("path_key").alias("_a"))
    second = asked.join(first, key).where(F.col("path_key") != F.col("_a")).groupBy(*key).agg(F.min("path_key").alias("_b"))
    j = arrivals.join(first, key).join(second, key, "left")
    other = F.when(F.col("_a") == F.col("path_key"), F.col("_b")).otherwise(F.col("_a"))
    return j.select(F.col("path_key").alias("target_path_key"), other.alias("source_path_key")).where("source_path_key is not null")


def survivors(missing: DataFrame, present: DataFrame) -> DataFrame:
    """How each missing row survives: verified by full hash, as a candidate by sample, or not."""
    full = present.where("sha256 is not null").select("size", "sha256").distinct().withColumn("_full", F.lit(True))
    sample = present.where("sample is not null").select("size", "sample").distinct().withColumn("_sample", F.lit(True))
    j = missing.join(full, ["size", "sha256"], "left").join(sample, ["size", "sample"], "left")
    return j.select("path_key", F.when(F.col("_full"), "content_copy_verified").when(F.col("_sample"), "content_copy_candidate").otherwise("unresolved_missing").alias("resolution"))


def latest_state(events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row per key in a total order."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def open_alerts(alerts: DataFrame, resolutions: DataFrame, key: str, at: str) -> DataFrame:
    """Alerts that no later resolution of the same key closes: a grouped maximum, not a pair for each event."""
    last = resolutions.groupBy(key).agg(F.max(at).alias("_last"))
    return alerts.join(last, key, "left").where(F.col("_last").isNull() | (F.col("_last") <= F.col(at))).drop("_last")


def merge_cards(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert by rewriting: new values where there are any, else the old ones."""
    cols = [c for c in old.columns if c != key]
    j = old.alias("o").join(new.alias("n"), key, "full_outer")
    return j.select(key, *[F.coalesce(F.col(f"n.`{c}`"), F.col(f"o.`{c}`")).alias(c) for c in cols])


def apply_assertions(inferred: DataFrame, assertions: DataFrame, key: str, field: str) -> DataFrame:
    """Explicit values (active ones, the latest per key) over inferred ones, with confidence 1."""
    latest = latest_state(assertions.where("active"), key, [F.desc("updated_at"), F.desc("value")]).select(key, F.col("value").alias("_value"))
    j = inferred.join(latest, key, "left")
    return j.withColumn("explicit_user", F.col("_value").isNotNull()).withColumn("confidence", F.when(F.col("_value").isNotNull(), 1.0).otherwise(F.col("confidence"))).withColumn(field, F.coalesce("_value", field)).drop("_value")
