"""Projects: which files belong to them, their parts, what state they are in, and the lists drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import paths

# Folder names of provenance and deliverables, of no meaning, and of a line of work.
PROVENANCE_HINTS = ["audit", "archive", "backup", "history", "historical", "transfer_audit"]
DELIVERABLE_HINTS = ["handin", "handoff", "deliverable", "delivery", "submission"]
GENERIC_WORKSTREAMS = ["src", "code", "data", "docs", "figures", "results", "output", "inputs", "scripts", "models", "readme", "management", "archive", "temp", "tmp", "render", "cache"]
WORKSTREAM_HINTS = r"(?i)journal|paper|manuscript|rebuild|extension|conference|oral|poster|set\d{4}|experiment|simulation|analysis|revision|submission|response|会议|论文|实验|仿真|重建|扩展"
# State by words in a folder's name, with their weight; and by what a status document says.
FOLDER_STATES = [
    ("ACTIVE", "active|current|rebuild|recovery|进行中|当前", 6),
    ("COMPLETED", "completed|submitted|accepted|已完成|定稿", 7),
    ("FROZEN", "frozen|conference|oral|poster|冻结", 6),
    ("HISTORICAL", "historical|archive|legacy|rejected|历史|废弃", 7),
]
SAID_STATE = r"(?im)(?:status|lifecycle|state|状态|阶段)\s*[:=：-]\s*\**(active|completed|complete|frozen|historical|blocked|preflight_blocked|进行中|已完成|冻结|历史|阻塞)"
SAID_STATES = {
    "active": "ACTIVE",
    "进行中": "ACTIVE",
    "completed": "COMPLETED",
    "complete": "COMPLETED",
    "已完成": "COMPLETED",
    "frozen": "FROZEN",
    "冻结": "FROZEN",
    "historical": "HISTORICAL",
    "历史": "HISTORICAL",
    "blocked": "BLOCKED",
    "preflight_blocked": "BLOCKED",
    "阻塞": "BLOCKED",
}
ACTIVE_PHASE = r"(?i)active\s+phase|当前(?:活跃|阶段).{0,30}(?:active|进行)"
ACTIVE_PROSE = r"(?i)\b(?:is|remains|currently)\s+active\b|\bactive\s+(?:work|research|development)\b|进行中"
FINAL_NAME = "final|official|submitted|正式|最终"
ROOT_STATES = [
    ("ACTIVE", r"\b(?:active|ongoing|in progress)\b|进行中|当前.*(?:工作|研究)"),
    ("COMPLETED", r"\b(?:completed?|finished|finalized|submitted|accepted)\b|已完成|最终交付"),
    ("FROZEN", r"\b(?:frozen|locked)\b|冻结"),
]
# Subjects by the words that name them, in this order.
DOMAIN_TERMS = {
    "steg": "STEG",
    "thermoelectric": "thermoelectric",
    "热电": "thermoelectric",
    "cold plate": "cold-plate",
    "cold-plate": "cold-plate",
    "冷板": "cold-plate",
    "comsol": "COMSOL simulation",
    "fluent": "Fluent/CFD",
    "cfd": "CFD",
    "topology optimization": "topology optimization",
    "拓扑优化": "topology optimization",
    "heat transfer": "heat-transfer",
    "传热": "heat-transfer",
}
IMPORTANT_AUTHORITIES = ["PRIMARY", "CANONICAL", "ACTIVE"]


def assign_projects(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files (path) below the first of the roots (root, ord) that contains them, with the project that the folders below it name.

    The first folder is the project, unless its name is a general one: then the second is, or none. Ancestors meet roots by equality.
    """
    keyed = files.select("path").distinct().withColumn("_at", F.explode(paths.ancestors(F.col("path"))))
    met = keyed.join(roots, keyed["_at"] == roots["root"]).groupBy("path").agg(F.min_by("root", F.struct("ord", "root")).alias("root"))
    folders = F.slice(F.split(F.substr(F.col("path"), F.length("root") + 2), "/"), 1, 1_000_000)
    held = F.slice(folders, F.lit(1), F.size(folders) - 1)
    generic = lambda c: F.lower(c).isin(paths.GENERIC_CONTAINERS)
    first, second = F.get(held, F.lit(0)), F.get(held, F.lit(1))
    name = F.when(~F.lower(first).isin(paths.EXCLUDED_DIRS), F.when(generic(first), second).otherwise(first))
    met = met.withColumn("project", F.when(~generic(name), name))
    key = F.concat(F.lit("project_"), F.substring(F.sha2(F.concat(paths.path_key(F.col("root")), F.lit("|"), F.lower("project")), 256), 1, 16))
    return files.join(met.withColumn("project_id", F.when(F.col("project").isNotNull(), key)), "path", "left")


def project_totals(assigned: DataFrame) -> DataFrame:
    return assigned.where("project_id is not null").groupBy("project_id").agg(F.min("project").alias("name"), F.count("*").alias("file_count"), F.sum("size").cast("long").alias("total_size"))


def first_prefix(rows: DataFrame, parts: DataFrame, path: str, root: str, order: str) -> DataFrame:
    """Left join of each path with the first, in an order, of the parts that contain it."""
    keyed = rows.select(path).distinct().withColumn("_at", F.explode(paths.ancestors(F.col(path))))
    best = keyed.join(parts, keyed["_at"] == parts[root]).groupBy(path).agg(F.min_by(F.struct(*parts.columns), F.struct(order, root)).alias("_p")).select(path, "_p.*")
    return rows.join(best, path, "left")


def workstreams(files: DataFrame, status_texts: DataFrame) -> DataFrame:
    """Folders (project, folder) that are lines of work, and their state.

    files: (project, path, size), paths relative to the project. status_texts: (project, folder, text), what status documents say of a folder.
    A folder counts if its name tells of work, or if it holds four files and 4 % of the project's; containers and general names don't. The state
    is that of the highest score, the first in the list of states at ties; without any it is UNKNOWN.
    """
    rows = files.withColumn("_p", F.split("path", "/"))
    totals = rows.groupBy("project").agg(F.count("*").alias("_total"))
    low = F.lower("path")
    name = F.element_at("_p", -1)
    delivery = F.exists(F.slice("_p", F.lit(2), F.greatest(F.size("_p") - 2, F.lit(0))), lambda x: F.lower(x).isin("final_delivery", "final deliverable", "final_deliverable", "06_final_delivery"))
    delivery = delivery | ((F.size("_p") <= 3) & F.rlike(name, F.lit("(?i)^final.*report|final_deliverable_index")))
    held = rows.where(F.size("_p") > 1).groupBy("project", F.get("_p", F.lit(0)).alias("folder")).agg(
        F.count("*").alias("file_count"), F.sum("size").cast("long").alias("total_size"), F.sum(F.regexp_count(F.lower(name), F.lit(FINAL_NAME))).alias("_finals"), F.max(delivery).alias("_delivered")
    )
    plain = F.lower(F.regexp_replace("folder", r"^\d+[_\-. ]*", ""))
    folder = F.lower("folder")
    semantic = F.rlike("folder", F.lit(WORKSTREAM_HINTS))
    substantial = F.col("file_count") >= F.greatest(F.lit(4), F.floor(F.greatest("_total", F.lit(1)) * 0.04))
    held = held.join(totals, "project").where(~F.arrays_overlap(paths.tokens(plain), F.array(*[F.lit(x) for x in PROVENANCE_HINTS + DELIVERABLE_HINTS])) & ~plain.isin(GENERIC_WORKSTREAMS) & (semantic | substantial))
    said = status_texts.select("project", "folder", F.explode(F.regexp_extract_all("text", F.lit(SAID_STATE), F.lit(1))).alias("s"))
    said = said.select("project", "folder", paths.lookup(SAID_STATES, F.lower("s")).alias("s")).groupBy("project", "folder").agg(*[F.count_if(F.col("s") == x).alias(f"_said_{x}") for x in dict.fromkeys(SAID_STATES.values())])
    prose = status_texts.groupBy("project", "folder").agg(F.max(F.rlike("text", F.lit(ACTIVE_PHASE))).alias("_phase"), F.max(F.rlike("text", F.lit(ACTIVE_PROSE))).alias("_prose"))
    t = held.join(said, ["project", "folder"], "left").join(prose, ["project", "folder"], "left")
    if_ = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    score = {s: if_(F.rlike(folder, F.lit(words)), n) for s, words, n in FOLDER_STATES}
    for s in dict.fromkeys(SAID_STATES.values()):
        score[s] = score.get(s, F.lit(0)) + 10 * F.coalesce(f"_said_{s}", F.lit(0))
    two = F.col("_finals") >= 2
    score["ACTIVE"] = score["ACTIVE"] + if_(F.col("_phase"), 12) + if_(F.col("_prose"), 10)
    score["COMPLETED"] = score["COMPLETED"] + if_(two, 2) + if_(two & F.contains(folder, F.lit("extension")), 3) + if_(F.col("_delivered"), 12)
    score["FROZEN"] = score["FROZEN"] + if_(F.rlike(folder, F.lit("oral|conference|poster")) & F.contains(folder, F.lit("final")), 4)
    ranked = F.array(*[F.struct(n.cast("long").alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("state")) for i, (s, n) in enumerate(score.items())])
    t = t.withColumn("_best", F.array_max(ranked)).withColumn("score", F.col("_best.n"))
    state = F.when(F.col("score") > 0, F.col("_best.state")).otherwise("UNKNOWN")
    confidence = F.round(F.least(F.lit(0.94), 0.52 + 0.08 * F.col("score") + F.when(semantic, 0.08).otherwise(0.0)), 3)
    return t.select("project", "folder", paths.workstream_name(F.col("folder"), F.col("project")).alias("name"), state.alias("lifecycle"), "score", confidence.alias("confidence"), "file_count", "total_size")


def project_lifecycle(projects: DataFrame, streams: DataFrame, root_texts: DataFrame) -> DataFrame:
    """projects (project): MIXED with two states or more among its lines of work; else those of its root's status documents (project, text) join in."""
    known = streams.where("lifecycle <> 'UNKNOWN'").groupBy("project").agg(F.collect_set("lifecycle").alias("_a"))
    hits = F.filter(F.array(*[F.when(F.rlike(F.lower("text"), F.lit(p)), s) for s, p in ROOT_STATES]), lambda x: x.isNotNull())
    said = root_texts.select("project", F.explode(hits).alias("s")).groupBy("project").agg(F.collect_set("s").alias("_b"))
    none = F.array().cast("array<string>")
    t = projects.select("project").join(known, "project", "left").join(said, "project", "left")
    a, both = F.coalesce("_a", none), F.array_union(F.coalesce("_a", none), F.coalesce("_b", none))
    state = F.when((F.size(a) > 1) | (F.size(both) > 1), "MIXED").when(F.size(both) == 1, F.get(both, F.lit(0))).otherwise("UNKNOWN")
    return t.select("project", state.alias("lifecycle"))


def project_subjects(texts: DataFrame) -> DataFrame:
    """texts (project, text): the subjects that any of them names, in the order of the table, and the confidence that goes with their number."""
    hits = F.filter(F.array(*[F.when(F.contains(F.lower("text"), F.lit(n)), F.struct(F.lit(i).alias("i"), F.lit(s).alias("s"))) for i, (n, s) in enumerate(DOMAIN_TERMS.items())]), lambda x: x.isNotNull())
    one = texts.select("project", F.explode(hits).alias("h")).groupBy("project", F.col("h.s").alias("s")).agg(F.min("h.i").alias("i"))
    out = one.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("_h")).withColumn("subjects", F.transform("_h", lambda x: x["s"])).drop("_h")
    return out.withColumn("confidence", F.round(F.least(F.lit(0.92), 0.62 + 0.06 * F.size("subjects")), 3))


def role_groups(assets: DataFrame) -> DataFrame:
    """(project, workstream, role) -> count, the groups that hang below each line of work."""
    return assets.where("workstream is not null").groupBy("project", "workstream", "role").agg(F.count("*").alias("n"))


def tree_nodes(projects: DataFrame, streams: DataFrame, roles: DataFrame, folders: DataFrame) -> DataFrame:
    """(node, parent, node_type, label): projects, their lines of work, the role groups below those, and containers of provenance or deliverables."""
    top = projects.select(F.col("project").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("project").alias("node_type"), F.col("project").alias("label"))
    mid = streams.select(F.concat_ws("/", "project", "folder").alias("node"), F.col("project").alias("parent"), F.lit("workstream").alias("node_type"), F.col("name").alias("label"))
    low = roles.select(F.concat_ws("/", "project", "workstream", "role").alias("node"), F.concat_ws("/", "project", "workstream").alias("parent"), F.lit("asset_group").alias("node_type"), F.format_string("%s (%d)", "role", "n").alias("label"))
    tok = paths.tokens(F.col("folder"))
    among = lambda words: F.arrays_overlap(tok, F.array(*[F.lit(w) for w in words]))
    kind = F.when(among(PROVENANCE_HINTS), "archive").when(among(DELIVERABLE_HINTS), "deliverable")
    side = folders.select("project", "folder").distinct().select(F.concat_ws("/", "project", "folder").alias("node"), F.col("project").alias("parent"), kind.alias("node_type"), F.col("folder").alias("label")).where("node_type is not null")
    return top.unionByName(mid).unionByName(low).unionByName(side)


# Joins of the catalog's tables


def asset_details(files: DataFrame, assets: DataFrame, projects: DataFrame) -> DataFrame:
    """Each file with its asset and that asset's project, where there are any."""
    return files.join(assets, "path_key", "left").join(projects, "project_id", "left")


def review_bytes(assets: DataFrame, files: DataFrame) -> DataFrame:
    """Bytes that present files of assets up for review take; `_` stands for any character, as in the pattern's own language."""
    asked = assets.where(F.col("archive_recommendation").like("REVIEW_%")).join(files.where("status = 'present'"), "path_key")
    return asked.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def with_activity(projects: DataFrame, activity: DataFrame) -> DataFrame:
    """Understood projects by name, with their activity or UNKNOWN."""
    known = projects.where("status = 'understood'").join(activity, "project_id", "left")
    return known.withColumn("activity_status", F.coalesce("activity_status", F.lit("UNKNOWN"))).orderBy(F.lower("name"), "project_id")


def named_events(events: DataFrame, projects: DataFrame) -> DataFrame:
    """Events with the names of their projects: the id where a project has none, and a name of their own for events without project."""
    j = events.join(projects.select("project_id", "name"), "project_id", "left")
    return j.withColumn("project_name", F.when(F.col("project_id").isNull(), "Unassigned / system aggregate").otherwise(F.coalesce("name", F.col("project_id").cast("string")))).drop("name")


def resolve_project(projects: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (value): the project of that id or, in any case, of that name; one each, ids before names, then the smallest id."""
    by_id = asked.join(projects, asked["value"] == projects["project_id"].cast("string")).select("value", "project_id", F.lit(0).alias("_o"))
    by_name = asked.join(projects, F.lower(asked["value"]) == F.lower(projects["name"])).select("value", "project_id", F.lit(1).alias("_o"))
    return by_id.unionByName(by_name).groupBy("value").agg(F.min_by("project_id", F.struct("_o", "project_id")).alias("project_id"))


def prefer_present(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: a present one if there is any, the first in order."""
    best = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct((F.col("status") != "present").cast("int"), F.col(order))).alias("_r"))
    return best.select("_r.*")


def content_matches(files: DataFrame) -> DataFrame:
    """Present files that share their content with others: how many others, and the first of them by path. Groups are counted, not paired."""
    here = files.where("status = 'present' and sha256 is not null")
    first = here.groupBy("sha256").agg(F.count("*").alias("_n"), F.min("path_key").alias("_a")).where("_n > 1")
    second = here.join(first, "sha256").where(F.col("path_key") != F.col("_a")).groupBy("sha256").agg(F.min("path_key").alias("_b"))
    j = here.join(first, "sha256").join(second, "sha256")
    return j.select("path_key", (F.col("_n") - 1).alias("matches"), F.when(F.col("path_key") == F.col("_a"), F.col("_b")).otherwise(F.col("_a")).alias("first_match"))


def edges_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (path_key): edges (edge_id, source, target, resolved) that come in, by either of an edge's targets, and that go out; each once."""
    by = lambda c, way: edges.join(nodes, edges[c] == nodes["path_key"]).select("path_key", "edge_id", F.lit(way).alias("direction"))
    return by("target", "in").union(by("resolved", "in")).distinct().unionByName(by("source", "out"))


def edge_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges that are new or gone: two anti joins."""
    gone = before.select("edge_id").distinct().join(after.select("edge_id"), "edge_id", "left_anti").withColumn("change", F.lit("REMOVED"))
    return after.select("edge_id").distinct().join(before.select("edge_id"), "edge_id", "left_anti").withColumn("change", F.lit("ADDED")).unionByName(gone)


# Lists


def changes_order() -> list[Column]:
    return [F.col("change_type"), F.lower("path_key"), F.col("path_key")]


def project_changes(rollup: DataFrame) -> DataFrame:
    """Projects by the score of their top event, then by how much their storage has changed, then by name."""
    return rollup.orderBy(F.desc("top_score"), F.desc(F.abs("storage_delta")), F.lower("project_name"), "project_id")


def storage_changes(rollup: DataFrame) -> DataFrame:
    """Projects whose storage has changed at all, the largest change first."""
    return rollup.where("storage_delta <> 0").select("project_id", "project_name", "storage_delta").orderBy(F.desc(F.abs("storage_delta")), "project_id")


def fingerprint_candidates(files: DataFrame, high_value: list[str], limit: int) -> DataFrame:
    """Whom to fingerprint: communication, then telling types, small files, by path."""
    return files.orderBy(~F.col("is_communication"), ~F.col("extension").isin(high_value), "size", "path_key").limit(limit)


def inspection_candidates(files: DataFrame, extensions: list[str], limit: int) -> DataFrame:
    """What to look into: files of these types, and readmes of any."""
    path = F.col("path_key")
    asked = files.where(paths.extension(path).isin(extensions) | F.startswith(F.lower(paths.file_name(path)), F.lit("readme")))
    return asked.orderBy(*paths.inspection_order(path, F.col("size"))).limit(max(0, limit))


def hash_candidates(files: DataFrame, first: list[str], limit: int) -> DataFrame:
    """Whom to hash in full: models, archives and documents, the largest first, by path."""
    return files.orderBy(~F.col("extension").isin(first), F.desc("size"), "path_key").limit(max(0, limit))


def authority_lists(assets: DataFrame, most: int = 100) -> DataFrame:
    """The surest authorities, those of a project or a file apart from those of a gate or line of work: `most` of either."""
    asked = assets.where(F.col("authority_level").isin(IMPORTANT_AUTHORITIES))
    scoped = F.col("authority_scope").isin("WORKSTREAM_LOCAL", "GATE_LOCAL")
    order = [F.desc("confidence"), F.lower("path"), F.col("path")]
    part = lambda c, name: asked.where(c).orderBy(*order).limit(most).withColumn("list", F.lit(name))
    return part(~scoped, "authorities").unionByName(part(scoped, "scoped_authorities"))


def slowest(inspections: DataFrame, most: int = 10) -> DataFrame:
    return inspections.orderBy(F.desc("seconds"), "path").limit(most)


def status_counters(files: DataFrame, projects: DataFrame, dependencies: DataFrame, assets: DataFrame, aggregates: DataFrame, cards: DataFrame, events: DataFrame, snapshots: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row of counters over the catalog, each table read once."""
    n = lambda c: F.count_if(c).cast("long")
    one = lambda df, **c: df.agg(*[v.alias(k) for k, v in c.items()]).withColumn("_k", F.lit(1))
    all_ = F.count("*")
    present = F.col("status") == "present"
    parts = [
        one(files, files=n(present), fingerprints=n(F.col("sample").isNotNull() | F.col("sha256").isNotNull()), communication_records=n(present & F.col("is_communication"))),
        one(projects, projects=all_, understood_projects=n(F.col("status") == "understood")), one(dependencies, dependencies=all_),
        one(assets, authority_assets=n(F.col("authority_level").isin(IMPORTANT_AUTHORITIES))), one(aggregates, aggregate_nodes=all_), one(cards, file_cards=all_),
        one(events, events=all_), one(snapshots, snapshots=all_), one(alerts, open_asset_alerts=n(F.col("status") == "OPEN")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), "_k")  # one row each
    return out.drop("_k")
