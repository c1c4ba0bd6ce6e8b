"""Reachability and components over edge tables (src, dst)."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _durable(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder that the session names. Only a local master may go without: it then gets a temporary folder of our own."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not base and master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="ledgerlake-"))
    return df.checkpoint()


def reachable(edges: DataFrame, starts: DataFrame, directed: bool = True, limit: int = 1000) -> DataFrame:
    """(start, node) for every node reachable from each start, itself included; starts: (start)."""
    step = edges.select("src", "dst")
    if not directed:
        step = step.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    step = step.distinct()
    seen = _durable(starts.select("start", F.col("start").alias("node")).distinct())
    front = seen
    for _ in range(limit):
        new = front.join(step, front["node"] == step["src"]).select("start", F.col("dst").alias("node")).distinct()
        front = _durable(new.join(seen, ["start", "node"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = _durable(seen.union(front))
    raise RuntimeError(f"not all was reached in {limit} steps")


def weak_components(nodes: DataFrame, edges: DataFrame, limit: int = 200) -> DataFrame:
    """(node, component): the smallest node connected with it, whatever the edges' direction.

    Labels spread to neighbours and, by pointer jumping, to the label's own label, so long chains take few rounds.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    state = _durable(nodes.select("node", F.col("node").alias("component")).distinct())
    for _ in range(limit):
        near = both.join(state, both["dst"] == state["node"]).groupBy("src").agg(F.min("component").alias("_m"))
        low = state.join(near, state["node"] == near["src"], "left").select("node", F.least("component", F.coalesce("_m", "component")).alias("component"), F.col("component").alias("_was"))
        low = _durable(low)
        top = low.select(F.col("node").alias("component"), F.col("component").alias("_top"))
        new = _durable(low.join(top, "component").select("node", F.least("component", "_top").alias("component"), "_was"))
        if new.where("component <> _was").isEmpty():
            return new.drop("_was")
        state = new.drop("_was")
    raise RuntimeError(f"components did not settle in {limit} rounds")


def all_connected(nodes: DataFrame, edges: DataFrame, directed: bool) -> DataFrame:
    """One row: whether every node reaches every other. Directed: one node reaches all, and all reach it."""
    total, first = nodes.agg(F.countDistinct("node").alias("n"), F.min("node").alias("start")).first()
    start = nodes.sparkSession.createDataFrame([(first,)], nodes.select(F.col("node").alias("start")).schema)
    reached = [reachable(edges, start, directed).count()]
    if directed:
        reached.append(reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, True).count())
    return nodes.sparkSession.createDataFrame([(total, all(r == total for r in reached))], "nodes long, connected boolean")


def unreachable(nodes: DataFrame, edges: DataFrame, limit: int = 1000) -> DataFrame:
    """One row: the nodes, in order, that some node doesn't reach along the edges.

    Nodes that all others reach make up one strongly connected part, from which nothing leads out. From any node, steps to one that
    doesn't lead back end in such a part; either all nodes lead there, or no node is reached by all.
    """
    spark = nodes.sparkSession
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    at = nodes.agg(F.min("node").alias("start"))
    for _ in range(limit):
        fore = reachable(edges, at).select("node")
        hind = _durable(reachable(back, at).select("node"))
        out = fore.join(hind, "node", "left_anti").agg(F.min("node").alias("start")).first()[0]
        if out is None:
            break
        at = spark.createDataFrame([(out,)], at.schema)
    else:
        raise RuntimeError(f"no last part was found in {limit} steps")
    every = nodes.select("node").distinct()
    lost = every.join(fore, "node", "left_anti") if every.join(hind, "node", "left_anti").isEmpty() else every
    return lost.agg(F.array_sort(F.collect_list("node")).alias("unreachable_nodes"))


def pairs_connected(edges: DataFrame, pairs: DataFrame, directed: bool = True) -> DataFrame:
    """(src, dst, connected) for each required pair."""
    found = reachable(edges, pairs.select(F.col("src").alias("start")).distinct(), directed).select(F.col("start").alias("src"), F.col("node").alias("dst"), F.lit(True).alias("_hit"))
    return pairs.join(found, ["src", "dst"], "left").select("src", "dst", F.coalesce("_hit", F.lit(False)).alias("connected"))
