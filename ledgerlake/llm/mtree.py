"""Exact top-k search by inner product in an M-tree.

Vectors become integers, floor(scale * x). With one more coordinate, sqrt(M * M - |x| * |x|) for rows and 0 for queries (M: the
largest norm), the largest inner products are the smallest distances, so a metric tree can search them:
squared distance = |q|^2 + M^2 - 2 <q, x>.

The tree's nodes hold a routing object, a covering radius and the distance to the routing object above (the parent distance):
heads over routers, routers over pages, pages over leaves, leaves over entries. Routing objects are rows of the smallest hashes,
about the root of the number of rows, within bounds; every row is indexed, under its nearest router. A router's rows are cut by parent
distance into pages of about `page_rows`, so a page is a ring around its router, with a least and a largest distance.

1. Each query goes to its nearest pages, those of least bounds that hold k rows, and finds a k-th score there.
2. It then goes to the pages whose bounds, ring by ring and node by node, do not rule out anything better. Distances to routers are
   computed only where the stored parent distance to their head doesn't rule the router out.

Inside a page, leaves are visited best first, leaves and entries beyond the query's current k-th distance are dropped by their parent
distances, and the rest is computed exactly, in integers. A page asked by many queries is searched by blocks of them, and
very many rows of one distance are several pages, so every task is bounded.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part, nor do null ids; vectors of another length
are no candidates of a query, each length has a tree of its own; a query's own row is no candidate (rows of an equal id are its own; of
several rows of one id the one of the smallest vector asks, and each is a candidate of other queries); ties go to the smaller id; other
columns play no part, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import scratch

#: Slack for distances in floating point, relative to the sizes at hand; queries that are dealt to pages at once.
SLACK, AT_ONCE = 1e-6, 256
RINGS, HEADS, ROUTERS = 256, 16, (64, 2048)


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(vec_id, v array<double> of whole numbers), without rows that take no part."""
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    out = rows.where(F.col("x").isNotNull() & F.col("vec_id").isNotNull() & (F.size("x") > 0)).where(fine)
    return scratch(out.select("vec_id", F.transform("x", lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double")).alias("v")))


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def _between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances, with the lifted coordinate last."""
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T), 0))


@dataclass
class Tree:
    """The nodes above the leaves. Rings: router, least and largest parent distance, rows, first page, pages."""

    top: float
    routers: np.ndarray
    heads: np.ndarray
    head_of: np.ndarray
    head_distance: np.ndarray
    rings: np.ndarray | None = None

    @staticmethod
    def over(centres: np.ndarray, top: float) -> Tree:
        lifted = np.column_stack((centres, np.sqrt(np.maximum(top - (centres * centres).sum(axis=1), 0))))
        heads = lifted[: min(HEADS, len(lifted))]
        d = _between(lifted, heads)
        near = d.argmin(axis=1)
        return Tree(top, lifted, heads, near, d[np.arange(len(d)), near])

    def slack(self, q: np.ndarray) -> float:
        return SLACK * (math.sqrt(self.top) + math.sqrt((q * q).sum(axis=1).max(initial=0)) + 1)

    def bounds(self, q: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Least distance from each query to what each ring may hold; infinite where a node above rules it out (beyond far)."""
        lifted, router = np.column_stack((q, np.zeros(len(q)))), self.rings[:, 0].astype(np.int64)
        slack = self.slack(q)
        radius = np.full(len(self.routers), -np.inf)
        np.maximum.at(radius, router, self.rings[:, 2])
        cover = np.full(len(self.heads), -np.inf)
        np.maximum.at(cover, self.head_of, self.head_distance + radius)
        to_head = _between(lifted, self.heads)
        out = np.full((len(q), len(self.rings)), np.inf)
        for h in range(len(self.heads)):
            asks = np.flatnonzero(to_head[:, h] - cover[h] - slack <= far)
            mine = np.flatnonzero((self.head_of == h) & np.isfinite(radius))
            if not len(asks) or not len(mine):
                continue
            # Routers whose parent distance alone rules them out for all of these queries need no distance.
            least = np.abs(to_head[asks, h][:, None] - self.head_distance[mine]) - radius[mine] - slack
            mine = mine[(least <= far[asks][:, None]).any(axis=0)]
            d = np.full((len(asks), len(self.routers)), np.inf)
            d[:, mine] = _between(lifted[asks], self.routers[mine])
            rings = np.flatnonzero(np.isin(router, mine))
            ring = self.rings[rings]
            at = d[:, router[rings]]
            low = np.maximum(np.maximum(at - ring[:, 2], ring[:, 1] - at) - slack, 0)
            out[np.ix_(asks, rings)] = np.where(low <= far[asks][:, None], low, np.inf)
        return out

    def nearest(self, q: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query, rings of least bounds, ties by the router's distance, until they hold k rows beside its own."""
        low = self.bounds(q, np.full(len(q), np.inf))
        to = _between(np.column_stack((q, np.zeros(len(q)))), self.routers)[:, self.rings[:, 0].astype(np.int64)]
        order = np.lexsort((to, low), axis=1)
        held = np.cumsum(self.rings[:, 3][order], axis=1)
        return [o[: int(np.searchsorted(h, k + 1)) + 1] for o, h in zip(order, held)]


def _assign(tree: Tree):
    """Nearest router and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            lift = np.sqrt(np.maximum(tree.top - (x * x).sum(axis=1), 0))
            d = _between(np.column_stack((x, lift)), tree.routers)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near, pa.int32()), pa.array(d[np.arange(len(x)), near])], ["vec_id", "v", "router", "parent"])

    return run


def rings_of(bins: pd.DataFrame, page_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """bins: (router, bin, n, least, most). Rings of about page_rows rows, and the ring of each bin, in the order of bins."""
    rings, of = [], []
    for router, bin_, n, least, most in bins[["router", "bin", "n", "least", "most"]].itertuples(index=False):
        if rings and rings[-1][0] == router and rings[-1][3] + n <= page_rows:
            rings[-1][2], rings[-1][3] = most, rings[-1][3] + n
        else:
            rings.append([router, least, most, n])
        of.append(len(rings) - 1)
    out = np.array(rings, np.float64).reshape(-1, 4)
    pages = np.ceil(out[:, 3] / page_rows)
    return np.column_stack((out, np.cumsum(pages) - pages, pages)), np.array(of, np.int64)


def _asks(tree: Tree, k: int, again: bool):
    """Pages to be asked: the nearest ones, or (again) the others that may hold something better than the k-th score so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
            q = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            first = tree.nearest(q, k)
            if again:
                kth = batch.column("kth").to_numpy()
                far = np.sqrt(np.maximum((q * q).sum(axis=1) + tree.top - 2 * kth, 0)) + tree.slack(q)
                low = tree.bounds(q, far)
                for i, f in enumerate(first):
                    low[i, f] = np.inf
                first = [np.flatnonzero(np.isfinite(x)) for x in low]
            many = [tree.rings[f, 5].astype(np.int64) for f in first]
            pages = [np.repeat(tree.rings[f, 4].astype(np.int64), m) + np.concatenate([np.arange(x) for x in m]) if len(f) else np.zeros(0, np.int64) for f, m in zip(first, many)]
            at = np.repeat(np.arange(len(q)), [len(p) for p in pages])
            picked = batch.select(["vec_id", "v", "kth"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(pages), pa.int64()), *picked.columns], ["page", "vec_id", "v", "kth"])

    return run


class Leaves:
    """A page's leaves: entries in the order of their parent distance, `leaf` to a leaf."""

    def __init__(self, pdf: pd.DataFrame, router: np.ndarray, leaf: int):
        pdf = pdf.sort_values(["parent", "vec_id"], kind="stable")
        self.ids, self.x, self.parent = pdf["vec_id"].to_numpy(), _matrix(pdf["v"]), pdf["parent"].to_numpy()
        self.starts = np.arange(0, len(pdf), leaf)
        self.ends = np.append(self.starts[1:], len(pdf))
        self.inner, self.radius = self.parent[self.starts], self.parent[self.ends - 1]
        self.router = router


def search_block(leaves: Leaves, qid: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int, top: float, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Best k entries for each query that can match its k-th score: query place, id, score; and how many products were computed."""
    n, kth = len(q), kth.copy()
    best_score, best_id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
    qn, computed = (q * q).sum(axis=1), 0
    d = _between(np.column_stack((q, np.zeros(n))), leaves.router[None, :])[:, 0]
    # Nothing in a leaf is nearer than its ring around the router allows.
    low = np.maximum(np.maximum(d[:, None] - leaves.radius, leaves.inner - d[:, None]) - slack, 0)
    for p in np.argsort(low.min(axis=0), kind="stable"):
        far = np.sqrt(np.maximum(qn + top - 2 * kth, 0)) + slack
        act = np.flatnonzero(low[:, p] <= far)
        if not len(act):
            continue
        a, b = leaves.starts[p], leaves.ends[p]
        # Entries beyond every active query's ring: |d(q, router) - parent distance| bounds the distance.
        lo = a + np.searchsorted(leaves.parent[a:b], (d[act] - far[act]).min(), "left")
        hi = a + np.searchsorted(leaves.parent[a:b], (d[act] + far[act]).max(), "right")
        if lo >= hi:
            continue
        s = q[act] @ leaves.x[lo:hi].T
        computed += s.size
        ids = np.broadcast_to(leaves.ids[lo:hi], s.shape)
        s = np.where((ids == qid[act][:, None]) | (s < kth[act][:, None]), -np.inf, s)
        score, ident = np.concatenate((best_score[act], s), axis=1), np.concatenate((best_id[act], ids), axis=1)
        order = np.lexsort((ident, -score), axis=1)[:, :k]
        rows = np.arange(len(act))[:, None]
        best_score[act], best_id[act] = score[rows, order], ident[rows, order]
        kth[act] = np.maximum(kth[act], best_score[act, -1])
    where, col = np.nonzero(best_score > -np.inf)
    return where, best_id[where, col], best_score[where, col], computed


def _searched(tree: Tree, k: int, leaf: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, ask = pdf[~pdf["query"]], pdf[pdf["query"]]
        if not len(own) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids, q = ask["vec_id"].to_numpy(), _matrix(ask["v"])
        leaves = Leaves(own, tree.routers[int(own["router"].iloc[0])], leaf)
        where, found, score, _ = search_block(leaves, ids, q, ask["kth"].to_numpy(), k, tree.top, tree.slack(q))
        return pd.DataFrame({"query_id": ids[where], "vec_id": found, "score": score.astype(np.int64)})

    return run


def _met(paged: DataFrame, asks: DataFrame, tree: Tree, k: int, leaf: int, block_rows: int) -> DataFrame:
    """Best entries of the pages for the queries that ask them; a page is there once for each block of queries."""
    blocks = asks.groupBy("page").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"))
    cols = ["page", "block", "vec_id", "v", "router", "parent", "kth", "query"]
    none = lambda t: F.lit(None).cast(t)
    own = paged.join(blocks, "page").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"kth": none("double"), "query": F.lit(False)})
    ask = asks.join(blocks, "page").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int")).withColumns({"router": none("int"), "parent": none("double"), "query": F.lit(True)})
    return own.select(*cols).unionByName(ask.select(*cols)).groupBy("page", "block").applyInPandas(_searched(tree, k, leaf), "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def build(table: DataFrame, page_rows: int, routers: int | None = None) -> tuple[Tree, DataFrame] | None:
    """The tree over vectors of one length, and its rows: (vec_id, v, router, parent, page)."""
    spark = table.sparkSession
    total, top = table.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not total:
        return None
    chosen = table.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(routers or min(max(math.isqrt(total), ROUTERS[0]), ROUTERS[1])).toPandas()
    tree = Tree.over(_matrix(chosen["v"]), top)
    rows = scratch(table.mapInArrow(_assign(tree), "vec_id long, v array<double>, router int, parent double"))
    step = 2 * math.sqrt(top) / RINGS or 1.0  # no two points are further apart
    rows = rows.withColumn("bin", F.floor(F.col("parent") / F.lit(step)).cast("int"))
    bins = rows.groupBy("router", "bin").agg(F.count("*").alias("n"), F.min("parent").alias("least"), F.max("parent").alias("most")).toPandas().sort_values(["router", "bin"])
    tree.rings, of = rings_of(bins, page_rows)
    places = pd.DataFrame({"router": bins["router"].to_numpy(), "bin": bins["bin"].to_numpy(), "first": tree.rings[of, 4].astype(np.int64), "pages": tree.rings[of, 5].astype(np.int64)})
    places = F.broadcast(spark.createDataFrame(places, "router int, bin int, first long, pages long"))
    page = F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("pages"))
    return tree, rows.join(places, ["router", "bin"]).select("vec_id", "v", "router", "parent", page.alias("page"))


def _search(table: DataFrame, queries: Column, k: int, routers: int | None, page_rows: int, leaf: int, block_rows: int, id_col: str) -> DataFrame | None:
    built = build(table, page_rows, routers)
    if built is None:
        return None
    tree, paged = built
    asked = table.withColumnRenamed("vec_id", id_col).where(queries).withColumnRenamed(id_col, "vec_id").groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = scratch(asked.withColumn("kth", F.lit(float("-inf"))))
    schema = "page long, vec_id long, v array<double>, kth double"
    near = scratch(_best(_met(paged, asked.mapInArrow(_asks(tree, k, False), schema), tree, k, leaf, block_rows), k))
    kth = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("found"))
    again = asked.join(kth, "vec_id", "left").select("vec_id", "v", F.coalesce("found", "kth").alias("kth"))
    more = _met(paged, again.mapInArrow(_asks(tree, k, True), schema), tree, k, leaf, block_rows)
    return _best(near.drop("rank").unionByName(more), k).select("query_id", "rank", "vec_id", "score")


def top_k(rows: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, routers: int | None = None, page_rows: int = 8192, leaf: int = 256, block_rows: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products of each query row; queries: a condition over id_col.

    Components are expected below 2**20 once scaled, so that products are exact in a double.
    """
    table = integer_vectors(rows, id_col, vec_col, scale)
    lengths = sorted(r["n"] for r in table.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).where("c > 1").collect())
    out = None
    for n in lengths:
        found = _search(table.where(F.size("v") == n), queries, k, routers, page_rows, leaf, block_rows, id_col)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
