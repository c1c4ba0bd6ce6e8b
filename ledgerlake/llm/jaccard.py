"""N-gram Jaccard join by an R-tree of count vectors.

Documents are sets of hashed k-word shingles. A set's shingles are hashed into groups, and its group counts are a point:
the sum over groups of the smaller counts of two points bounds the overlap of their sets, and the same sum against the
largest counts of a box bounds it for every point in the box. A tree of such boxes is searched for each set, and what
survives is verified on the shingles. Points have more groups the more shingles they have, so that unlike sets of any size
lie far apart; boxes of one tree count in the groups of its smaller sets.

One tree over all sets would have to be searched by all sets, so sets are dealt to many trees by what linked sets must
share. Put all shingles in one order: two sets A, B of similarity t share one of the first |A| - ceil(t|A|) + 1 shingles of A
and the first |B| - ceil(t|B|) + 1 of B, whatever the order. Rare shingles come first in it, so for most sets these are
shingles that no other set has, and they are done. In full, the order is: a half of the shingles, drawn by hash, by how often they are met; the
other half; and last those that a sample of the shingles shows to be met very often. Counting half of them is
enough to put rare ones first, and no count of a very frequent one is ever gathered.

1. Shingles of the counted half are dealt out by range of their hash and counted there; those met twice come back to their documents.
2. Sets that share an early shingle lie in one bucket. Buckets are dealt to tasks by their smallest set and their size, and a task searches a tree
   of all its sets' points, from set to set through sets not yet reached, for sets that share a bucket; so it emits a
   spanning forest, never all pairs. A bucket of more than `block` sets is linked to its smallest set as a whole.
3. Components over these links are classes, inside which all links lie. A class is one tree with shingles again, and only verified
   links leave it. A class of more than `block` sets is split into blocks: links inside blocks come first, then one set per
   component is compared with every block, then every set outside the class's largest component is; no pair is lost, and no
   task holds more than a block of sets and a block of probes.

Copies (equal sets, told by 128 bits) are one point. Any percent from 1 to 100 is exact.

Defined cases: null, empty and blank texts have no shingles and are linked with nothing; texts of fewer than k words
are one shingle; equal rows are linked; a null id takes part but is never a component's smallest; other columns play no part,
whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import words as W
from .common import components, discard, filled, scratch, small_batches

#: Groups of sets below these sizes; entries of a box.
DIMS, BELOW, PAGE = (64, 256, 1024, 4096), (1024, 4096, 16384), 32
#: Shingles that a map task holds at once (more with many ranges, for 8 of a range to go together), that a range of hashes has, that are sampled, and
#: how often a frequent one is in the sample.
HELD, MOST_HELD, A_RANGE, MOST_BITS, SAMPLED, OFTEN = 1 << 20, 1 << 23, 1 << 18, 20, 10_000_000, 16
FILTER_BITS = 26
_FEW = np.uint64(32)


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their documents, in order."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    out, at = [], []
    if len(h) >= k:
        same = doc[: len(h) - k + 1] == doc[k - 1 :]
        out.append(W.chain(*[h[i : len(h) - k + 1 + i][same] for i in range(k)]))
        at.append(doc[: len(h) - k + 1][same])
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        out.append(W.chain(*[h[first[short] + i] for i in range(n)], np.full(len(short), n, np.uint64)))
        at.append(short)
    return np.concatenate(out), np.concatenate(at)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted set of each document."""
    n = len(off) - 1
    sh, at = shingles(*W.words(data, off), n, k)
    order = np.argsort(at, kind="stable")
    sh, ends = sh[order], np.cumsum(np.bincount(at, minlength=n)) if len(at) else np.zeros(n, np.int64)
    lo = 0
    for hi in ends.tolist():
        s = np.sort(sh[lo:hi])
        yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s
        lo = hi


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        one = W.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))
        two = W.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    both = W.mix(np.array([one, two], np.uint64)).view(np.int64)
    return int(both[0]), int(both[1])


def early(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """How many shingles of a set of n come early enough that linked sets share one of them."""
    return n - -(-percent * n // 100) + 1


# Points and trees


def level_of(n: np.ndarray | int) -> np.ndarray:
    return np.searchsorted(BELOW, n, "right")


def point_of(s: np.ndarray) -> np.ndarray:
    """Group counts of a set, in as many groups as its size asks for."""
    dims = DIMS[int(level_of(len(s)))]
    return np.bincount((s >> _FEW).astype(np.int64) & (dims - 1), minlength=dims).astype(np.uint32)


def folded(point: np.ndarray, dims: int) -> np.ndarray:
    return point if len(point) == dims else point.reshape(-1, dims).sum(axis=0)


class CountTree:
    """Boxes over points, PAGE to a box and PAGE boxes to the next, packed by size and then by the fullest coordinates."""

    def __init__(self, points: np.ndarray, size: np.ndarray, percent: int):
        self.percent, self.points, self.size = percent, points.astype(np.int64), size
        self.order = np.lexsort((self.points[:, 1], self.points[:, 0], size))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # from the leaves up: largest counts, least and most size
        high, least, most = self.points[self.order], size[self.order], size[self.order]
        while not self.levels or len(high) > PAGE:
            cut = np.arange(0, len(high), PAGE)
            high, least, most = np.maximum.reduceat(high, cut, axis=0), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)
            self.levels.append((high, least, most))

    def need(self, n: int, m: np.ndarray) -> np.ndarray:
        """Least overlap of sets of n and m shingles that reaches the similarity."""
        return -(-(self.percent * (n + m)) // (100 + self.percent))

    def search(self, n: int, point: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Alive points whose bound on the overlap with a set of n shingles reaches the similarity."""
        at = np.arange(len(self.levels[-1][0]))
        for i in range(len(self.levels) - 1, -1, -1):
            high, least, most = self.levels[i]
            at = at[(most[at] * 100 >= n * self.percent) & (least[at] * self.percent <= n * 100)]
            at = at[np.minimum(high[at], point).sum(axis=1) >= self.need(n, least[at])]
            if not len(at):
                return at
            at = (at[:, None] * PAGE + np.arange(PAGE)).ravel()
            at = at[at < (len(self.levels[i - 1][0]) if i else len(self.order))]
        found = self.order[at]
        found = found[alive[found]]
        found = found[(self.size[found] * 100 >= n * self.percent) & (self.size[found] * self.percent <= n * 100)]
        return found[np.minimum(self.points[found], point).sum(axis=1) >= self.need(n, self.size[found])]


class Trees:
    """A tree for each number of groups; sets that may be linked with sets of fewer groups are in the tree of those as well."""

    def __init__(self, size: np.ndarray, points: list[np.ndarray], percent: int, sets: list[np.ndarray] | None = None):
        self.size, self.points, self.percent, self.sets, self.trees = size, points, percent, sets, {}
        level = level_of(size)
        for k in range(int(level.max()) + 1):
            at = np.flatnonzero((level == k) | self._reaches(size, level, k))
            if len(at):
                self.trees[k] = at, CountTree(np.stack([folded(points[i], DIMS[k]) for i in at]), size[at], percent)

    def _reaches(self, n, level, k: int):
        """Whether sets of a higher level may be linked with sets of level k."""
        return (level > k) & (n * self.percent < 100 * BELOW[min(k, len(BELOW) - 1)])

    def search(self, n: int, point: np.ndarray, alive: np.ndarray, s: np.ndarray | None = None) -> np.ndarray:
        """Alive sets linked with a set; only by the bound where the sets themselves aren't at hand."""
        level = int(level_of(n))
        found = [at[tree.search(n, folded(point, DIMS[k]), alive[at])] for k, (at, tree) in self.trees.items() if k == level or self._reaches(n, level, k)]
        found = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        if self.sets is None or not len(found):
            return found
        flat = np.concatenate([self.sets[p] for p in found])
        where = np.minimum(np.searchsorted(s, flat), n - 1)
        both = np.add.reduceat((s[where] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(self.size[found])[:-1])))
        return found[100 * both >= self.percent * (n + self.size[found] - both)]


def forest(trees: Trees, near: list[list[np.ndarray]] | None = None) -> np.ndarray:
    """For each set, the first set of its component. near: the only sets that each may be linked with, in parts that sets share."""
    m = len(trees.size)
    root, alive = np.arange(m), np.ones(m, bool)
    for start in range(m):
        if not alive[start]:
            continue
        alive[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            left = alive
            if near is not None:
                left = np.zeros(m, bool)
                for x in near[at]:
                    left[x] = True
                left &= alive
                if not left.any():
                    continue
            new = trees.search(int(trees.size[at]), trees.points[at], left, trees.sets[at] if trees.sets else None)
            alive[new] = False
            root[new] = start
            queue.extend(new.tolist())
    return root


# Early shingles


class _Held:
    """Shingles of the sets at hand, until there are enough to be dealt out by range of hash. Equal sets are held once."""

    def __init__(self, base: int, bits: int, percent: int, hot: np.ndarray):
        self.base, self.bits, self.percent, self.hot = base, bits, percent, hot
        self.clear()

    def clear(self) -> None:
        self.seen, self.tokens, self.meta, self.points, self.direct, self.size = set(), [], [], [], [], 0

    def add(self, s: np.ndarray, ident: tuple[int, int]) -> bool:
        """Whether it is time to deal."""
        if ident in self.seen:
            return False
        self.seen.add(ident)
        often = np.zeros(len(s), bool)
        if len(self.hot):
            often = self.hot[np.minimum(np.searchsorted(self.hot, s), len(self.hot) - 1)] == s
        half = (s & np.uint64(1)) == 0
        counted = s[half & ~often]
        # What a set needs beyond the counted half it names itself: the other half, then what is frequent, by hash.
        need = max(early(len(s), self.percent) - len(counted), 0)
        self.direct.append(np.concatenate((s[~half & ~often][:need], s[often]))[:need])
        self.tokens.append(counted >> np.uint64(32 - self.bits))
        self.meta.append((len(s), len(counted), *ident))
        self.points.append(point_of(s))
        self.size += len(counted)
        return self.size >= min(max(HELD, 8 << self.bits), MOST_HELD) or len(self.meta) >= 1 << 16

    def dealt(self) -> pa.RecordBatch | None:
        """A row for each range of hashes: 32 bits of each shingle, and its set's number; and one for all the sets."""
        if not self.meta:
            return None
        token = np.concatenate(self.tokens)
        idx = np.repeat(np.arange(len(self.meta)), [len(x) for x in self.tokens]).astype(np.uint16)
        order = np.argsort(token, kind="stable")
        token, idx = token[order], idx[order]
        cuts = np.searchsorted(token >> _FEW, np.arange((1 << self.bits) + 1))
        low, r = token.astype(np.uint32), np.flatnonzero(np.diff(cuts))
        direct = np.repeat(np.arange(len(self.meta)), [len(x) for x in self.direct]).astype(np.uint16)
        cols = {
            "g": pa.array(np.append(r, -1 - self.base), pa.int64()),
            "base": pa.array(np.full(len(r) + 1, self.base), pa.int64()),
            "tokens": pa.array([low[cuts[k] : cuts[k + 1]].tobytes() for k in r] + [np.concatenate(self.direct).tobytes()], pa.binary()),
            "idx": pa.array([idx[cuts[k] : cuts[k + 1]].tobytes() for k in r] + [direct.tobytes()], pa.binary()),
            "often": pa.nulls(len(r) + 1, pa.binary()),
            "meta": pa.array([None] * len(r) + [np.array(self.meta, np.int64).tobytes()], pa.binary()),
            "points": pa.array([None] * len(r) + [np.concatenate(self.points).tobytes()], pa.binary()),
        }
        self.base += 1
        self.clear()
        return pa.RecordBatch.from_pydict(cols)


DEALT = "g long, base long, tokens binary, idx binary, often binary, meta binary, points binary"


def _each_set(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[np.ndarray]:
    for batch in batches:
        data, off = W.buffers(batch.column("text"))
        for i, j in W.doc_groups(off):
            yield from shingle_sets(data, off[i : j + 1], k)


def _described(k: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = W.buffers(batch.column("text"))
            for i, j in W.doc_groups(off):
                found = [(len(s), *(identity(s) if len(s) else (0, 0))) for s in shingle_sets(data, off[i : j + 1], k)]
                keys = [batch.column(c).slice(i, j - i) for c in ("doc_id", "k1", "k2")]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(x, pa.int64()) for x in zip(*found))], ["doc_id", "k1", "k2", "n", "i1", "i2"])

    return run


def _sampled(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            s, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(c, pa.int64())], ["s", "c"])

        for s in _each_set(batches, k):
            held.append(s)
            size += len(s)
            if size > HELD:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return run


def _dealt(k: int, percent: int, bits: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(TaskContext.get().partitionId() << 24, bits, percent, hot.value)
        for s in _each_set(batches, k):
            if len(s) and held.add(s, identity(s)):
                yield held.dealt()
        if (out := held.dealt()) is not None:
            yield out

    return run


def _counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the shingles of a range, those met twice or more, to go back to where they came from, with the logarithm of their counts."""
    if int(pdf["g"].iloc[0]) < 0:
        return pdf
    token = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["tokens"]])
    order = np.argsort(token, kind="stable")
    sorted_ = token[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    many = np.diff(np.append(first, len(token)))
    often = np.empty(len(token), np.uint8)
    often[order] = np.repeat(np.minimum(np.log2(many) * 4, 255).astype(np.uint8) + (many > 1), many)
    out, lo = [], 0
    for g, base, tokens, idx in zip(pdf["g"], pdf["base"], pdf["tokens"], pdf["idx"]):
        t, i = np.frombuffer(tokens, np.uint32), np.frombuffer(idx, np.uint16)
        o = often[lo : lo + len(t)]
        lo += len(t)
        if (met := o > 0).any():
            out.append((g, base, t[met].tobytes(), i[met].tobytes(), o[met].tobytes(), None, None))
    return pd.DataFrame(out, columns=list(pdf.columns)).astype({"g": "int64", "base": "int64"})


def _early(percent: int):
    """applyInPandas: the sets of one buffer that may share an early shingle with others, and these shingles."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, back = pdf[pdf["g"] < 0], pdf[pdf["g"] >= 0]
        meta = np.frombuffer(own["meta"].iloc[0], np.int64).reshape(-1, 4)
        n, counted = meta[:, 0], meta[:, 1]
        idx = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(x, np.uint16) for x in back["idx"])]).astype(np.int64)
        often = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8) for x in back["often"])])
        token = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.uint32).astype(np.int64) | (int(g) << 32) for g, x in zip(back["g"], back["tokens"]))])
        order = np.lexsort((token, often, idx))
        idx, token = idx[order], token[order]
        met = np.bincount(idx, minlength=len(n))
        # Shingles met once come first; they take up room among the early ones, but link nothing.
        room = np.minimum(early(n, percent), counted) - (counted - met)
        place = np.arange(len(idx)) - np.repeat(np.cumsum(met) - met, met)
        stay = place < room[idx]
        direct = np.frombuffer(own["idx"].iloc[0], np.uint16).astype(np.int64)
        idx = np.concatenate((idx[stay], direct))
        token = np.concatenate((token[stay], np.frombuffer(own["tokens"].iloc[0], np.int64)))
        order = np.argsort(idx, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(idx, minlength=len(n)))))
        token = token[order]
        points = own["points"].iloc[0]
        at = np.concatenate(([0], np.cumsum(np.array(DIMS)[level_of(n)] * 4)))
        rows = [(int(meta[i, 2]), int(meta[i, 3]), int(n[i]), points[at[i] : at[i + 1]], token[ends[i] : ends[i + 1]]) for i in np.flatnonzero(np.diff(ends)).tolist()]
        return pd.DataFrame(rows, columns=["i1", "i2", "n", "point", "shingles"])

    return run


def _bucket_links(percent: int):
    """applyInPandas: rows (shingle, node) and (node, n, point) of one bin; a spanning forest of the pairs that the bound lets through."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, rows = pdf[pdf["shingle"].isna()].sort_values("node"), pdf[pdf["shingle"].notna()]
        nodes = own["node"].to_numpy()
        at = np.searchsorted(nodes, rows["node"].to_numpy())
        _, bucket = np.unique(rows["shingle"].to_numpy(np.int64), return_inverse=True)
        order = np.lexsort((at, bucket))
        at, bucket = at[order], bucket[order]
        buckets = {x.tobytes(): x for x in np.split(at, np.flatnonzero(np.diff(bucket)) + 1) if len(x) > 1}
        mine: list[list[np.ndarray]] = [[] for _ in nodes]
        for x in buckets.values():
            for i in x.tolist():
                mine[i].append(x)
        root = forest(Trees(own["n"].to_numpy(np.int64), [np.frombuffer(x, np.uint32) for x in own["point"]], percent), mine)
        return pd.DataFrame({"a": nodes, "b": nodes[root]}).query("a != b")

    return run


# Classes


def _grams(k: int, wanted):
    """mapInArrow: the sets of documents that a bitmap of their keys lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("k1").to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            hit = np.flatnonzero((wanted.value[(place >> np.uint64(6)).view(np.int64)] >> (place & np.uint64(63))) & np.uint64(1))
            batch = batch.take(pa.array(hit))
            data, off = W.buffers(batch.column("text"))
            for i, j in W.doc_groups(off):
                found = [s.tobytes() for s in shingle_sets(data, off[i : j + 1], k)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("k1", "k2")), pa.array(found, pa.binary())], ["k1", "k2", "grams"])

    return run


def bitmap(keys: DataFrame, name: str) -> np.ndarray:
    """A bitmap of fixed size (2**FILTER_BITS bits) of the upper bits of a column of 64-bit keys. It only lets too much through."""
    place = F.shiftrightunsigned(name, 64 - FILTER_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    words = keys.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(bit).alias("b")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return out


def _trees(grams: pd.Series, percent: int) -> Trees:
    sets = [np.frombuffer(x, np.uint64) for x in grams]
    return Trees(np.array([len(s) for s in sets], np.int64), [point_of(s) for s in sets], percent, sets)


def _block_links(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, part in pdf.drop_duplicates(["part", "node"]).groupby("part", sort=False):
            nodes = part["node"].to_numpy()
            a.append(nodes)
            b.append(nodes[forest(_trees(part["grams"], percent))] if len(nodes) > 1 else nodes)
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).query("a != b")

    return run


def _probe_links(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, probes = pdf[~pdf["probe"]], pdf[pdf["probe"]]
        links: list[tuple[int, int]] = []
        if len(own) and len(probes):
            trees, nodes, comp = _trees(own["grams"], percent), own["node"].to_numpy(), own["comp"].to_numpy().copy()
            held = probes["comp"].to_numpy().copy()
            for i, (node, grams) in enumerate(zip(probes["node"], probes["grams"])):
                s = np.frombuffer(grams, np.uint64)
                found = trees.search(len(s), point_of(s), comp != held[i], s)
                for other in np.unique(comp[found]).tolist():
                    links.append((node, int(nodes[found[comp[found] == other][0]])))
                    comp[comp == other] = held[i]
                    held[held == other] = held[i]
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def _across(big: DataFrame, probes: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between probes and the sets of their class. big, probes: (class, node, comp, block, blocks, grams)."""
    n = probes.groupBy("class").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("chunks"))
    left = big.join(n, "class").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = probes.join(n, "class").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cols = ["class", "block", "chunk", "node", "comp", "grams"]
    both = left.select(*cols, F.lit(False).alias("probe")).unionByName(right.select(*cols, F.lit(True).alias("probe")))
    return both.groupBy("class", "block", "chunk").applyInPandas(_probe_links(percent), "a long, b long")


def link_nodes(classed: DataFrame, percent: int, block: int) -> DataFrame:
    """classed: (class, node, members, grams). Components (node, component) of all linked nodes."""
    spark = classed.sparkSession
    blocks = F.greatest(F.ceil(F.col("members") / F.lit(block)), F.lit(1)).cast("int")
    at = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    sets = scratch(classed.withColumn("blocks", blocks).withColumn("block", at).withColumn("part", F.xxhash64("class", "block")))
    total = sets.count()
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 1000 + 1)
    binned = sets.withColumn("bin", F.when(F.col("blocks") == 1, F.pmod("part", F.lit(bins))).otherwise(F.col("part")))
    links = scratch(binned.select("bin", "part", "node", "grams").groupBy("bin").applyInPandas(_block_links(percent), "a long, b long"))
    big = sets.where("blocks > 1")
    if big.isEmpty():
        discard(sets)
        return components(links)
    for only_heads in (True, False):
        comps = components(links)
        named = scratch(big.join(comps.select("node", F.col("component").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node")).select("class", "node", "comp", "block", "blocks", "grams"))
        if only_heads:
            probes = named.where("node = comp")
        else:
            sizes = named.groupBy("class", "comp").agg(F.count("*").alias("n"))
            largest = sizes.groupBy("class").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"))
            probes = named.join(F.broadcast(largest) if largest.count() <= 100_000 else largest, "class").where("comp <> largest").drop("largest")
        links = scratch(links.unionByName(_across(named, probes, percent, block)))
        discard(named)
    discard(sets)
    return components(links)


def _classified(docs: DataFrame, k: int, percent: int, block: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, i1, i2, component), in the shared folder: two keys of the row, two of its set, and the set's component, null if it has no link."""
    if not 1 <= percent <= 100:
        raise ValueError("percent runs from 1 to 100")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), filled(F.col(text_col)).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2"), "text")
    kind = dict(rows.dtypes)["doc_id"]
    table = scratch(rows.mapInArrow(_described(k, to_arrow_type(rows.schema["doc_id"].dataType)), f"doc_id {kind}, k1 long, k2 long, n long, i1 long, i2 long"))
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    # At most SAMPLED shingles or so, of which at most 1 / OFTEN can be frequent ones.
    every = total // SAMPLED + 1
    hot = rows.where(F.pmod("k2", F.lit(every)) == 0).select("text").mapInArrow(_sampled(k), "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).where(F.col("c") >= OFTEN).select("s").toPandas()
    shared = spark.sparkContext.broadcast
    hot = shared(np.sort(hot["s"].to_numpy(np.int64).view(np.uint64)))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(max((total // A_RANGE).bit_length(), 5, (partitions - 1).bit_length()), MOST_BITS)
    dealt = rows.select("text").mapInArrow(_dealt(k, percent, bits, hot), DEALT)
    early_ = dealt.groupBy("g").applyInPandas(_counted, DEALT).groupBy("base").applyInPandas(_early(percent), "i1 long, i2 long, n long, point binary, shingles array<long>")
    # Equal sets of different buffers have the same early shingles.
    nodes = scratch(early_.dropDuplicates(["i1", "i2"]).withColumn("node", F.monotonically_increasing_id()))

    held = nodes.select("node", F.explode("shingles").alias("shingle"))
    buckets = scratch(held.groupBy("shingle").agg(F.count("*").alias("members"), F.min("node").alias("least")).where("members > 1"))
    held = scratch(held.join(buckets, "shingle"))
    few = held.where(F.col("members") <= block)
    bins = max(partitions, held.count() // 50_000 + 1)
    few = few.select(F.pmod(F.xxhash64("least", "members"), F.lit(bins)).alias("bin"), "shingle", "node")
    points = few.select("bin", "node").distinct().join(nodes.select("node", "n", "point"), "node").select("bin", F.lit(None).cast("long").alias("shingle"), "node", "n", "point")
    both = points.unionByName(few.select("bin", "shingle", "node", F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("point")))
    links = both.groupBy("bin").applyInPandas(_bucket_links(percent), "a long, b long")
    links = links.unionByName(held.where((F.col("members") > block) & (F.col("node") != F.col("least"))).select(F.col("node").alias("a"), F.col("least").alias("b")))
    classes = components(links)
    members = classes.groupBy("component").agg(F.count("*").alias("members"))
    classes = classes.join(members, "component").join(nodes.select("node", "i1", "i2"), "node").select("node", F.col("component").alias("class"), "members", "i1", "i2")
    # Shingles again, only for one document of each set that has a candidate.
    chosen = table.join(classes.select("node", "class", "members", "i1", "i2"), ["i1", "i2"]).groupBy("node", "class", "members").agg(F.min(F.struct("k1", "k2")).alias("row"))
    chosen = scratch(chosen.select("node", "class", "members", "row.*"))
    wanted = shared(bitmap(chosen, "k1"))
    grams = rows.select("k1", "k2", "text").mapInArrow(_grams(k, wanted), "k1 long, k2 long, grams binary").join(chosen, ["k1", "k2"]).dropDuplicates(["node"])
    comps = link_nodes(grams.select("class", "node", "members", "grams"), percent, block)
    comps = scratch(comps.join(nodes.select("node", "i1", "i2"), "node").select("i1", "i2", "component"))
    out = scratch(table.join(comps, ["i1", "i2"], "left").select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), "i1", "i2", "component"))
    discard(table, buckets, held, chosen, comps, nodes)
    return out


def _grouped(named: DataFrame, least) -> DataFrame:
    """(i1, i2, least): an aggregate over all rows of each set's component, for sets with shingles.

    Copies meet in partial sums of their set, sets in those of their component, so neither is gathered anywhere.
    """
    sets = scratch(named.where("n_shingles > 0").groupBy("i1", "i2", "component").agg(least.alias("least")))
    of = scratch(sets.where("component is not null").groupBy("component").agg(F.min("least").alias("least")))
    linked = sets.where("component is not null").select("i1", "i2", "component").join(of, "component").select("i1", "i2", "least")
    return scratch(linked.unionByName(sets.where("component is null").select("i1", "i2", "least")))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, block: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    named = _classified(docs, k, percent, block, id_col, text_col)
    least = _grouped(named, F.min("doc_id"))
    alone = named.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.where("n_shingles > 0").join(least, ["i1", "i2"]).select("doc_id", "n_shingles", F.col("least").alias("component_id")).unionByName(alone)


def one_per_component(docs: DataFrame, k: int = 5, percent: int = 80, block: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with their own columns, without near duplicates: of each component the one of the smallest id stays.

    Ties go to the smaller hash of the row, null ids come last, and of equal rows one stays. Texts without shingles all stay.
    """
    named = _classified(docs, k, percent, block, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2"))
    kept = _grouped(named, first).select("least.k1", "least.k2").distinct()
    alone = named.where("n_shingles = 0").select("k1", "k2").distinct()
    kept = scratch(kept.withColumn("one", F.lit(True)).unionByName(alone.withColumn("one", F.lit(False))))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), filled(F.col(text_col)).alias("text"))
    rows = rows.select("row", F.xxhash64("id", "text").alias("k1"), F.xxhash64("text", "id").alias("k2"))
    # Rows that are met twice, as far as one of them stays, are few or none: only they are grouped.
    twice = named.where("n_shingles > 0").groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")
    twice = scratch(twice.join(kept.where("one"), ["k1", "k2"], "left_semi"))
    if twice.isEmpty():
        return rows.join(kept, ["k1", "k2"], "left_semi").select("row.*")
    once = rows.join(kept.join(twice, ["k1", "k2"], "left_anti"), ["k1", "k2"], "left_semi")
    again = rows.join(twice, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("row").alias("row"))
    return once.select("row.*").unionByName(again.select("row.*"))
