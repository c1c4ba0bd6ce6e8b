"""Language-model scoring by a probabilistic suffix tree over words.

The tree's nodes are contexts of words that came before, of any length up to max_depth. A context is a candidate when it occurs
min_context times, and is retained when its next-word distribution differs from its parent's (the context without its oldest word)
by at least `divergence` nats. Levels are searched one by one: a context of d + 1 words lies in a candidate of d words, and the search ends
with the first level that has none. A node keeps the next words that occur min_next times after it; the rest of its mass, plus
one, goes to its parent's distribution, and at the root every word has (count + 1) / (N + V + 1). A token is scored at
the longest retained suffix of what precedes it in its text. The floors are those of a corpus of `corpus` tokens: in larger ones they
rise with the root of its size, so that the model, too, grows with the corpus about as its root, and never stops; in smaller ones they fall with its size.

The model grows with the corpus and lies in partitioned tables. In logarithms a token's score is a sum: the root's, and for each
length a term of the context, if it is retained, and one of the next word, if that is kept after it. So the model is a table of
keys and terms. Words that make up word_share of the training tokens (at most 1 / word_share of them), and terms that make up
term_share, at most MOST_TERMS, are broadcast, which saves time and changes no result; keys of other terms, and rare words, meet their terms and counts in a join. Bitmaps of keys
pass over what has no term; they can only let too much through.

Defined cases: null and empty texts are one end token; equal rows get equal scores; a null id counts as an
empty one; if nothing is trained on, every token is unknown; empty tables give empty results. Words and contexts are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import discard, filled, scratch, small_batches, tidy

END = np.uint64(0x5DEECE66D)
HELD = 1 << 20
#: Bits of a bitmap (16 MB), and terms that are broadcast (64 MB).
MOST_BITS, MOST_TERMS = 27, 1 << 22


class Counter:
    """Counts of 64-bit keys, with more columns that go with the key, in sorted arrays; gives up what it holds when that passes a bound."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, *more: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        k, first, c = np.unique(keys, return_index=True, return_counts=True)
        self.parts.append((k, c, *(m[first] for m in more)))
        self.size += len(k)
        if self.size > HELD:
            held = self.merged()
            self.parts, self.size = [held], len(held[0])
            if self.size > HELD // 2:
                self.parts, self.size = [], 0
                yield held

    def merged(self) -> tuple[np.ndarray, ...]:
        k, c, *more = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(k, kind="stable")
        k = k[order]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        return k[first], np.add.reduceat(c[order], first), *(m[order][first] for m in more)

    def rest(self) -> Iterator[tuple[np.ndarray, ...]]:
        if self.parts and self.size:
            yield self.merged()


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and one end per document, with their documents."""
    n = len(off) - 1
    h, doc = W.words(data, off)
    count = np.bincount(doc, minlength=n) + 1
    out = np.full(len(h) + n, END, np.uint64)
    out[np.arange(len(h)) + doc] = h
    return out, np.repeat(np.arange(n), count)


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted in the sorted keys, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Bits:
    """A bitmap of the upper bits of 64-bit keys."""

    def __init__(self, keys: DataFrame, n: int):
        """keys: (k), n of them."""
        self.size = min(max(int(n * 16).bit_length(), 12), MOST_BITS)
        at = F.call_function("shiftrightunsigned", F.col("k"), F.lit(64 - self.size))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
        pdf = keys.select(F.call_function("shiftrightunsigned", at, F.lit(6)).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
        self.map = np.zeros(1 << (self.size - 6), np.uint64)
        self.map[pdf["w"].to_numpy(np.int64)] = pdf["b"].to_numpy(np.int64).view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.uint64) >> np.uint64(64 - self.size)
        return ((self.map[(at >> np.uint64(6)).view(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


class Model:
    """words: hashes of frequent words, sorted, with counts. keys: those of frequent terms, sorted, with the terms;
    bits: a bitmap of the keys of all terms; deep: bitmaps of the candidate contexts of 1, 2, ... words."""

    def __init__(self, words, counts, total, distinct):
        self.words, self.counts, self.total, self.distinct = words, counts, total, distinct
        self.keys, self.terms, self.bits, self.deep = np.zeros(0, np.int64), np.zeros(0), None, []

    def root(self, at: np.ndarray) -> np.ndarray:
        """log10 of the root's probability of frequent words; 0 for others."""
        if not len(self.words):
            return np.zeros(len(at))
        return np.where(at >= 0, np.log10((self.counts[np.maximum(at, 0)] + 1.0) / (self.total + self.distinct + 1.0)), 0.0)

    def score(self, tok: np.ndarray, doc: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """base with the frequent terms added, and documents and keys of what may have other terms."""
        lp, docs, keys = base.copy(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def look(at: np.ndarray, k: np.ndarray) -> np.ndarray:
            """Adds the terms of keys; which of them may have one."""
            hit = np.flatnonzero(self.bits.has(k))
            at, k = at[hit], k[hit]
            where = find(self.keys, k)
            known = where >= 0
            lp[at[known]] += self.terms[where[known]]
            docs.append(doc[at[~known]])
            keys.append(k[~known])
            return hit

        for depth, (at, node, key, _) in enumerate(_levels(tok, doc, self.deep), 1):
            retained = look(at, _marked(node, depth))
            look(at[retained], key[retained])  # next words have terms only where their context has one
        docs, keys = np.concatenate(docs), np.concatenate(keys)
        order = np.argsort(docs, kind="stable")
        return lp, docs[order], keys[order]


def _marked(node, depth: int):
    """The key of a context of depth words, apart from those of next words."""
    mark = int(W.mix(np.array([0x1F83D9AB + depth], np.uint64)).view(np.int64)[0])
    return node ^ np.int64(mark) if isinstance(node, np.ndarray) else node.bitwiseXOR(F.lit(mark))


def _key(node: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The key of some words: of the keys of all but the last and all but the first."""
    return W.chain(node.view(np.uint64), last.view(np.uint64)).view(np.int64)


def _levels(tok: np.ndarray, doc: np.ndarray, deep: list[Bits]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For contexts of 1, 2, ... words: places of tokens that a candidate precedes, the candidate's key, the key of both, and that key without the oldest word.

    A candidate's words without the first, or the last, are candidates too, so each level only looks where the one before has found some.
    """
    at, keys = np.arange(len(tok)), tok.view(np.int64)
    for bits in deep:
        # Neighbours that both end such words, in one text.
        both = np.flatnonzero((at[1:] == at[:-1] + 1) & (doc[at[1:]] == doc[at[:-1]])) + 1
        both = both[bits.has(keys[both - 1])]
        node, last, at = keys[both - 1], keys[both], at[both]
        keys = _key(node, last)
        yield at, node, keys, last


def _counted(keys_of):
    """A mapInArrow function that counts the keys of training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        out = lambda kc: pa.RecordBatch.from_arrays([pa.array(kc[0], pa.int64()), pa.array(kc[1], pa.int64())], ["k", "c"])
        for batch in batches:
            data, off = W.buffers(batch.column("text"))
            for i, j in W.doc_groups(off):
                yield from map(out, held.add(keys_of(data, off[i : j + 1])))
        yield from map(out, held.rest())

    return run


def _sums(train: DataFrame, keys_of) -> DataFrame:
    return train.mapInArrow(_counted(keys_of), "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = df.toPandas().sort_values("k")
    return pdf["k"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64)


def _next_words(deep, kept):
    """A mapInArrow function: (context, last, count) of next words after candidates of len(deep) words. deep: bitmaps of the candidates of each
    length; kept: one of the keys that are frequent enough to end longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()
        out = lambda x: pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (x[2], x[3], x[1])], ["node", "last", "c"])
        for batch in batches:
            data, off = W.buffers(batch.column("text"))
            for i, j in W.doc_groups(off):
                tok, doc = tokens(data, off[i : j + 1])
                for _, node, key, last in _levels(tok, doc, deep.value):
                    pass
                hit = np.flatnonzero(kept.value.has(last))
                yield from map(out, held.add(key[hit], node[hit], last[hit]))
        yield from map(out, held.rest())

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the key of each (node, last)."""
    for batch in batches:
        k = _key(*(batch.column(c).to_numpy() for c in ("node", "last")))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k, pa.int64())], [*batch.schema.names, "k"])


def _nodes(kids: DataFrame, divergence: float) -> DataFrame:
    """kids: (node, total, c, parent), c and the parent's probability of each kept next word. (node, total, rest) of retained contexts."""
    share = F.col("c") / F.col("total")
    sums = kids.groupBy("node", "total").agg(F.sum("c").alias("kept"), F.sum(share * F.log(share / F.col("parent"))).alias("gap"), F.sum("parent").alias("parents"))
    # What is left follows the parent's distribution, scaled; its term of the divergence is that of two masses.
    rest, rest_p = 1 - F.col("kept") / F.col("total"), 1 - F.col("parents")
    gap = F.col("gap") + F.when((rest > 0) & (rest_p > 0), rest * F.log(rest / rest_p)).otherwise(0.0)
    return sums.where(gap >= divergence).select("node", "total", (F.col("total") - F.col("kept")).alias("rest"))


def _terms(nodes: DataFrame, kids: DataFrame, depth: int) -> DataFrame:
    """(k, c, term): of retained contexts, and of their kept next words beyond the context's."""
    back = (F.col("rest") + 1) / (F.col("total") + 1)
    own = nodes.select(_marked(F.col("node"), depth).alias("k"), F.col("total").alias("c"), F.log10(back).alias("term"))
    more = F.log10((F.col("c") / (F.col("total") + 1) + back * F.col("parent")) / (back * F.col("parent")))
    return own.union(kids.select("node", "k", "c", "parent").join(nodes, "node").select("k", "c", more.alias("term")))


def floors(total: int, min_next: float, min_context: float, corpus: float) -> tuple[float, float]:
    """Least counts of next words and of contexts in a corpus of total tokens."""
    rise = math.sqrt(total / corpus) if total > corpus else total / corpus
    return max(min_next * rise, 2), max(min_context * rise, 2)


def fit(train: DataFrame, word_share: float = 1e-6, term_share: float = 5e-7, min_next: float = 16, min_context: float = 80, corpus: float = 4e6, divergence: float = 0.05, max_depth: int = 5) -> tuple[DataFrame, Model, DataFrame | None]:
    """train: (text). The counts of all tokens (k, c), the model's broadcast part, and its other terms (k, term), both tables in the shared folder."""
    spark = train.sparkSession
    share = spark.sparkContext.broadcast
    bits = lambda rows: Bits(rows.select("k"), rows.count())
    vocab = scratch(_sums(train, lambda d, o: tokens(d, o)[0].view(np.int64)))
    tidy(spark)
    total, distinct = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    m = Model(*_arrays(vocab.where(F.col("c") >= word_share * total)), total, distinct)
    if not total:
        return vocab, m, None
    least, least_context = floors(total, min_next, min_context, corpus)

    # grams: (k, c, p), keys of as many words as the level has, and the model's probability of the last of them after the others.
    grams = vocab.where(F.col("c") >= least).select("k", "c", ((F.col("c") + 1) / F.lit(float(total + distinct + 1))).alias("p"))
    terms, made = None, []
    while len(m.deep) < max_depth:
        deep = grams.where(F.col("c") >= least_context)
        if deep.isEmpty():
            break
        m.deep.append(bits(deep))
        depth = len(m.deep)
        met = train.mapInArrow(_next_words(share(m.deep), share(bits(grams))), "node long, last long, c long").groupBy("node", "last").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
        met = met.mapInArrow(_keyed, "node long, last long, c long, k long")
        kids = met.join(grams.select(F.col("k").alias("last"), F.col("p").alias("parent")), "last")
        kids = scratch(kids.join(grams.select(F.col("k").alias("node"), F.col("c").alias("total")), "node").select("k", "node", "total", "c", "parent"))
        tidy(spark)
        nodes = scratch(_nodes(kids.where(F.col("total") >= least_context), divergence))
        found = _terms(nodes, kids, depth)
        terms = found if terms is None else terms.union(found)
        p = F.when(F.col("rest").isNull(), F.col("parent")).otherwise((F.col("c") + (F.col("rest") + 1) * F.col("parent")) / (F.col("total") + 1))
        grams = scratch(kids.join(nodes.select("node", "rest"), "node", "left").select("k", "c", p.alias("p")))
        made += [kids, nodes, grams]
    if terms is None:
        return vocab, m, None
    terms = scratch(terms)
    discard(*made)

    cut = term_share * total
    while terms.where(F.col("c") >= cut).count() > MOST_TERMS:
        cut *= 2
    hot = F.col("c") >= cut
    pdf = terms.where(hot).select("k", "term").toPandas().sort_values("k")
    m.keys, m.terms = pdf["k"].to_numpy(np.int64), pdf["term"].to_numpy(np.float64)
    m.bits = Bits(terms.select("k"), terms.count())
    tidy(spark)
    return vocab, m, terms.where(~hot).select("k", "term")


def _lists(doc: np.ndarray, keys: np.ndarray, n: int) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys, pa.int64()))


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            data, off = W.buffers(batch.column("text"))
            for i, j in W.doc_groups(off):
                tok, doc = tokens(data, off[i : j + 1])
                at = find(m.words, tok.view(np.int64))
                base = m.root(at)
                lp, cold_doc, cold = m.score(tok, doc, base)
                n, known = j - i, at >= 0
                rare = ~known
                cols = [np.bincount(doc, minlength=n), np.bincount(doc[known], minlength=n)]
                sums = [np.bincount(doc, x, n) for x in (base, lp)]
                lists = [_lists(doc[rare], tok[rare].view(np.int64), n), _lists(cold_doc, cold, n)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), batch.column("held_out").slice(i, n), *(pa.array(c, pa.int64()) for c in cols), *map(pa.array, sums), *lists], ["doc_id", "held_out", "n_tokens", "known", "base", "lp", "rare", "cold"])

    return run


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", **sizes: float) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col), filled(F.col(text_col)).alias("text"), held_out.alias("held_out")).select(F.col(id_col).alias("doc_id"), "text", "held_out")
    vocab, model, cold = fit(rows.where(~F.col("held_out")).select("text"), **sizes)
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, lp double, rare array<long>, cold array<long>"
    part = scratch(rows.mapInArrow(_scored(spark.sparkContext.broadcast(model)), schema).withColumn("row", F.monotonically_increasing_id()))
    rare = part.select("row", F.explode("rare").alias("k")).join(vocab, "k", "left")
    spread = math.log10(model.total + model.distinct + 1)
    sums = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0)) - F.lit(spread)).alias("more"), F.count("c").alias("met"))
    out = part.drop("rare", "cold").join(sums, "row", "left")
    if cold is None:
        out = out.withColumn("deeper", F.lit(0.0))
    else:
        out = out.join(part.select("row", F.explode("cold").alias("k")).join(cold, "k").groupBy("row").agg(F.sum("term").alias("deeper")), "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("lp") + more + F.coalesce("deeper", F.lit(0.0))).alias("score"),
    )
