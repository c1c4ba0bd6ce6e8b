"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Features are the presence of a word, a pair of neighbours or a pair with one word between, in one of
2**BITS hash buckets; words are runs of letters and digits, A-Z lower-cased. Each coordinate has its own learning rate,
and the L1 term leaves most weights at zero: what is left is a sparse table, small enough to send everywhere
(at most 2**BITS weights). The model is fitted on at most per_class labelled documents of either label, those of the smallest
hashes, in one task of that bounded size; every document is then scored, whole.

Defined cases: null and empty texts get the score of the intercept alone; without labels of both kinds every score is near 0; repeated ids in the labels count once, by their highest label; equal texts get equal scores;
a document without an id counts as one of the empty id and has no label; no columns but id and text are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import filled, scratch, small_batches

BITS = 18
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 8.0, 1.0, 5
THRESHOLD = 0.7


def features(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their documents: words, pairs and pairs with one word between; repeats are still in."""
    shift = np.uint64(64 - BITS)
    out, at = [h >> shift], [doc]
    for gap in (1, 2):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            out.append(W.chain(h[:-gap][same] + np.uint64(gap), h[gap:][same]) >> shift)
            at.append(doc[:-gap][same])
    return np.concatenate(out).astype(np.int64), np.concatenate(at).astype(np.int64)


def ftrl(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept. rows: the distinct buckets of each example, in the order of training."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0
    for _ in range(EPOCHS):
        for x, y in zip(rows, labels):
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) > L1, -(zx - np.sign(zx) * L1) / ((BETA + np.sqrt(nx)) / ALPHA + L2), 0.0)
            b = -bias_z / ((BETA + math.sqrt(bias_n)) / ALPHA)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum() + b)))) - y
            s = (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA
            z[x] = zx + g - s * w
            n[x] = nx + g * g
            bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / ALPHA * b
            bias_n += g * g
    w = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    return w, -bias_z / ((BETA + math.sqrt(bias_n)) / ALPHA)


def cut_of(margins: np.ndarray, labels: np.ndarray) -> float:
    """The margin that parts the labels with the least sum of both error rates, midway in its gap; the highest at ties."""
    order = np.argsort(margins, kind="stable")
    m, y = margins[order], labels[order]
    if not len(y) or y.min() == y.max():
        return math.inf
    cost = np.cumsum(y == 1) / (y == 1).sum() + 1 - np.cumsum(y == 0) / (y == 0).sum()
    cost = np.where(np.append(m[1:] > m[:-1], True), cost, np.inf)
    best = len(cost) - 1 - int(np.argmin(cost[::-1]))
    return float(m[best] + m[best + 1]) / 2 if best + 1 < len(m) else float(m[best]) + 1


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = W.buffers(batch.column("text"))
        for i, j in W.doc_groups(off):
            x, at = features(*W.words(data, off[i : j + 1], letters=True))
            both = np.unique((at << BITS) | x)
            ends = np.searchsorted(both >> BITS, np.arange(j - i + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((both & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("place").slice(i, j - i), batch.column("label").slice(i, j - i), lists], ["place", "label", "x"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights, and the intercept in bucket -1, moved so that the cut between the labels has a score of THRESHOLD."""
    found = []
    for batch in batches:
        x = batch.column("x")
        flat, ends = x.flatten().to_numpy(), x.offsets.to_numpy() - x.offsets[0].as_py()
        found += [(p, y, flat[a:b].copy()) for p, y, a, b in zip(batch.column("place").to_pylist(), batch.column("label").to_pylist(), ends, ends[1:])]
    found.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
    labels = np.array([r[1] for r in found])
    w, b = ftrl([r[2] for r in found], labels)
    b = math.log(THRESHOLD / (1 - THRESHOLD)) - cut_of(np.array([w[r[2]].sum() for r in found]), labels)
    b = b if math.isfinite(b) else -20.0
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(w[at], b), pa.float64())], ["bucket", "weight"])


def _scored(table: tuple[np.ndarray, np.ndarray], intercept: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << BITS)
        w[table[0]] = table[1]
        used = w != 0
        for batch in batches:
            data, off = W.buffers(batch.column("text"))
            for i, j in W.doc_groups(off):
                x, at = features(*W.words(data, off[i : j + 1], letters=True))
                hit = used[x]
                both = np.unique((at[hit] << BITS) | x[hit])
                total = np.bincount(both >> BITS, w[both & ((1 << BITS) - 1)], j - i) + intercept
                score = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i), pa.array(score)], ["doc_id", "held_out", "score"])

    return run


def part_of(ident: Column, parts: int) -> Column:
    """crc32 of an id as text, modulo parts."""
    return F.crc32(filled(ident.cast("string")).cast("binary")) % parts


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, per_class: int = 4096, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. held_out: over id_col; such rows are never learnt from."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), filled(F.col(text_col)).alias("text"), held_out.alias("held_out"))
    rows = rows.select(F.col(id_col).alias("doc_id"), "text", "held_out")
    known = labels.where(~held_out).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.withColumn("place", F.xxhash64(F.lit(6), "doc_id"))
    sample = None
    for y in (0, 1):
        part = known.where(F.col("label") == y).orderBy("place", "doc_id").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    sample = scratch(sample)
    chosen = rows.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("place", F.col("label").cast("int").alias("label"), "text")
    fitted = chosen.mapInArrow(_featured, "place long, label int, x array<int>").repartition(1).mapInArrow(_fit, "bucket int, weight double").collect()
    weights = {r["bucket"]: r["weight"] for r in fitted}
    intercept = weights.pop(-1, 0.0)
    at = np.array(sorted(weights), np.int64)
    table = (at, np.array([weights[k] for k in at.tolist()], np.float64))
    kind = dict(rows.dtypes)["doc_id"]
    out = rows.select("doc_id", "text", "held_out").mapInArrow(_scored(table, intercept), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
