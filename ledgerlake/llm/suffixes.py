"""Suffix-array deduplication of byte strings by longest-previous-factor arrays.

A byte goes if it lies in a string of `length` bytes that also starts somewhere else (keep="none"), or that starts
earlier (keep="first"): at a start s that is the case when the longest next or previous factor, or the previous factor
alone, has at least `length` bytes. Only that comparison matters, so suffixes are compared to that depth and their order is
built where repeats can be:

1. Anchors. Of the grams inside each window of `length` bytes, the one of the smallest hash (the first at ties) is the window's
   anchor, so equal windows have equal anchors at equal offsets. Windows whose anchor's gram is met once are unique.
   Gram counts cover every text; repeated grams go out as a bitmap, FILTER_SHARE bits to a gram and 2**MOST_BITS at most, which only ever
   lets too much through.
2. Blocks. The windows of one anchor fall into blocks of BLOCK starts. A block's core is what all its windows share, and its
   context all that they cover. Unique cores drop out. Equal contexts become one row with their number and their first place before
   anything is gathered, so a passage that any number of documents share is one row.
3. Suffix order. Contexts that share a core are the only suffixes left that can match. For each start in the block they are put in
   suffix order, byte by byte, and neighbours' longest common prefixes are found. Where that prefix reaches `length`, the two are
   factors of each other; in a run of such neighbours the suffix of the smallest position is the previous smaller position of all
   others (on its left or its right), so only that one has no previous factor.
   Cores with more than `most` contexts are not gathered: their windows are grouped one by one.

Defined cases: null texts are empty, empty texts stay; equal rows are copies of each other, and with keep="first" all of
them count as the first; null ids come first; matches never cross texts; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import discard, filled, scratch, small_batches, tidy

SEGMENT, FILTER_SHARE, LEAST_BITS, MOST_BITS = 1 << 20, 16, 20, 30
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _tables:
        made = []
        for base in (BASES[which], np.uint64(pow(int(BASES[which]), -1, 1 << 64))):
            run = np.full(SEGMENT + 1, base, np.uint64)
            run[0] = 1
            made.append(np.multiply.accumulate(run))
        _tables[which] = tuple(made)
    return _tables[which]


class Hashes:
    """Hashes of any substrings, of at least 8 bytes, of one segment."""

    def __init__(self, x: np.ndarray, bases: int = 1):
        v = np.ndarray((max(len(x) - 7, 0),), "<u8", np.ascontiguousarray(x).tobytes(), strides=(1,)) if len(x) >= 8 else np.zeros(0, np.uint64)
        v = W.mix(v.astype(np.uint64))
        with np.errstate(over="ignore"):
            self.sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(v * _powers(k)[0][: len(v)]))) for k in range(bases)]

    def of(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        s = self.sums[which]
        with np.errstate(over="ignore"):
            return W.mix((s[end - 7] - s[start]) * _powers(which)[1][start])


def segments(off: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most SEGMENT bytes: whole documents, or overlapping parts of a long one."""
    for i, j in W.doc_groups(off, SEGMENT):
        a, b = int(off[i]), int(off[j])
        while b - a > SEGMENT:
            yield a, a + SEGMENT
            a += SEGMENT - length + 1
        yield a, b


def anchors(x: np.ndarray, ends: np.ndarray, hashes: Hashes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places, and the first and last window starts of each. ends: for each byte, the end of its document."""
    wide, n = length - gram + 1, len(x) - gram + 1
    if len(x) < length:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(n)
    key = (hashes.of(at, at + gram) & ~np.uint64(SEGMENT - 1)) | at.astype(np.uint64)
    full = np.full(-(-n // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = key
    rows = full.reshape(-1, wide)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(len(x) - length + 1)
    starts = starts[starts + length <= ends[starts]]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    p = (np.minimum(after[starts], before[starts + wide - 1]) & np.uint64(SEGMENT - 1)).astype(np.int64)
    change = np.flatnonzero(p[1:] != p[:-1]) + 1
    return p[np.concatenate(([0], change))], starts[np.concatenate(([0], change))], starts[np.concatenate((change - 1, [len(starts) - 1]))]


def _located(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int, np.ndarray]]:
    """Segments: batch, offsets, bytes, first byte, and the document's end for each byte (relative)."""
    for batch in batches:
        data, off = W.buffers(batch.column("text"))
        for a, b in segments(off, length):
            if b - a >= length:
                cut = np.clip(off - a, 0, b - a)
                ends = np.repeat(cut[1:], np.diff(cut))
                yield batch, off, data[a:b], a, ends


def _grams(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, x, _, ends in _located(batches, length):
            hashes = Hashes(x)
            p, _, _ = anchors(x, ends, hashes, length, gram)
            k, c = np.unique(W.mix(hashes.of(p, p + gram)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], ["gram", "c"])

    return run


def _blocks(length: int, gram: int, block: int, shared, bits: int):
    core = length - block + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch, off, x, a, ends in _located(batches, length):
            hashes = Hashes(x, 2)
            p, s0, s1 = anchors(x, ends, hashes, length, gram)
            bit = (W.mix(hashes.of(p, p + gram)) >> np.uint64(64 - bits)).astype(np.int64)
            hit = np.flatnonzero((bitmap[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1))
            if not len(hit):
                continue
            p, low, high = p[hit], p[hit] - s1[hit], p[hit] - s0[hit]
            many = high // block - low // block + 1
            which = np.repeat(np.arange(len(p)), many)
            ob = low[which] // block + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            jlo, jhi = np.maximum(low[which] - ob * block, 0), np.minimum(high[which] - ob * block, block - 1)
            base = p[which] - ob * block
            c = hashes.of(base, base + core)
            whole = W.chain(hashes.of(base - jhi, base + length - jlo, 1), (jlo * block + jhi).astype(np.uint64))
            # The context without its core: jhi bytes before it and block - 1 - jlo after it.
            size = jhi + block - 1 - jlo
            row = np.repeat(np.arange(len(base)), size)
            k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            take = x[(base - jhi)[row] + k + np.where(k >= jhi[row], core, 0)]
            margins = pa.Array.from_buffers(pa.binary(), len(base), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.py_buffer(take)])
            doc = np.searchsorted(off, base - jhi + a, "right") - 1
            local = base + a - off[doc]
            picked = batch.select(["doc_id", "k1", "k2"]).take(pa.array(doc))
            ints = [pa.array(local, pa.int64()), pa.array(jlo, pa.int32()), pa.array(jhi, pa.int32()), pa.array(c.view(np.int64)), pa.array(whole.view(np.int64))]
            yield pa.RecordBatch.from_arrays([*picked.columns, *ints, margins], ["doc_id", "k1", "k2", "base", "jlo", "jhi", "core", "context", "margins"])

    return run


def suffix_order(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes, as suffixes have it, and how many bytes each, in that order, shares with the one before it (0 for the first)."""
    n, wide = cells.shape
    # UTF-8 has no byte 255, so all bytes can go up by one and none is the zero that ends a string early.
    order = np.argsort(np.ascontiguousarray(cells + 1).view(f"S{wide}").ravel(), kind="stable")
    put = cells[order]
    lcp = np.zeros(n, np.int64)
    differs = put[1:] != put[:-1]
    lcp[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), wide)
    return order, lcp


def factor_runs(reaches: np.ndarray, rank: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in suffix order: whether a factor of full length starts elsewhere, and whether none starts earlier.

    reaches: whether a suffix shares the full length with the one before it (their LCP). Inside a run of such neighbours the
    suffix of the smallest position is the previous smaller position of every other one, so it alone has no previous factor.
    """
    first = np.flatnonzero(~reaches)
    run = np.cumsum(~reaches) - 1
    total, least = np.add.reduceat(weight, first)[run], np.minimum.reduceat(rank, first)[run]
    return total > 1, rank == least


def _ordered(block: int):
    """applyInPandas: contexts of whole cores; bits of the windows that are repeated, and of those that are the first."""
    wide = max(block - 1, 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["core", *(c for c in ("m_id", "m_k1", "m_k2", "m_base") if c in pdf)], na_position="first", kind="stable").reset_index(drop=True)
        core, jlo, jhi, weight = (pdf[c].to_numpy() for c in ("core", "jlo", "jhi", "n"))
        raw = pdf["margins"].tolist()
        lens = np.array([len(r) for r in raw])
        flat = np.frombuffer(b"".join(raw) + bytes(wide), np.uint8)
        at, rank = np.cumsum(lens) - lens, np.arange(len(pdf))
        # A core's number, as bytes, goes before what its windows have around it, so that one order holds all cores.
        number = np.cumsum(np.concatenate(([0], core[1:] != core[:-1]))).astype(">u4").view(np.uint8).reshape(-1, 4)
        number = np.column_stack((number >> 4, number & 15)).astype(np.uint8)
        masks, firsts = np.zeros(len(pdf), np.uint64), np.zeros(len(pdf), np.uint64)
        for j in range(block):
            use = np.flatnonzero((jlo <= j) & (j <= jhi))
            if not len(use):
                continue
            cells = np.zeros((len(use), wide), np.uint8)
            cells[:, : block - 1] = flat[(at[use] + jhi[use] - j)[:, None] + np.arange(block - 1)]
            order, lcp = suffix_order(np.column_stack((number[use], cells)))
            u = use[order]
            repeated, earliest = factor_runs(lcp == wide + 8, rank[u], weight[u])
            bit = np.uint64(1 << j)
            masks[u[repeated]] |= bit
            firsts[u[repeated & earliest]] |= bit
        out = pdf[["core", "context"]].assign(mask=masks.view(np.int64), first=firsts.view(np.int64))
        return out[out["mask"] != 0]

    return run


def _one_by_one(contexts: DataFrame, block: int, place: list[str]) -> DataFrame:
    """The same as _ordered for cores too large to gather: a grouped sum over single windows."""
    one = contexts.withColumn("j", F.explode(F.sequence("jlo", "jhi"))).withColumn("w", F.substring("margins", F.col("jhi") - F.col("j") + 1, F.lit(block - 1)))
    here = F.struct(*place) if place else F.lit(0)
    runs = scratch(one.groupBy("core", "j", "w").agg(F.sum("n").alias("total"), F.min(here).alias("least")).where("total > 1"))
    met = one.join(runs, ["core", "j", "w"])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("j"))
    return met.groupBy("core", "context").agg(F.bit_or(bit).alias("mask"), F.bit_or(F.when(here.eqNullSafe(F.col("least")), bit).otherwise(F.lit(0).cast("long"))).alias("first"))


def _cut(length: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = W.buffers(batch.column("text"))
            kept, spans, ends = [], [], [0]
            for i, found in enumerate(batch.column("found").to_pylist()):
                text = data[off[i] : off[i + 1]]
                runs = []
                if found:
                    base = np.array([f["base"] for f in found], np.int64)
                    mask = np.array([f["mask"] for f in found], np.int64).view(np.uint64)
                    bits = (mask[:, None] >> np.arange(block, dtype=np.uint64)) & np.uint64(1)
                    r, j = np.nonzero(bits)
                    s = np.unique(base[r] - j)
                    new = np.flatnonzero(np.concatenate(([True], s[1:] > s[:-1] + length)))
                    runs = list(zip(s[new].tolist(), (s[np.append(new[1:] - 1, len(s) - 1)] + length).tolist()))
                    stay = np.ones(len(text), bool)
                    for a, b in runs:
                        stay[a:b] = False
                    text = text[stay]
                kept.append(text.tobytes())
                spans += runs
                ends.append(len(spans))
            pairs = pa.StructArray.from_arrays([pa.array([s[k] for s in spans], pa.int64()) for k in (0, 1)], ["start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(off)), pa.array(kept, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["doc_id", "n_bytes", "kept", "spans"])

    return run


def suffix_dedup(docs: DataFrame, length: int = 400, keep: str = "first", gram: int = 64, block: int = 64, most: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, kept (the bytes that stay), spans (start, end of each removed run)."""
    if not (8 <= gram <= length and 1 <= block <= 64 and length - block + 1 >= 8) or keep not in ("first", "none"):
        raise ValueError("grams and cores take at least 8 bytes, blocks at most 64 starts; keep is 'first' or 'none'")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), filled(F.col(text_col)).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2"), "text")
    kind = dict(rows.dtypes)["doc_id"]

    grams = scratch(rows.select("text").mapInArrow(_grams(length, gram), "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")).where("c > 1"))
    bits = min(max((grams.count() * FILTER_SHARE).bit_length(), LEAST_BITS), MOST_BITS)
    place = F.shiftrightunsigned("gram", 64 - bits)
    words = grams.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("b")).toPandas()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap)

    schema = f"doc_id {kind}, k1 long, k2 long, base long, jlo int, jhi int, core long, context long, margins binary"
    blocks = scratch(rows.mapInArrow(_blocks(length, gram, block, shared, bits), schema))
    discard(grams)
    tidy(spark)
    # As a table of its own, so that a core that is met very often can be dealt to several tasks in the join.
    cores = scratch(blocks.groupBy("core").agg(F.count("*").alias("total")).where("total > 1").select("core"))
    # Another name for the core, so that equal contexts are summed up before they are dealt out anew: a core may be met very often.
    one = blocks.join(cores, "core").withColumn("name", F.bitwise_not("core")).drop("core")
    earlier = ["m_id", "m_k1", "m_k2", "m_base"] if keep == "first" else []
    m = [F.min(F.struct("doc_id", "k1", "k2", "base")).alias("m")] if earlier else []
    opened = one.groupBy("name", "context", "jlo", "jhi", "margins").agg(F.count("*").alias("n"), *m)
    opened = scratch(opened.select(F.bitwise_not("name").alias("core"), "context", "jlo", "jhi", "margins", "n", *(F.col(f"m.{c}").alias(x) for c, x in zip(("doc_id", "k1", "k2", "base"), earlier))))
    tidy(spark)
    large = opened.groupBy("core").agg(F.count("*").alias("kinds")).where(F.col("kinds") > most).select("core")
    large = scratch(large)
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), opened.count() // 50_000 + 1)
    small, more = opened, None
    if not large.isEmpty():
        small, more = opened.join(large, "core", "left_anti"), _one_by_one(opened.join(large, "core", "left_semi"), block, earlier)
    masks = small.withColumn("bin", F.pmod(F.xxhash64("core"), F.lit(bins))).groupBy("bin").applyInPandas(_ordered(block), "core long, context long, mask long, first long")
    masks = masks if more is None else masks.unionByName(more)

    places = blocks.select("k1", "k2", "base", "core", "context")
    if keep == "none":
        flags = scratch(masks.select("core", "context", "mask"))
        found = places.join(flags, ["core", "context"]).select("k1", "k2", "base", "mask")
    else:
        least = opened.select("core", "context", F.col("m_k1").alias("f1"), F.col("m_k2").alias("f2"), F.col("m_base").alias("fb"))
        flags = scratch(masks.join(least, ["core", "context"]))
        here = (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")) & (F.col("base") == F.col("fb"))
        found = places.join(flags, ["core", "context"]).select("k1", "k2", "base", F.when(here, F.col("mask").bitwiseAND(F.bitwise_not("first"))).otherwise(F.col("mask")).alias("mask")).where("mask <> 0")
    found = found.groupBy("k1", "k2", "base").agg(F.bit_or("mask").alias("mask")).groupBy("k1", "k2").agg(F.collect_list(F.struct("base", "mask")).alias("found"))
    found = scratch(found)
    discard(blocks, cores, opened, large, flags)
    tidy(spark)
    out = rows.join(found, ["k1", "k2"], "left").select("doc_id", "text", "found")
    return out.mapInArrow(_cut(length, block), f"doc_id {kind}, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")
