"""Words of whole Arrow text columns as 64-bit hashes, without a Python loop over words or documents.

Texts are UTF-8 bytes; blanks and A-Z are single bytes there, so splitting and lower-casing bytes is exact.
Work goes on in groups of documents of about GROUP bytes, so that memory stays bounded whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT, GROUP = 1 << 20, 4 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: dict[str, np.ndarray] = {}


def _tables(letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes stand between words, and bytes lower-cased, plus one."""
    if "blank" not in _powers:
        blank = np.zeros(256, bool)
        blank[[32, *range(9, 14)]] = True
        signs = np.arange(256) < 128
        for first, last in ("09", "AZ", "az"):
            signs[ord(first) : ord(last) + 1] = False
        lower = np.arange(256, dtype=np.uint64)
        lower[65:91] += np.uint64(32)
        _powers["blank"], _powers["signs"], _powers["lower"] = blank, signs, lower + np.uint64(1)
    return _powers["signs" if letters else "blank"], _powers["lower"]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers and their inverses modulo 2**64, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SEGMENT + 1)
        inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, base in (("up", MULTIPLIER), ("down", inverse)):
                run = np.full(size, base, np.uint64)
                run[0] = 1
                _powers[name] = np.multiply.accumulate(run)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a bijection)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string or binary column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    parts = texts.buffers()
    off = np.frombuffer(parts[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(parts[2], np.uint8) if parts[2] is not None and parts[2].size else np.zeros(0, np.uint8)
    return data, off


def doc_groups(off: np.ndarray, limit: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most limit bytes together, or of one document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _segment(x: np.ndarray, cuts: np.ndarray, letters: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of one piece; cuts: where documents start in it."""
    blank, lowered = _tables(letters)
    full = ~blank[x]
    first, last = full.copy(), full.copy()
    first[1:] &= ~full[:-1]
    last[:-1] &= ~full[1:]
    first[cuts] = full[cuts]
    last[cuts - 1] = full[cuts - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    if not len(s):
        return np.zeros(0, np.uint64), s
    up, down = powers(len(x))
    with np.errstate(over="ignore"):
        sums = np.cumsum(lowered[x] * up[: len(x)])
        h = (sums[e] - np.where(s > 0, sums[s - 1], np.uint64(0))) * down[s]
    return mix(h), s


def words(data: np.ndarray, off: np.ndarray, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z lower-cased, and the number of its document (from 0), for the documents that off bounds.

    letters: words are runs of ASCII letters, digits and non-ASCII characters; else runs of anything but blanks.
    """
    hashes, starts = [], []
    a, end = int(off[0]), int(off[-1])
    blank, _ = _tables(letters)
    while a < end:
        b = min(a + SEGMENT, end)
        if b < end:
            cut = int(off[np.searchsorted(off, b, "right") - 1])
            if cut > a:
                b = cut
            else:  # inside a long document: cut at a blank
                gaps = np.flatnonzero(blank[data[a:b]])
                if len(gaps):
                    b = a + int(gaps[-1]) + 1
                else:
                    stop = int(off[np.searchsorted(off, a, "right")])
                    gap = np.flatnonzero(blank[data[b:stop]])
                    b = b + int(gap[0]) + 1 if len(gap) else stop
        cuts = off[np.searchsorted(off, a, "right") : np.searchsorted(off, b, "left")] - a
        h, s = _segment(data[a:b], np.unique(cuts), letters)
        hashes.append(h)
        starts.append(s + a)
        a = b
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(off[1:], at, "right")


def chain(*parts: np.ndarray) -> np.ndarray:
    """One hash of several in order, element by element."""
    with np.errstate(over="ignore"):
        out = parts[0]
        for p in parts[1:]:
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + p)
        return out
