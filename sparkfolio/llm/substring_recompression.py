"""Substring dedup by recompression over words.

Round 0 names runs of one token; each later round names neighbouring pairs whose left name falls on the left side and
whose right name on the right side of a fixed split of all names. A name is a 64-bit hash of what it stands for, so it
is global: every task gives equal strings equal names with no dictionary to exchange, and the names of a repeat differ
only near its ends. A symbol whose whole context lies inside a window is the same wherever that window occurs, so the
least such symbol of the highest round (widened to the words of a context) is the window's sample, and shared samples
reveal repeats. A window's name is made of all such symbols in it and of the words beside them, so symbols verify repeats
too, segment by segment and window by window (see _repeats). A window without such a symbol, inside a long run, is its
own sample.

Defined results: null or empty text has no words; a text under `window` words keeps all; rows with one doc_id do not
remove each other; a row without doc_id is returned whole and compared with nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import U64, fold, join_names, joined, mix, span_hashes, word_bounds
from ._repeats import LONG, Reader, Units, cover, remove_repeats, sliding_min

NONE = U64(0xFFFFFFFFFFFFFFFF)
_BLANK = bytes(32 if i in (9, 10, 11, 12, 13) else i for i in range(256))
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def rounds_for(window: int) -> int:
    """Rounds whose widest symbol, with its context, takes half a window at most: a window without long runs then holds one."""
    return max(0, ((window + 1) // 6).bit_length() - 1)


def context_of(rounds: int) -> int:
    """The most words that a symbol of the last round and its context take, runs aside: 2^rounds words and, on each side,
    one word for the runs and 2^r - 1 words for the pairs of all rounds."""
    return 3 * 2**rounds


def symbols(names: np.ndarray, doc: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of the last round's symbols, the first word of each, and the words (begin, end) that determine each, with its
    context; a symbol whose context would leave its document begins before 0."""
    n = len(names)
    far = -(1 << 40)
    new = np.append(True, (names[1:] != names[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    owner = doc[first]
    name = np.where(size > 1, mix(names[first] + size.astype(U64), 3), names[first])
    begin, end = first - 1, first + size + 1
    edge = np.append(True, owner[1:] != owner[:-1])
    begin[edge] = far
    end[np.append(edge[1:], True)] = -far
    for r in range(rounds):
        side = (mix(name + U64(r + 1), 4) >> U64(40)) & U64(1)
        pair = (side[:-1] == 0) & (side[1:] == 1) & (owner[1:] == owner[:-1])
        # the neighbours decide too: a symbol is taken by the pair on its left, on its right or by none
        before = np.append(begin[:1], np.where(owner[1:] == owner[:-1], begin[:-1], far))
        after = np.append(np.where(owner[1:] == owner[:-1], end[1:], -far), -far)
        low, high = np.minimum(begin, before), np.maximum(end, after)
        tail = np.append(False, pair)
        merged = join_names(name[:-1], name[1:], r)
        name, begin, end = name.copy(), low, high
        at = np.flatnonzero(pair)
        name[at] = mix(merged[at] + U64(r + 7), 1)
        end[at] = high[at + 1]
        keep = ~tail
        name, first, begin, end, owner = name[keep], first[keep], begin[keep], end[keep], owner[keep]
    begin[end > (1 << 39)] = far
    return name, first, begin, end


def window_names(names: np.ndarray, name: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """The name of the window at each word: the symbols that lie in it with their contexts, and the words beside them.
    Those symbols depend on the window alone, so equal windows have equal names; each symbol stands for its words, so
    equal names have equal words."""
    at = np.arange(len(names) - window + 1)
    inner = np.flatnonzero(begin >= 0)
    low = np.searchsorted(begin[inner], at)
    high = np.maximum(low, np.searchsorted(end[inner], at + window, side="right"))
    some = high > low
    left = np.full(len(at), window) + at
    right = left.copy()
    left[some] = first[inner[low[some]]]
    right[some] = np.append(first[1:], len(names))[inner[high[some] - 1]]
    out = join_names(fold(names, at, left), fold(name[inner], low, high), 4)
    return mix(join_names(mix(out, 1), fold(names, right, at + window), 5), 2)


def word_units(window: int):
    rounds = rounds_for(window)
    context = context_of(rounds)

    def units(texts: list[bytes]) -> Units:
        data, offsets = joined(texts)
        starts, ends = word_bounds(data)
        names = span_hashes(data, starts, ends)
        begin = np.searchsorted(starts, offsets[:-1])
        count = np.diff(np.append(begin, len(starts)))
        n = len(names)
        windows = np.zeros(n, dtype=U64)
        samples = np.full(n, NONE)
        if n >= window:
            name, first, low, high = symbols(names, np.repeat(np.arange(len(texts)), count), rounds)
            windows[: n - window + 1] = window_names(names, name, first, low, high, window)
            value = np.full(n, NONE)
            if context <= window:
                good = (low >= 0) & (high - low <= context) & (low + context <= n)
                wide = fold(names, low[good], low[good] + context)
                np.minimum.at(value, low[good], mix(name[good] + wide, 2))
                least = sliding_min(value, window - context + 1)
                samples[: len(least)] = least
            alone = samples == NONE
            samples[alone] = windows[alone]
        return Units(begin, count, windows, samples)

    return units


def word_reader(window: int) -> Reader:
    def cut(text: bytes, size: int) -> list[tuple[int, int, int]]:
        starts, ends = word_bounds(np.frombuffer(text + b"\n", dtype=np.uint8))
        first = np.unique(np.searchsorted(starts, np.arange(0, len(text), size)))
        first = first[first < len(starts)]
        last = np.minimum(np.append(first[1:], len(starts)) + window - 1, len(starts))
        return [(int(starts[a]), int(ends[b - 1]), int(a)) for a, b in zip(first, last)]

    return Reader(word_units(window), cut, window)


def _kept(text: bytes, mask: np.ndarray | None) -> tuple[int, int, bytes]:
    """Words, removed words, and the kept words joined by spaces."""
    if len(text) <= LONG:
        words = text.split()
        left = words if mask is None else [w for w, gone in zip(words, mask.tolist()) if not gone]
        return len(words), len(words) - len(left), b" ".join(left)
    data = np.frombuffer(text + b"\n", dtype=np.uint8)
    starts, ends = word_bounds(data)
    stay = np.ones(len(starts), dtype=bool) if mask is None else ~mask
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[starts[stay]] += 1
    edge[ends[stay] + 1] -= 1  # with the separator after each word
    out = data[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes().translate(_BLANK)
    return len(starts), int(len(starts) - stay.sum()), out[:-1]


def _finish(reader: Reader, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, masks in cover(batches, reader):
            n_words, removed, digest, kept = [], [], [], []
            for text, mask in zip(texts, masks):
                n, gone, out = _kept(text, mask)
                n_words.append(n)
                removed.append(gone)
                digest.append(hashlib.sha256(out).hexdigest())
                kept.append(out if keep else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeated_words(documents: DataFrame, window: int = 50, keep: bool = True) -> DataFrame:
    """documents: doc_id, text. Per row: doc_id, n_words, n_removed, kept_sha256, kept_text (null unless `keep`)."""
    docs = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"))
    reader = word_reader(window)
    return remove_repeats(docs, reader, _finish(reader, keep), SCHEMA, "recompression")
