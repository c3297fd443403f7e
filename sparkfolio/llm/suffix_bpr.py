"""Suffix dedup over bytes by bucket-pointer refinement.

The suffixes that are compared are sampled: of each window the one at its least q-gram (GRAM bytes, by a hash), so equal
windows have equal samples, and Spark deals them to the bucket of that q-gram. Of a sample's segments (its windows, see
_repeats), equal ones are settled by their names. Where a bucket holds different ones, the first document of each sends its
bytes there, and their suffixes are sorted (`suffix_classes`): first into buckets of Q bytes, then each bucket that holds
several is sorted by the bucket pointers at the later offset where its depth ends, and its parts get pointers of twice the
depth; the pointers so updated are what the next refinement reads, until the window is reached. Buckets of one suffix are
never touched again. Windows that are equal byte for byte are neighbours in this order, the least document first.

Names (of grams, for sampling and dealing, and of whole segments) are 64-bit hashes by the same doubling of offsets.

Defined results: null is empty; a text under `window` bytes keeps all; rows with one doc_id do not remove each other; a
row without doc_id is returned whole and compared with nothing; texts of any length are handled whole, in overlapping
chunks; other columns are ignored. Removal may cut a character in two, so what is kept is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import MULTIPLIERS, U64, join_names, joined, mix
from ._repeats import Reader, Units, cover, remove_repeats, sliding_min

#: Bytes of an initial bucket.
GRAM = 20
FIRST = mix(np.arange(1, 257, dtype=U64) * U64(MULTIPLIERS[0]), 2)
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def byte_units(window: int):
    def units(texts: list[bytes]) -> Units:
        data, offsets = joined(texts)
        count = np.diff(offsets) - 1
        n = len(data)
        names, samples = np.zeros(n, dtype=U64), np.zeros(n, dtype=U64)
        gram = min(GRAM, window)
        if n >= window:
            pointer, size, initial = FIRST[data], 1, None
            while size * 2 <= window:
                if size <= gram < size * 2:
                    initial = mix(join_names(pointer[: n - gram + 1], pointer[gram - size :][: n - gram + 1], 4), 1)
                pointer = join_names(pointer[:-size], pointer[size:], size.bit_length())
                size *= 2
            if initial is None:
                initial = mix(join_names(pointer[: n - gram + 1], pointer[gram - size :][: n - gram + 1], 4), 1)
            names[: n - window + 1] = mix(join_names(pointer[: n - window + 1], pointer[window - size :][: n - window + 1], 5), 2)
            least = sliding_min(initial, window - gram + 1)
            samples[: len(least)] = least
        return Units(offsets[:-1], count, names, samples, data)

    return units


#: Bytes of the first buckets.
Q = 8


def suffix_classes(data: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """Bucket pointer of each suffix in `places` at depth `window`: where its bucket begins in the order of all suffixes.
    Suffixes with one pointer are equal to that depth, and pointers sort like the suffixes."""
    n, q = len(data), min(Q, window)
    padded = np.concatenate((data, np.zeros(2 * window + Q, dtype=np.uint8)))
    gram = np.zeros(n, dtype=U64)
    for k in range(q):
        gram = (gram << U64(8)) | padded[k : k + n]
    order = np.argsort(gram, kind="stable")
    fresh = np.append(True, gram[order][1:] != gram[order][:-1])
    starts = np.flatnonzero(fresh)
    pointer = np.zeros(n + window + 1, dtype=np.int64)  # past the end nothing is compared
    pointer[order] = starts[np.cumsum(fresh) - 1]
    sizes = np.diff(np.append(starts, n))
    open_ = order[np.repeat(sizes > 1, sizes)]  # suffixes in buckets of several, in order
    depth = q
    while depth < window and len(open_):
        step = min(depth, window - depth)
        own, later = pointer[open_], pointer[open_ + step]
        turn = np.lexsort((later, own))
        open_, own, later = open_[turn], own[turn], later[turn]
        bucket = np.append(True, own[1:] != own[:-1])
        part = bucket | np.append(True, later[1:] != later[:-1])
        at, begins = np.arange(len(open_)), np.flatnonzero(part)
        first = np.flatnonzero(bucket)[np.cumsum(bucket) - 1]
        which = np.cumsum(part) - 1
        pointer[open_] = own + (begins[which] - first)  # a part begins as far into its bucket as it was sorted to
        sizes = np.diff(np.append(begins, len(at)))
        open_ = open_[(sizes > 1)[which]]
        depth += step
    return pointer[places]


def byte_reader(window: int) -> Reader:
    def cut(text: bytes, size: int) -> list[tuple[int, int, int]]:
        return [(a, min(len(text), a + size + window - 1), a) for a in range(0, len(text), size)]

    return Reader(byte_units(window), cut, window, lambda data, places: suffix_classes(data, places, window))


def _finish(reader: Reader, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, masks in cover(batches, reader):
            n_bytes, removed, spans, digest, kept = [], [], [], [], []
            for text, mask in zip(texts, masks):
                left = text
                if mask is not None:
                    left = np.frombuffer(text, dtype=np.uint8)[~mask].tobytes()
                n_bytes.append(len(text))
                removed.append(len(text) - len(left))
                spans.append(0 if mask is None else int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1])))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left if keep else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeated_bytes(documents: DataFrame, window: int = 50, keep: bool = True) -> DataFrame:
    """documents: doc_id, text. Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (null unless `keep`)."""
    docs = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"))
    reader = byte_reader(window)
    return remove_repeats(docs, reader, _finish(reader, keep), SCHEMA, "bpr")
