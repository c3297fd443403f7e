"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits form a ring of SEGMENTS segments. If two fingerprints differ in at most `max_bits` bits, some
segment begins a chain in which the first l segments differ in at most l * max_bits / SEGMENTS bits, for every l. With
four bits and five segments the first segment must be equal and the second may differ in one bit, so one of its halves
is equal too: candidates share (first segment, half of the next). Longer chains are then tested, and only pairs whose
every chain stays within its budget get the full Hamming check.

Equal fingerprints are collapsed first. Groups of candidates are searched breadth-first among fingerprints not reached
yet, so a dense group costs about its size and yields a spanning forest, not all its pairs; groups over GROUP
fingerprints are dealt out as pairs of blocks.

Defined results: words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a text with fewer words than a shingle has one
shingle; null or no words: fingerprint zero, linked like any other; equal rows share a component; a row without doc_id
is returned and never names a component (its component_id may be null); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, materialise, release, slices, small_batches, tidy, tidy_group
from ._components import components

SEGMENTS = 5
#: Widths of the ring's segments, from the low bits up (fixed values; they sum to 64).
WIDTHS = (13, 13, 13, 13, 12)
#: Bits of the ring's later halves that make the second part of a key.
HALF = 6
GROUP = 20_000
#: Shingles of one text that are hashed at once.
BLOCK = 200_000
#: Groups up to this size are compared by shifts of the sorted bucket.
SMALL = 32


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=U64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    first = np.concatenate(([0], ends[: len(last) - 1] + 1))
    parts = (map(line.__getitem__, map(slice, first[k : k + BLOCK].tolist(), last[k : k + BLOCK].tolist())) for k in range(0, len(last), BLOCK))
    return np.frombuffer(b"".join(b"".join(map(xxhash.xxh64_digest, p, repeat(seed))) for p in parts), dtype=">u8").astype(U64)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For consecutive groups of hashes: the bits that are set in over half of each group. Eight counters of a byte each
    are added at once, so groups are cut into parts of 255."""
    owner = np.repeat(np.arange(len(sizes)), -(-sizes // 255))
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    parts = begin[owner] + 255 * place
    counts = np.zeros((len(sizes), 8, 8), dtype=np.int64)
    edges = np.searchsorted(owner, np.arange(len(sizes)))
    for b in range(8):
        lanes = np.add.reduceat((hashes >> U64(b)) & U64(0x0101010101010101), parts)
        counts[:, :, b] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), edges, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > sizes[:, None, None], axis=2, bitorder="little").reshape(-1, 8).view("<u8").ravel().astype(U64)


def _hashed(texts: list[bytes], hashes) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Texts with words, the hashes of all their shingles, and how many each has."""
    found = [hashes(t) for t in texts]
    some = [i for i, h in enumerate(found) if len(h)]
    return some, np.concatenate([found[i] for i in some]) if some else np.zeros(0, dtype=U64), np.array([len(found[i]) for i in some], dtype=np.int64)


def fingerprints(documents: DataFrame, shingle: int, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            out = np.zeros(len(texts), dtype=U64)
            some, hashes, sizes = _hashed(texts, lambda t: shingle_hashes(t, shingle, seed))
            if some:
                out[some] = majority(hashes, sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fingerprint"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(docs).mapInArrow(tidy(run), "doc_id long, fingerprint long")


def _segment(value, k: int):
    k %= SEGMENTS
    return F.shiftrightunsigned(value, sum(WIDTHS[:k])).bitwiseAND(F.lit((1 << WIDTHS[k]) - 1).cast("long"))


def _keys(value):
    """The ten keys of a fingerprint: ring position and half, first segment, half of the second segment."""
    out = []
    for k in range(SEGMENTS):
        first, second = _segment(value, k), _segment(value, k + 1)
        low, high = second.bitwiseAND(F.lit((1 << HALF) - 1).cast("long")), F.shiftright(second, HALF)
        for half, part in enumerate((low, high)):
            out.append(F.lit((2 * k + half) << 40).cast("long") + F.shiftleft(first, 16) + part)
    return F.array(*out)


def chains_hold(x: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether, for differences x, some segment's chains all stay within their proportional budgets."""
    low, parts = 0, []
    for w in WIDTHS:
        parts.append(np.bitwise_count((x >> U64(low)) & U64((1 << w) - 1)).astype(np.int64))
        low += w
    good = np.zeros(len(x), dtype=bool)
    for k in range(SEGMENTS):
        total, fine = np.zeros(len(x), dtype=np.int64), np.ones(len(x), dtype=bool)
        for n in range(SEGMENTS):
            total = total + parts[(k + n) % SEGMENTS]
            fine &= total * SEGMENTS <= (n + 1) * max_bits
        good |= fine
    return good


def _linked(x: np.ndarray, max_bits: int) -> np.ndarray:
    """Places of the differences x that are links: chains first, then the full check."""
    at = np.flatnonzero(chains_hold(x, max_bits))
    return at[np.bitwise_count(x[at]) <= max_bits]


def _forest(values: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span each component of the values."""
    out, waiting = [], values
    while len(waiting):
        queue, waiting = [waiting[:1]], waiting[1:]
        while queue and len(waiting):
            block = queue.pop()
            for x in block:
                near = _linked(waiting ^ x, max_bits)
                if len(near):
                    out.append((np.full(len(near), x), waiting[near]))
                    queue.append(waiting[near])
                    waiting = np.delete(waiting, near)
                if not len(waiting):
                    break
    return out


def _search(max_bits: int):
    def run(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        part = table.column("part").to_numpy()
        value = table.column("fingerprint").to_numpy().view(U64)
        order = np.lexsort((value, part, key))
        key, part, value = key[order], part[order], value[order]
        starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        group, size = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes, sizes)
        found = []
        small = np.flatnonzero((size > 1) & (size <= SMALL))
        g, v = group[small], value[small]
        for k in range(1, min(SMALL, len(v))):
            same = np.flatnonzero(g[k:] == g[:-k])
            if not len(same):
                break
            at = same[_linked(v[same] ^ v[same + k], max_bits)]
            found.append((v[at], v[at + k]))
        for a, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            found += _forest(value[a : a + n], max_bits)
        left, right = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, U64), np.zeros(0, U64))
        pairs = np.unique(np.stack((np.minimum(left, right), np.maximum(left, right)), axis=1), axis=0) if len(left) else np.zeros((0, 2), U64)
        return pa.table({"a": pa.array(np.ascontiguousarray(pairs[:, 0]).view(np.int64)), "b": pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))})

    return run


def links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """distinct: one row for each fingerprint. Links that connect all fingerprints within max_bits of each other."""
    if not 0 <= max_bits < SEGMENTS:
        raise ValueError(f"max_bits must be 0 to {SEGMENTS - 1}")
    keyed = distinct.select("fingerprint", F.explode(_keys(F.col("fingerprint"))).alias("key"))
    counts = keyed.groupBy("key").count().where("count > 1")
    sized = keyed.join(counts, "key").withColumn("blocks", F.ceil(F.col("count") / GROUP).cast("int"))
    block = F.pmod(F.xxhash64("fingerprint"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.least(other.cast("long"), block) * 65536 + F.greatest(other.cast("long"), block))
    dealt = sized.select("key", "fingerprint", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("part"))
    rows = distinct.count() * 10
    buckets = max(48, rows // 500_000)
    return dealt.withColumn("bucket", F.pmod(F.xxhash64("key", "part"), F.lit(buckets)).cast("int")).groupBy("bucket").applyInArrow(tidy_group(_search(max_bits)), "a long, b long")


def simhash_groups(documents: DataFrame, shingle: int = 5, max_bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (least doc_id that links reach)."""
    prints = materialise(fingerprints(documents, shingle), "fingerprints")
    distinct = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct, max_bits))
    release(documents.sparkSession)
    named = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = named.join(least, "root").select("fingerprint", "component_id")
    return prints.join(answer, "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")

