"""Near copies by long SimHash fingerprints on a ring, for similarities that 64 bits can't tell.

1. Two texts whose shingle sets have Jaccard similarity s differ in about arccos(2s / (1 + s)) / pi of their SimHash bits,
   so RING = 512 bits estimate s to a few hundredths; `budget` is the most bits that may differ.
2. Candidates: the bits form rings, each in an order of its own, that are cut into chains of `bits` bits which don't
   overlap; candidates share one of `starts` chains. Chains of a ring exclude each other's bits and rings are independent,
   so a pair at the very end of the budget shares none with a probability of MISS at most, at every count of fingerprints,
   and a pair at the threshold much more seldom. `bits` follows from the count of distinct fingerprints, so groups of
   unrelated texts stay small at every size, and `starts` from `bits`, without a limit: about as the 0.3rd power of the
   count. An exact index doesn't exist at this budget: a fifth of the bits may differ, so only 5 bits are sure to be equal.
3. Pigeonring filter: the fingerprint's words are a ring of WORDS segments; of two fingerprints within the budget some
   segment begins chains whose differences, added up segment by segment, stay within l / WORDS of the budget for every
   length l. Pairs without such chains of up to CHAIN segments go before the full Hamming check.
4. What the links connect is verified on the texts: within each connected group, texts are linked only if their shingle
   sets (names of 4 bytes) have similarity s or more, and the groups of these links are the result.

Equal fingerprints are collapsed first, and groups are searched breadth-first (see simhash_pigeonring). A chain that more
than GROUP fingerprints share, and a connected group with more than SETS bytes of shingles, are dealt out as pairs of
blocks, so no task gets an unbounded group and no group yields all its pairs. ROUND chains are searched at a time, fewer
where there are so many fingerprints that more than HOT chains could be common; that bounds the disk and what is broadcast.

Defined results: words are split at \x20 and \x09 to \x0D after lower-casing A-Z; a text with fewer words than a shingle
has one shingle; shingles are counted once; texts without words (and null) are no copies of anything; rows without doc_id
are left out of the groups; texts of one fingerprint (equal shingle sets, as far as 512 bits tell) are copies; rows that
share a doc_id but not the text are told apart by their fingerprints; other columns are ignored; texts of any length are
read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import MULTIPLIERS, U64, few, materialise, mix, release, slices, small_batches, tidy, tidy_group, without
from ._components import components, stars
from .simhash_pigeonring import GROUP, SMALL, _hashed, majority, shingle_hashes

RING, WORDS, CHAIN = 512, 8, 4
NOTHING = bytes(64)
#: Bytes of shingles of one connected group that a task verifies at once, and about so many to a task in all.
SETS = 2 << 20
#: Members of connected groups that are broadcast at most (about 120 bytes each).
MEMBERS = 300_000
#: Fingerprints whose chains are named at once.
ROWS = 512
#: Chains that are known to be common everywhere, at most: what is broadcast has 16 bytes for each.
HOT = 1_000_000
#: Standard deviations of the differing bits by which the budget exceeds their mean at the threshold: pairs at the
#: threshold are found, and so are some that are a little less alike.
SLACK = 2.5
#: Probability that a pair at the very end of the budget shares no chain.
MISS = 0.03
#: Bytes of a bucket of chains at most (less, as a fingerprint goes to a bucket once for all its chains there); larger
#: buckets send a fingerprint to fewer of them.
BUCKET = 40 << 20
#: Chains that are sent and searched at once.
ROUND = 96


def budget(similarity: float) -> int:
    """Differing bits that are still a link."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(RING * p + SLACK * math.sqrt(RING * p * (1 - p)))


def chains(count: int, similarity: float) -> tuple[int, int]:
    """Bits of a chain, about 16 unrelated fingerprints to each value at most, and how many chains there are."""
    most = budget(similarity)
    bits = min(32, max(14, math.ceil(math.log2(max(count, 1))) - 4))
    equal = math.prod((RING - most - j) / (RING - j) for j in range(bits))
    return bits, 1 if equal == 1 else math.ceil(math.log(MISS) / math.log1p(-equal))


@lru_cache(maxsize=4)
def _places(bits: int, starts: int) -> np.ndarray:
    """The bits of each chain, starts x bits: chains of one ring share none."""
    each = RING // bits
    rings = -(-starts // each)
    order = np.argsort(mix(mix(np.arange(1, rings * RING + 1, dtype=U64) * U64(MULTIPLIERS[0]), 4), 5).reshape(rings, RING), axis=1, kind="stable")
    return order[:, : each * bits].reshape(-1, bits)[:starts]


def _fingerprint(texts: list[bytes], shingle: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Fingerprints of the texts (zero without words), and the shingle set of each that has words."""
    out = np.zeros((len(texts), WORDS), dtype=U64)
    some, hashes, sizes = _hashed(texts, lambda t: np.unique(shingle_hashes(t, shingle)))
    for k in range(WORDS if some else 0):
        out[some, k] = majority(mix(hashes + U64(MULTIPLIERS[k % 6] * (k + 1) % 2**64), k % 6), sizes)
    return out, dict(zip(some, np.split(hashes, np.cumsum(sizes)[:-1]))) if some else {}


def long_fingerprints(documents: DataFrame, shingle: int) -> DataFrame:
    """doc_id, fingerprint (64 bytes; all zero without words), shingles (how many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            prints, sets = _fingerprint(texts, shingle)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in prints], pa.binary()), pa.array([len(sets.get(i, ())) for i in range(len(texts))], pa.int64())], ["doc_id", "fingerprint", "shingles"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(docs).mapInArrow(tidy(run), "doc_id long, fingerprint binary, shingles long")


def shingle_sets(documents: DataFrame, shingle: int, others: str) -> DataFrame:
    """documents: fingerprint, text and others (their schema). The others and the shingles (names of 4 bytes) of the texts
    that have the fingerprint."""
    names = [x.split()[0] for x in others.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            prints, sets = _fingerprint(texts, shingle)
            wanted = batch.column("fingerprint").to_pylist()
            good = [i for i in sets if prints[i].tobytes() == wanted[i]]
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), pa.array([sets[i].astype(np.uint32).tobytes() for i in good], pa.binary())], [*names, "shingles"])

    return small_batches(documents.select(*names, "fingerprint", "text")).mapInArrow(tidy(run), f"{others}, shingles binary")


def _keys(prints: np.ndarray, bits: int, starts: int, first: int = 0) -> np.ndarray:
    """Names of each fingerprint's chains from `first` on: rows x (starts - first)."""
    if len(prints) > ROWS:
        return np.concatenate([_keys(prints[i : i + ROWS], bits, starts, first) for i in range(0, len(prints), ROWS)])
    ring = np.ascontiguousarray(np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1).T)
    places = _places(bits, starts)[first:]
    value = np.zeros((len(places), len(prints)), dtype=U64)
    for k in range(bits):
        value |= ring[places[:, k]].astype(U64) << U64(k)
    value += (np.arange(first + 1, starts + 1, dtype=U64) << U64(40))[:, None]
    return np.ascontiguousarray(mix(value, 3).T)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, 4 * ROWS) for b in batches for i in range(0, b.num_rows, 4 * ROWS))


def _linked(one: np.ndarray, others: np.ndarray, most: int) -> np.ndarray:
    """Places of the others within `most` bits."""
    return _in_budget(np.bitwise_count(others ^ one).astype(np.int16), most)


def _in_budget(ring: np.ndarray, most: int) -> np.ndarray:
    """Of rows of differences by segment: those of which some segment's chains stay within their budgets, and all of which
    do together."""
    total, fine = ring, ring * WORDS <= most
    for n in range(1, CHAIN):
        total = total + np.roll(ring, -n, axis=1)
        fine &= total * WORDS <= (n + 1) * most
    at = np.flatnonzero(fine.any(axis=1))
    return at[ring[at].sum(axis=1) <= most]


def _forest(ids: np.ndarray, prints: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out, waiting = [], np.arange(len(ids))
    while len(waiting):
        queue, waiting = [waiting[:1]], waiting[1:]
        while queue and len(waiting):
            for x in queue.pop().tolist():
                near = _linked(prints[x], prints[waiting], most)
                if len(near):
                    out.append((np.full(len(near), ids[x]), ids[waiting[near]]))
                    queue.append(waiting[near])
                    waiting = np.delete(waiting, near)
                if not len(waiting):
                    break
    return out


def _search(most: int):
    def run(table: pa.Table) -> pa.Table:
        keys, rows, ids, prints, held = [], [], [], [], 0
        for blob in table.column("payload").to_pylist():
            n, t = np.frombuffer(blob, dtype=np.int64, count=2)
            index = np.frombuffer(blob, dtype=np.uint32, count=n, offset=16 + 8 * n)
            keys.append(np.frombuffer(blob, dtype=U64, count=n, offset=16))
            rows.append(index + np.uint32(held))
            ids.append(np.frombuffer(blob, dtype=np.int64, count=t, offset=16 + 12 * n))
            prints.append(np.frombuffer(blob, dtype=U64, count=t * WORDS, offset=16 + 12 * n + 8 * t).reshape(t, WORDS))
            held += int(t)
        key, row, each, print_ = np.concatenate(keys), np.concatenate(rows), np.concatenate(ids), np.concatenate(prints)
        del keys, rows, ids, prints
        order = np.lexsort((each[row], key))
        key, row = key[order], row[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(first, len(key)))
        size = np.repeat(sizes, sizes)
        found = []
        small = np.flatnonzero((size > 1) & (size <= SMALL))
        k, v = key[small], row[small]
        for step in range(1, min(SMALL, len(v))):
            same = np.flatnonzero(k[step:] == k[:-step])
            if not len(same):
                break
            for a in range(0, len(same), 100_000):
                at = same[a : a + 100_000]
                at = at[_linked(print_[v[at]], print_[v[at + step]], most)]
                found.append((each[v[at]], each[v[at + step]]))
        for a, n in zip(first[sizes > SMALL], sizes[sizes > SMALL]):
            found += _forest(each[row[a : a + n]], print_[row[a : a + n]], most)
        left, right = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        node, root = stars(left, right)
        return pa.table({"a": pa.array(node), "b": pa.array(root)})

    return run


def _rounds(count: int, starts: int) -> list[tuple[int, int, int, int]]:
    """First and last chain, and part and parts of their values, of each round: so few that HOT values at most can each be
    shared by more than GROUP of so many fingerprints."""
    each = min(ROUND, HOT * GROUP // max(count, 1))
    parts = 1 if each else -(-count // (HOT * GROUP))
    rounds = -(-starts // max(each, 1))
    edges = [starts * k // rounds for k in range(rounds + 1)]
    return [(a, b, p, parts) for a, b in zip(edges, edges[1:]) for p in range(parts)]


def links(distinct: DataFrame, similarity: float) -> DataFrame:
    """distinct: node and fingerprint, one row for each fingerprint. Links a, b that connect what the candidates find.
    Rounds of chains follow each other, and each one's shuffle files go before the next."""
    count = distinct.count()
    bits, starts = chains(count, similarity)
    rounds = _rounds(count, starts)
    out = None
    for one in rounds:
        found = _links(distinct, count, bits, *one, budget(similarity))
        if len(rounds) > 1:
            found = materialise(found, "round")
            release(distinct.sparkSession)
        out = found if out is None else out.unionByName(found)
    return out


def _links(distinct: DataFrame, count: int, bits: int, first: int, last: int, part: int, parts: int, most: int) -> DataFrame:
    """Links by the chains from `first` to `last`, of the part of their values."""
    spark = distinct.sparkSession
    starts = last - first
    most_at_once = GROUP
    buckets = int(max(32, -(-count * starts * 84 // parts // BUCKET)))

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = batch.column("node").to_numpy(zero_copy_only=False)
        prints = np.frombuffer(b"".join(batch.column("fingerprint").to_pylist()), dtype=U64).reshape(-1, WORDS)
        return ids, prints, _keys(prints, bits, last, first)

    def mine(keys: np.ndarray) -> np.ndarray:
        return keys[(keys >> U64(8)) % U64(parts) == U64(part)] if parts > 1 else keys.ravel()

    def bucket_of(keys: np.ndarray) -> np.ndarray:
        return ((keys >> U64(20)) % U64(buckets)).astype(np.int32)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            if batch.num_rows:
                keys, n = np.unique(mine(read(batch)[2]), return_counts=True)
                if not len(keys):
                    continue
                order = np.argsort(bucket_of(keys), kind="stable")
                keys, n, owner = keys[order], n[order], bucket_of(keys)[order]
                at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                ends = np.append(at[1:], len(owner))
                yield pa.RecordBatch.from_arrays([pa.array(owner[at]), pa.array([keys[a:b].tobytes() + n[a:b].astype(np.uint32).tobytes() for a, b in zip(at, ends)], pa.binary())], ["bucket", "payload"])

    def large(table: pa.Table) -> pa.Table:
        blobs = table.column("payload").to_pylist()
        keys = np.concatenate([np.frombuffer(b, dtype=U64, count=len(b) // 12) for b in blobs])
        n = np.concatenate([np.frombuffer(b, dtype=np.uint32, offset=len(b) // 12 * 8) for b in blobs])
        keys, place = np.unique(keys, return_inverse=True)
        total = np.bincount(place, weights=n).astype(np.int64)
        return pa.table({"key": pa.array(keys[total > most_at_once].view(np.int64)), "n": pa.array(total[total > most_at_once])})

    # values that over GROUP fingerprints share; see _rounds for why these are HOT at most
    hot = sorted((r.key & (2**64 - 1), -(-r.n // most_at_once)) for r in distinct.mapInArrow(tidy(tally), "bucket int, payload binary").groupBy("bucket").applyInArrow(tidy_group(large), "key long, n long").collect()) if count > most_at_once else []
    held = spark.sparkContext.broadcast((np.array([k for k, _ in hot], dtype=U64), np.array([n for _, n in hot], dtype=np.int64)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_keys, hot_blocks = held.value
        for batch in _parts(batches):
            ids, prints, keys = read(batch)
            key, row = keys.ravel(), np.repeat(np.arange(len(ids), dtype=np.uint32), starts)
            if parts > 1:
                kept = (key >> U64(8)) % U64(parts) == U64(part)
                key, row = key[kept], row[kept]
            if len(hot_keys):
                place = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                is_hot = hot_keys[place] == key
                extra_key, extra_row = [key[~is_hot]], [row[~is_hot]]
                at = np.flatnonzero(is_hot)
                blocks = hot_blocks[place[at]]
                own = (mix(prints[row[at], 0], 2) % blocks.astype(U64)).astype(np.int64)
                for other in range(int(blocks.max(initial=0))):
                    some = blocks > other
                    low, high = np.minimum(own[some], other), np.maximum(own[some], other)
                    extra_key.append(mix(key[at[some]] + (low * 65536 + high + 1).astype(U64), 4))
                    extra_row.append(row[at[some]])
                key, row = np.concatenate(extra_key), np.concatenate(extra_row)
            owner = bucket_of(key)
            order = np.argsort(owner, kind="stable")
            key, row, owner = key[order], row[order], owner[order]
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            blobs = []
            for a, b in zip(begin, np.append(begin[1:], len(owner))):
                used, index = np.unique(row[a:b], return_inverse=True)
                blobs.append(b"".join((np.array([b - a, len(used)], dtype=np.int64).tobytes(), key[a:b].tobytes(), index.astype(np.uint32).tobytes(), ids[used].tobytes(), prints[used].tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(owner[begin]), pa.array(blobs, pa.binary())], ["bucket", "payload"])

    return distinct.mapInArrow(tidy(send), "bucket int, payload binary").groupBy("bucket").applyInArrow(tidy_group(_search(most)), "a long, b long")


def similar(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Places (a, b) of sets whose Jaccard similarity is `similarity` or more: links that span each group of them."""
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    universe, names = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    held, out, waiting = np.zeros(len(universe), dtype=bool), [], np.arange(len(sets))
    while len(waiting):
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            x = queue.pop()
            own = names[begin[x] : begin[x] + sizes[x]]
            can = (sizes[waiting] >= similarity * sizes[x]) & (sizes[waiting] * similarity <= sizes[x])
            some = waiting[can]
            if not len(some):
                continue
            held[own] = True
            ends = np.cumsum(sizes[some])
            place = np.arange(ends[-1]) + np.repeat(begin[some] - (ends - sizes[some]), sizes[some])
            both = np.add.reduceat(held[names[place]], ends - sizes[some], dtype=np.int64)
            held[own] = False
            near = both >= similarity * (sizes[x] + sizes[some] - both) - 1e-9
            out += [(x, y) for y in some[near].tolist()]
            queue += some[near].tolist()
            stay = np.ones(len(waiting), dtype=bool)
            stay[np.flatnonzero(can)[near]] = False
            waiting = waiting[stay]
    return out


def _verify(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        group = np.stack((table.column("root").to_numpy(), table.column("part").to_numpy()), axis=1)
        node = table.column("node").to_numpy()
        blobs = table.column("shingles").combine_chunks()
        order = np.lexsort((node, group[:, 1], group[:, 0]))
        edge = np.flatnonzero(np.append(True, (group[order][1:] != group[order][:-1]).any(axis=1)))
        a, b = [], []
        for first, last in zip(edge, np.append(edge[1:], len(order))):
            rows = order[first:last]
            for x, y in similar([np.frombuffer(blobs[int(i)].as_buffer(), dtype=np.uint32) for i in rows], similarity) if len(rows) > 1 else ():
                a.append(int(node[rows[x]]))
                b.append(int(node[rows[y]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def verified(documents: DataFrame, distinct: DataFrame, loose: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links a, b between nodes whose shingle sets are similar, within the groups loose (node, root). Only the texts that
    stand for the groups' fingerprints are read; their shingles are shuffled once."""
    grouped = loose.unionByName(loose.select(F.col("root").alias("node"), "root").distinct())
    wanted = distinct.join(grouped, "node")
    size = wanted.groupBy("root").agg(F.sum(F.col("shingles") * 4 + 16).alias("bytes")).withColumn("blocks", F.ceil(F.col("bytes") / SETS).cast("int"))
    wanted = materialise(wanted.join(size, "root").select("least", "fingerprint", "node", "root", "bytes", "blocks"), "candidates")
    total = wanted.select("root", "bytes", "blocks").distinct().agg(F.sum(F.col("bytes") * F.col("blocks"))).first()[0] or 0
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text"))
    read = docs.join(few(wanted, MEMBERS), F.col("__id") == F.col("least"))
    sets = shingle_sets(read, shingle, "node long, root long, blocks int")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.least(other.cast("long"), block) * 65536 + F.greatest(other.cast("long"), block))
    parts = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(pairs)
    buckets = int(max(48, total // SETS))
    dealt = sets.select("root", "node", "shingles", F.explode(parts).alias("part"))
    return dealt.withColumn("bucket", F.pmod(F.xxhash64("root", "part"), F.lit(buckets)).cast("int")).groupBy("bucket").applyInArrow(tidy_group(_verify(similarity)), "a long, b long")


def _grouped(documents: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, fingerprint, component_id and root of each row with a doc_id; root is null for texts without words."""
    spark = documents.sparkSession
    named = documents.where("doc_id IS NOT NULL")
    prints = materialise(long_fingerprints(named, shingle), "long-fingerprints")
    words = F.col("fingerprint") != F.lit(NOTHING)
    distinct = materialise(prints.where(words).groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.max("shingles").alias("shingles")).withColumn("node", F.monotonically_increasing_id()), "distinct-long")
    loose = components(links(distinct, similarity))
    release(spark)
    roots = components(verified(named, distinct, loose, shingle, similarity))
    release(spark)
    rooted = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = rooted.join(least, "root").select("fingerprint", "root", "component_id")
    return prints.join(answer, "fingerprint", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def near_groups(documents: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id (the least doc_id that links reach) of each row with a doc_id."""
    return _grouped(documents, shingle, similarity).select("doc_id", "component_id")


def one_of_each(documents: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """documents without near copies: of each group the row with the least doc_id stays (of several such, those of the least
    fingerprint, once); rows without doc_id and rows without words stay.

    Rows are dropped by their ids, which are sent, not the texts. Only where one id has rows that stay and rows that go are
    the texts of these ids looked at again."""
    rows = materialise(_grouped(documents, shingle, similarity), "groups")
    first = rows.where("root IS NOT NULL AND doc_id = component_id").groupBy("root").agg(F.min("fingerprint").alias("kept_print"))
    marked = rows.join(first, "root", "left").withColumn("stays", F.col("root").isNull() | ((F.col("doc_id") == F.col("component_id")) & (F.col("fingerprint") == F.col("kept_print"))))
    by_id = materialise(marked.groupBy("doc_id").agg(F.max("stays").alias("some"), F.count("*").alias("n")).where("NOT some OR n > 1"), "ids")
    stay = without(documents, by_id.select("doc_id"))
    odd = by_id.where("some").select("doc_id")
    if odd.isEmpty():
        return stay
    # ids with several rows: told apart by fingerprint, which is added as a column that no input can have
    tag = "__fingerprint_" + "_".join(documents.columns)
    again = documents.join(few(odd), "doc_id", "left_semi").select(documents.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in _fingerprint(texts, shingle)[0]], pa.binary())], [*batch.schema.names, tag])

    schema = again.withColumn(tag, F.lit(NOTHING)).schema
    tagged = small_batches(again).mapInArrow(tidy(run), schema)
    right = marked.where("stays AND root IS NOT NULL").select(F.col("doc_id").alias("__id"), F.col("fingerprint").alias(tag)).distinct()
    good = tagged.join(right, (F.col("doc_id") == F.col("__id")) & (tagged[tag] == right[tag]), "left_semi").dropDuplicates(["doc_id", tag])
    wordless = tagged.where(F.col(tag) == F.lit(NOTHING))
    return stay.unionByName(good.unionByName(wordless).select(documents.columns))
