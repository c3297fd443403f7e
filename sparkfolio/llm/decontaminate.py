"""Benchmark decontamination by latent semantic retrieval.

Words (runs of letters and digits, lower-cased) that the benchmark uses are the terms. Passages of PASSAGE words are TF-IDF
vectors over the terms, with document frequencies counted over all documents; words in more than `max_df` of the documents
count only in items that have them among their `rare` rarest.

The latent space is a randomised SVD of all passages that follow each other from each text's first word to its last (the
rows of A): tasks add up the sketch Z = A'(A G) for a seeded Gaussian G, in whole numbers, so the sum doesn't depend on the
order or on how documents are dealt. As A'A is symmetric, one pass suffices: with the Cholesky factor C of G'Z, the QR
decomposition of Z / C and the SVD of its small triangle give right singular vectors and singular values (Nystrom).
Directions without a singular value are dropped. A passage or item is the IDF-weighted sum of its terms' latent vectors,
each of unit length, so that rare terms, which stretch along no strong direction, count as much as their IDF says.

Items are searched in pieces of about PASSAGE words. Passages every STRIDE words whose cosine with a piece reaches `cosine`
are candidates. A candidate is confirmed on the words themselves: the longest common subsequence of the item and the
passage's surroundings must reach `common` of the item, and the same share `answer` of its last words (its answer) must
appear in it.

Documents are only scanned: once for frequencies, once for the sketch, and once for each BLOCK bytes of benchmark text.
What is shuffled is sums. Broadcast are the terms' names (8 bytes each), TERMS x rank numbers (terms beyond TERMS share
places by their hash, which blurs the search, not the confirmation) and a block's items. Documents of any length are
handled whole, in slices of bounded size.

Defined results: null or empty text matches nothing; null items and items without words are left out; an item under
SHORT words must appear word for word; repeated rows are reported once each; documents without id are never reported;
other columns are ignored; without documents or items there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, joined, materialise, slices, small_batches, span_hashes, tidy, tidy_group, without

PASSAGE, STRIDE, SHORT, ANSWER = 32, 16, 8, 8
#: Terms with places of their own, at most.
TERMS = 1 << 18
#: Bytes of benchmark text that one scan of the documents searches for.
BLOCK = 16 << 20
#: Sketches are added as multiples of 1 / FIXED.
FIXED = 1 << 24
#: Terms whose sums go as one row.
PART = 256
#: Scores that are held at once.
SCORES = 4_000_000

_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_PART = bytes(48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122 or i >= 128 for i in range(256))


def word_names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Names of all words, and the first word of each text (one more entry at the end)."""
    data, offsets = joined(texts)
    raw = data.tobytes()
    low = np.frombuffer(raw.translate(_LOWER), dtype=np.uint8)
    part = np.frombuffer(raw.translate(_PART), dtype=bool)
    edge = np.flatnonzero(part[1:] != part[:-1]) + 1
    if part[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    return span_hashes(low, starts, ends), np.searchsorted(starts, offsets)


@dataclass
class Terms:
    """The benchmark's words, and the place of each in the term space."""

    names: np.ndarray
    size: int

    def __post_init__(self):
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[self.names >> U64(44)] = True

    def places(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words that are terms stand, and the places of these terms."""
        at = np.flatnonzero(self.bits[names >> U64(44)])
        some = names[at]
        row = np.minimum(np.searchsorted(self.names, some), len(self.names) - 1)
        hit = self.names[row] == some
        at, row = at[hit], row[hit]
        return at, row if self.size == len(self.names) else (self.names[row] % U64(self.size)).astype(np.int64)


def terms_of(items: DataFrame) -> Terms:
    """items: text. All their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(word_names(texts)[0]).view(np.int64))], ["name"])

    found = small_batches(items).mapInArrow(tidy(run), "name long").distinct().toArrow()  # 8 bytes for each word of the benchmark
    names = np.sort(found.column("name").to_numpy().astype(np.int64).view(U64))
    return Terms(names, min(len(names), TERMS))


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for x in b:
        m = row & masks.get(x, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def _passages(begin: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end and text of each passage."""
    count = np.diff(begin)
    each = np.where(count > 0, np.maximum(1, -(-(count - PASSAGE) // stride) + 1), 0)
    text = np.repeat(np.arange(len(count)), each)
    first = begin[text] + stride * (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each))
    return first, np.minimum(first + PASSAGE, begin[text + 1]), text


def _sums(at: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sum of the rows whose places lie in each [first, last). Each is added up by itself, so it doesn't depend on what
    else is in the slice."""
    edges = np.stack((np.searchsorted(at, first), np.searchsorted(at, last)), axis=1)
    out = np.add.reduceat(np.concatenate((rows, np.zeros((1, rows.shape[1]), rows.dtype))), edges.ravel(), axis=0)[::2]
    out[edges[:, 0] == edges[:, 1]] = 0
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    return rows / np.where(n > 0, n, 1)


def document_frequencies(docs: DataFrame, terms: Terms) -> tuple[np.ndarray, int]:
    """Documents with a term of each place, and documents."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        total, rows = np.zeros(t.size + 1, dtype=np.int64), 0
        for _, texts in slices(batches):
            names, begin = word_names(texts)
            at, term = t.places(names)
            owner = np.searchsorted(begin, at, side="right") - 1
            pairs = np.unique(owner * t.size + term)
            total[:-1] += np.bincount(pairs % t.size, minlength=t.size)
            rows += len(texts)
        total[-1] = rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "n"])

    out = np.zeros(terms.size + 1, dtype=np.int64)
    for term, n in small_batches(docs).mapInArrow(tidy(run), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # one row a place
        out[term] = n
    return out[:-1], int(out[-1])


def sketch(docs: DataFrame, terms: Terms, idf: np.ndarray, gauss: np.ndarray) -> np.ndarray:
    """A'(A G), places x columns of G; the rows of A are passages of unit length."""
    held = docs.sparkSession.sparkContext.broadcast((terms, idf, gauss))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, weight, g = held.value
        total = np.zeros(g.shape, dtype=np.int64)
        for _, texts in slices(batches):
            names, begin = word_names(texts)
            at, term = t.places(names)
            keep = weight[term] > 0
            at, term = at[keep], term[keep]
            if not len(at):
                continue
            first, last, _ = _passages(begin, PASSAGE)  # from each text's first word to its last: every word is in one
            key = (np.searchsorted(first, at, side="right") - 1) * t.size + term
            key, times = np.unique(key, return_counts=True)
            owner, term = key // t.size, key % t.size
            value = times * weight[term]
            edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            passage = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, len(owner))))
            value = value / np.sqrt(np.add.reduceat(value * value, edges))[passage]
            y = np.add.reduceat(value[:, None] * g[term], edges, axis=0)
            rows = np.rint(y[passage] * (value * FIXED)[:, None]).astype(np.int64)
            order = np.argsort(term, kind="stable")
            starts = np.flatnonzero(np.append(True, term[order][1:] != term[order][:-1]))
            total[term[order][starts]] += np.add.reduceat(rows[order], starts, axis=0)
        for k in range(0, len(total), PART):
            if total[k : k + PART].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k : k + PART].tobytes()], pa.binary())], ["place", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), dtype=np.int64) for b in table.column("sums"))
        return pa.table({"place": table.column("place")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    sent = small_batches(docs).mapInArrow(tidy(run), "place int, sums binary")
    some = sent.groupBy("place", (F.spark_partition_id() % 16).alias("salt")).applyInArrow(tidy_group(add), "place int, sums binary")
    out = np.zeros(gauss.shape, dtype=np.int64)
    for place, sums in some.groupBy("place").applyInArrow(tidy_group(add), "place int, sums binary").collect():  # places x columns numbers in all
        rows = np.frombuffer(sums, dtype=np.int64).reshape(-1, gauss.shape[1])
        out[place : place + len(rows)] = rows
    return out / FIXED


def singular(z: np.ndarray, gauss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors of A (columns) and its singular values, from Z = A'(A G); those that are nothing are left out."""
    shift = 1e-9 * max(float(np.linalg.norm(z)), 1e-300)
    moved = z + shift * gauss
    core = gauss.T @ moved
    root = np.linalg.cholesky((core + core.T) / 2)
    q, r = np.linalg.qr(np.linalg.solve(root, moved.T).T)
    u, s, _ = np.linalg.svd(r)
    values = np.sqrt(np.maximum(s * s - shift, 0))
    some = values > 1e-3 * max(values[0], 1e-300)
    return (q @ u)[:, some], values[some]


def latent_space(docs: DataFrame, terms: Terms, idf: np.ndarray, rank: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Latent vector of each place, of unit length times its IDF, and the singular values."""
    held = idf > 0
    gauss = np.where(held[:, None], np.random.default_rng(seed).standard_normal((terms.size, min(rank, int(held.sum())))), 0.0)
    if not gauss.shape[1]:
        return np.zeros((terms.size, 1), np.float32), np.zeros(0)
    z = sketch(docs, terms, idf, gauss)
    if not z.any():
        return np.zeros((terms.size, 1), np.float32), np.zeros(0)
    vectors, values = singular(z, gauss)
    return (_unit(vectors) * idf[:, None]).astype(np.float32), values


def confirm(item: np.ndarray, around: np.ndarray, common: float, answer: float) -> tuple[float, float, bool]:
    """Share of the item that is a common subsequence, share of its answer, and whether both suffice."""
    a, b = item.tolist(), around.tolist()
    if len(a) < SHORT:
        same = any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
        return float(same), float(same), same
    share = common_subsequence(a, b) / len(a)
    if share < common:
        return share, 0.0, False
    last = a[-ANSWER:]
    told = common_subsequence(last, b) / len(last)
    return share, told, told >= answer


def anchors_of(term: np.ndarray, df: np.ndarray, common: float) -> list[int]:
    """Places in an item (its words as terms) from which it is searched. For an item under SHORT words its rarest word; for
    others the rarest words that documents hold, so many that a common subsequence of the share `common` has one of them;
    none where too few of its words are held."""
    if len(term) < SHORT:
        return [int(np.argmin(df[term]))]
    words, place, times = np.unique(term, return_index=True, return_counts=True)
    held = df[words] > 0
    spare = int((1 - common) * len(term) + 1e-9) - int(times[~held].sum())  # held words that may still be missing
    if spare < 0:
        return []
    order = np.flatnonzero(held)[np.argsort(df[words[held]], kind="stable")]
    return place[order[: int(np.searchsorted(np.cumsum(times[order]), spare, side="right")) + 1]].tolist()


def pieces(item: np.ndarray) -> list[np.ndarray]:
    """Parts of about PASSAGE words that follow each other; the last ends with the item."""
    if len(item) <= PASSAGE * 3 // 2:
        return [item]
    return [item[k : k + PASSAGE] for k in range(0, len(item) - PASSAGE, PASSAGE)] + [item[-PASSAGE:]]


@dataclass
class Query:
    """What tasks search for: items as word names, their pieces in latent space, and anchors of those without a vector."""

    ids: list[int]
    items: list[np.ndarray]
    pieces: np.ndarray
    owners: np.ndarray
    anchors: dict[int, list[tuple[int, int]]]


def leaks(documents: DataFrame, benchmark: DataFrame, rank: int = 64, cosine: float = 0.45, common: float = 0.65, answer: float = 0.5, max_df: float = 0.02, rare: int = 6) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, cosine (0 where none was needed), common, answer."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    none = spark.createDataFrame([], "doc_id long, item_id long, cosine double, common double, answer double")
    terms = terms_of(wanted.select("text"))
    if not len(terms.names):
        return none
    df, n = document_frequencies(docs, terms)
    if not n:
        return none
    blocks = max(1, -(-(wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK))

    def block(k: int) -> list[tuple[int, np.ndarray]]:
        mine = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        items = [(i, word_names([t.encode()])[0]) for i, t in sorted(tuple(r) for r in mine.collect())]  # about BLOCK bytes
        return [(i, names) for i, names in items if len(names)]

    used = df <= max_df * n
    for k in range(blocks):
        for _, names in block(k):
            term = np.unique(terms.places(names)[1])
            term = term[df[term] > 0]
            used[term[np.argsort(df[term], kind="stable")[:rare]]] = True
    idf = np.where(used & (df > 0), np.log((1 + n) / (1 + df)), 0.0)  # words that no document holds have no direction
    space, _ = latent_space(docs, terms, idf, rank)
    space_held, out = spark.sparkContext.broadcast((terms, idf, space)), None
    for k in range(blocks):
        found = _search(docs, space_held, _query(block(k), terms, df, space, common), cosine, common, answer)
        out = found if out is None else out.unionByName(found)
    return out


def _query(items: list[tuple[int, np.ndarray]], terms: Terms, df: np.ndarray, space: np.ndarray, common: float) -> Query:
    vectors, owners, anchors = [], [], {}
    for i, (_, names) in enumerate(items):
        parts = [space[terms.places(p)[1]].sum(axis=0, dtype=np.float64) for p in pieces(names)]
        shown = [v for v in parts if np.linalg.norm(v) > 1e-6]
        if len(names) >= SHORT and shown:
            vectors += shown
            owners += [i] * len(shown)
        else:  # short items must appear word for word, and items of common terms alone have no vector
            for w in anchors_of(terms.places(names)[1], df, common):
                anchors.setdefault(int(names[w]), []).append((i, w))
    latent = _unit(np.array(vectors)) if vectors else np.zeros((0, space.shape[1]))
    return Query([i for i, _ in items], [x for _, x in items], latent, np.array(owners, dtype=np.int64), anchors)


def _search(docs: DataFrame, space_held, query: Query, cosine: float, common: float, answer: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (t, weight, v), q = space_held.value, held.value
        latent = q.pieces.T.astype(np.float32)
        anchored = np.array(sorted(q.anchors), dtype=U64)
        for batch, texts in slices(batches):
            names, begin = word_names(texts)
            at, term = t.places(names)
            first, last, text = _passages(begin)
            rare = weight[term] > 0
            place, row = at[rare], term[rare]
            best: dict[tuple[int, int], tuple[float, float, float]] = {}

            def consider(p: int, i: int, score: float) -> None:
                key, item = (int(text[p]), i), q.items[i]
                margin = max(PASSAGE, len(item))
                low, high = max(begin[text[p]], first[p] - margin), min(begin[text[p] + 1], last[p] + margin)
                share, told, good = confirm(item, names[low:high], common, answer)
                if good and (share, told, score) > best.get(key, (0, 0, 0)):
                    best[key] = (share, told, score)

            if len(place) and latent.shape[1]:
                some = np.flatnonzero(np.searchsorted(place, last) > np.searchsorted(place, first))
                step = max(1, SCORES // latent.shape[1])
                for k in range(0, len(some), step):
                    block = some[k : k + step]
                    a, b = np.searchsorted(place, (first[block].min(), last[block].max()))
                    rows = _unit(_sums(place[a:b], v[row[a:b]].astype(np.float64), first[block], last[block]))
                    near = np.nonzero(rows.astype(np.float32) @ latent >= cosine - 1e-4)
                    scores = np.einsum("ij,ij->i", rows[near[0]], q.pieces[near[1]]).round(9)  # the product's rounding depends on its shape
                    done: dict[tuple[int, int], float] = {}
                    for p, i, x in zip(block[near[0]].tolist(), q.owners[near[1]].tolist(), scores.tolist()):
                        if x >= cosine:
                            done[p, i] = max(done.get((p, i), x), x)
                    for (p, i), x in done.items():
                        consider(p, i, x)
            tried: set[tuple[int, int]] = set()
            for w in np.flatnonzero(np.isin(names, anchored)).tolist() if len(anchored) else ():
                p = int(np.searchsorted(first, w, side="right") - 1)
                for i, place_in in q.anchors[int(names[w])]:
                    item, low = q.items[i], w - place_in
                    if (p, i) not in tried and (len(item) >= SHORT or low >= 0 and np.array_equal(names[low : low + len(item)], item)):
                        tried.add((p, i))
                        consider(p, i, 0.0)
            if best:
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                keys = sorted(best)
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[d]) for d, _ in keys], pa.int64()), pa.array([q.ids[i] for _, i in keys], pa.int64()), pa.array([best[x][2] for x in keys], pa.float64()), pa.array([best[x][0] for x in keys], pa.float64()), pa.array([best[x][1] for x in keys], pa.float64())], ["doc_id", "item_id", "cosine", "common", "answer"])

    return small_batches(docs).mapInArrow(tidy(run), "doc_id long, item_id long, cosine double, common double, answer double")


def decontaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item."""
    return without(documents, materialise(leaks(documents, benchmark, **options).select("doc_id"), "leaks"))
