"""Removal of every unit (word or byte) that lies in a window which a document with a smaller id also holds.

The caller gives `units`: for a slice of texts a 64-bit name for each window and, for each window, the name of one
sample inside it that depends on the window's content alone (so equal windows have equal samples).

1. Consecutive windows with one sample make a segment; (sample, segment content) is sent to the sample's hash bucket.
   A segment that a smaller document has whole is settled there. A sample with only one content needs nothing more.
2. Only where one sample has several contents are single windows compared, and each content's first document sends them.
   A reader that has bytes (op10) sends the segment's bytes to its sample's bucket, where suffixes are sorted and compared
   (`sort` of the reader). A sample with very many contents (HOT: over CLASSES in a batch or MANY in its bucket) would make
   that bucket large, so its windows go one by one, dealt by their own names; so do all where more than HOT_MOST samples
   are like that, which are then too many to tell every task.
3. The settled segments and windows are gathered by document, joined to the texts and removed.

Every batch is reduced before the shuffle: equal contents go as one row, a sample sends at most CLASSES contents (the
others go straight to step 2), so a key in a third of all documents costs a few rows for each batch. Buckets grow in
number with the input, not in size. Nothing is collected to the driver.

A text over LONG bytes is handled in chunks that overlap by a window less one unit, so memory doesn't grow with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, binary_array, buckets_for, materialise, mix, release, slices, small_batches, tidy, tidy_group

#: Contents of one sample that a batch sends to the sample's bucket.
CLASSES = 16
#: Segments or windows held before a batch is reduced and sent.
HELD = 300_000
#: Bytes of segments held before they are sent.
PARCEL = 2 << 20
#: Bytes of segments whose suffixes are sorted at once, but for a sample that has more.
SORTED = 400_000
#: Longest text, in bytes, that is handled at once; longer ones in chunks of CHUNK bytes.
LONG, CHUNK = 2_000_000, 600_000
#: Windows of one segment at most.
RUN = 32
SETTLED, OPEN, WINDOW, MASK, HOT, ENTRY, RAW = 0, 1, 2, 3, 4, 9, 10
#: Contents of one sample that are compared in one task.
MANY = 4000
#: Samples with very many contents that are broadcast at most (8 bytes each).
HOT_MOST = 1_000_000
REPLY = "doc_id long, kind int, payload binary"
ROUTED = "bucket int, doc_id long, kind int, payload binary"


@dataclass
class Units:
    """What a slice of documents holds. count: units of each document; begin: the first unit of each; names: of the
    window that begins at each unit; samples: of the window that begins at each unit."""

    begin: np.ndarray
    count: np.ndarray
    names: np.ndarray
    samples: np.ndarray
    data: np.ndarray | None = None  # the bytes, where units are bytes


def sliding_min(values: np.ndarray, length: int) -> np.ndarray:
    """Least of each `length` consecutive values."""
    size, out = 1, values
    while size * 2 <= length:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return out if size == length else np.minimum(out[: len(values) - length + 1], out[length - size :][: len(values) - length + 1])


@dataclass
class Segments:
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    sample: np.ndarray
    content: np.ndarray


def segments(u: Units, window: int) -> Segments:
    """Maximal runs of windows with one sample, at most RUN long."""
    some = np.flatnonzero(u.count >= window)
    per = u.count[some] - window + 1
    total = int(per.sum())
    if not total:
        z = np.zeros(0, dtype=np.int64)
        return Segments(z, z, z, z.astype(U64), z.astype(U64))
    doc = np.repeat(some, per)
    opens = np.cumsum(per) - per
    at = np.arange(total) + np.repeat(u.begin[some] - opens, per)
    sample = u.samples[at]
    new = np.ones(total, dtype=bool)
    np.not_equal(sample[1:], sample[:-1], out=new[1:])
    new[opens] = True
    runs = np.flatnonzero(new)
    lengths = np.diff(np.append(runs, total))
    if lengths.max() > RUN:
        new |= (np.arange(total) - np.repeat(runs, lengths)) % RUN == 0
        runs = np.flatnonzero(new)
        lengths = np.diff(np.append(runs, total))
    first = at[runs]
    last = first + lengths - 1
    content = mix(mix(u.names[first], 3) + u.names[last], 4) + lengths.astype(U64)
    return Segments(doc[runs], first, last, sample[runs], content)


def _replies(doc: np.ndarray, value: np.ndarray, kind: int, buckets: int | None) -> Iterator[pa.RecordBatch]:
    """One row for each document: its values."""
    if not len(doc):
        return
    order = np.argsort(doc, kind="stable")
    doc, value = doc[order], value[order]
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    ids = doc[starts]
    columns = [pa.array(ids), pa.array(np.full(len(ids), kind, dtype=np.int32)), binary_array(value, np.append(starts, len(doc)))]
    names = ["doc_id", "kind", "payload"]
    if buckets:
        columns.insert(0, pa.array((mix(ids.astype(U64)) % U64(buckets)).astype(np.int32)))
        names.insert(0, "bucket")
    yield pa.RecordBatch.from_arrays(columns, names)


def _pack(key: np.ndarray, content: np.ndarray, doc: np.ndarray) -> bytes:
    table, index = np.unique(doc, return_inverse=True)
    index = index.astype(np.uint16 if len(table) <= 65536 else np.uint32)
    return b"".join((np.array([len(key), len(table)], dtype=np.int64).tobytes(), key.tobytes(), content.tobytes(), index.tobytes(), table.tobytes()))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, t = np.frombuffer(blob, dtype=np.int64, count=2)
    kind = np.dtype(np.uint16 if t <= 65536 else np.uint32)
    at = 16
    key = np.frombuffer(blob, dtype=np.uint32, count=n, offset=at)
    content = np.frombuffer(blob, dtype=U64, count=n, offset=(at := at + 4 * n))
    index = np.frombuffer(blob, dtype=kind, count=n, offset=(at := at + 8 * n))
    table = np.frombuffer(blob, dtype=np.int64, count=t, offset=at + kind.itemsize * n)
    return key, content, table[index]


def _entries(sample: np.ndarray, content: np.ndarray, doc: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, packed entries)."""
    if not len(sample):
        return
    bucket, key = _places(sample, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, key, content, doc = bucket[order], key[order], content[order], doc[order]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = np.append(starts[1:], len(bucket))
    blobs = [_pack(key[a:b], content[a:b], doc[a:b]) for a, b in zip(starts, ends)]
    n = len(starts)
    yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(np.zeros(n, dtype=np.int64)), pa.array(np.full(n, ENTRY, dtype=np.int32)), pa.array(blobs, type=pa.binary())], ["bucket", "doc_id", "kind", "payload"])


def _places(sample: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each sample, and its name there."""
    name = mix(sample, 5)
    return ((name >> U64(32)) % U64(buckets)).astype(np.int32), name.astype(np.uint32)


def _hot(sample: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    if len(sample):
        bucket, key = _places(sample, buckets)
        names = (bucket.astype(U64) << U64(32)) | key
        yield pa.RecordBatch.from_arrays([pa.array(bucket[:1]), pa.array([0], pa.int64()), pa.array([HOT], pa.int32()), pa.array([names.tobytes()], pa.binary())], ["bucket", "doc_id", "kind", "payload"])


def _reduced(sample: np.ndarray, content: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted by sample, content and document; which rows are the first of their (sample, content), and which rows a
    smaller document settles."""
    order = np.lexsort((doc, content, sample))
    sample, content, doc = sample[order], content[order], doc[order]
    fresh = np.append(True, (sample[1:] != sample[:-1]) | (content[1:] != content[:-1]))
    least = doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    return sample, content, doc, fresh, doc > least


def _runs(values: np.ndarray) -> np.ndarray:
    """The place of each value in its run of equal values."""
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))


def _flush(held: list[tuple[np.ndarray, ...]], buckets: int, done: int) -> Iterator[pa.RecordBatch]:
    sample, content, doc, fresh, settled = _reduced(*(np.concatenate(x) for x in zip(*held)))
    held.clear()
    yield from _replies(doc[settled], content[settled], done, buckets)
    sample, content, doc = sample[fresh], content[fresh], doc[fresh]
    if done == SETTLED:
        beyond = _runs(sample) >= CLASSES
        yield from _replies(doc[beyond], content[beyond], OPEN, buckets)
        yield from _hot(np.unique(sample[beyond]), buckets)
        sample, content, doc = sample[~beyond], content[~beyond], doc[~beyond]
    yield from _entries(sample, content, doc, buckets)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").to_numpy(zero_copy_only=False)


@dataclass
class Reader:
    """How texts become units. cut: begin and end (bytes) and first unit of each chunk of about so many bytes, where each
    chunk also holds the window - 1 units that follow."""

    units: Callable[[list[bytes]], Units]
    cut: Callable[[bytes, int], list[tuple[int, int, int]]]
    window: int
    sort: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None  # bytes and places of windows to their order's classes

    def chunks(self, texts: list[bytes], some: list[int]) -> Iterator[tuple[Units, Segments, np.ndarray, int]]:
        """Units and segments of the texts in `some`; which text each is of; the first unit of what is a chunk."""
        short = [i for i in some if len(texts[i]) <= LONG]
        if short:
            u = self.units([texts[i] for i in short])
            yield u, segments(u, self.window), np.array(short), 0
        for i in some:
            if len(texts[i]) > LONG:
                for begin, end, first in self.cut(texts[i], CHUNK):
                    u = self.units([texts[i][begin:end]])
                    yield u, segments(u, self.window), np.array([i]), first


def _send_segments(reader: Reader, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch, texts in slices(batches):
            for _, s, owner, _ in reader.chunks(texts, list(range(len(texts)))):
                if len(s.doc):
                    held.append((s.sample, s.content, _ids(batch)[owner[s.doc]]))
                    count += len(s.doc)
                if count >= HELD:
                    yield from _flush(held, buckets, SETTLED)
                    count = 0
        if held:
            yield from _flush(held, buckets, SETTLED)

    return run


def _settle(done: int, reader: Reader):
    """One bucket: what is settled, and (for segments) what is still open."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        out = [table.filter(pa.array((kinds != ENTRY) & (kinds != RAW))).select(["doc_id", "kind", "payload"])]
        raw = table.filter(pa.array(kinds == RAW)).column("payload").to_pylist()
        out += [pa.Table.from_batches([x]) for x in (_compared(raw, reader) if raw else ())]
        blobs = table.filter(pa.array(kinds == ENTRY)).column("payload").to_pylist()
        if blobs:
            sample, content, doc, fresh, settled = _reduced(*(np.concatenate(x) for x in zip(*map(_unpack, blobs))))
            parts = list(_replies(doc[settled], content[settled], done, None))
            if done == SETTLED:
                key, value, first = sample[fresh], content[fresh], doc[fresh]
                starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                each = np.diff(np.append(starts, len(key)))
                several = np.repeat(each > 1, each)
                parts += _replies(first[several], value[several], OPEN, None)
                if (each > MANY).any():
                    hot = (U64(table.column("bucket")[0].as_py()) << U64(32)) | key[starts[each > MANY]].astype(U64)
                    parts.append(pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([HOT], pa.int32()), pa.array([hot.tobytes()], pa.binary())], ["doc_id", "kind", "payload"]))
            out += [pa.Table.from_batches([x]) for x in parts]
        return pa.concat_tables([x.cast(out[0].schema) for x in out])

    return run


def _told(value: list[dict] | None, kind: int) -> np.ndarray:
    return np.frombuffer(b"".join(x["payload"] for x in value or () if x["kind"] == kind), dtype=U64)


def _told_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list, list[int]]]:
    """Each slice with what its documents are told, and which ones are told something."""
    for batch, texts in slices(batches):
        told = batch.column("told").to_pylist()
        yield batch, texts, told, [i for i, x in enumerate(told) if x]


def window_ids(names: np.ndarray, samples: np.ndarray) -> np.ndarray:
    return mix(mix(names, 3) + samples, 1)


def _ranges(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of consecutive ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - lengths), lengths)


def _raw(u: Units, s: Segments, at: np.ndarray, doc: int, window: int, buckets: int) -> tuple[np.ndarray, ...]:
    """The segments `at` of one document, each content once: bucket, key, content, windows, document, and their bytes."""
    at = at[np.unique(s.content[at], return_index=True)[1]]
    windows = s.last[at] - s.first[at] + 1
    return *_places(s.sample[at], buckets), s.content[at], windows.astype(np.uint8), np.full(len(at), doc), u.data[_ranges(s.first[at], windows + window - 1)]


def _parcels(held: list[tuple[np.ndarray, ...]], window: int) -> Iterator[pa.RecordBatch]:
    """One row for each bucket with the segments that go there."""
    if not held:
        return
    bucket, key, content, windows, doc, data = (np.concatenate(x) for x in zip(*held))
    held.clear()
    order = np.argsort(bucket, kind="stable")
    lengths = windows.astype(np.int64) + window - 1
    data = data[_ranges((np.cumsum(lengths) - lengths)[order], lengths[order])]
    bucket, key, content, windows, doc = (x[order] for x in (bucket, key, content, windows, doc))
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    places = np.append(0, np.cumsum(lengths[order]))[edges]
    blobs = [b"".join((np.array([b - a], dtype=np.int64).tobytes(), doc[a:b].tobytes(), content[a:b].tobytes(), key[a:b].tobytes(), windows[a:b].tobytes(), data[p:q].tobytes())) for a, b, p, q in zip(edges, edges[1:], places, places[1:])]
    n = len(blobs)
    yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array([0] * n, pa.int64()), pa.array([RAW] * n, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "doc_id", "kind", "payload"])


def _compared(blobs: list[bytes], reader: Reader) -> Iterator[pa.RecordBatch]:
    """Sorts the suffixes of a bucket, the segments of some samples at a time, and tells each document which of its windows
    a smaller one has."""
    parts: list[tuple[np.ndarray, ...]] = []
    for blob in blobs:
        n = int(np.frombuffer(blob, dtype=np.int64, count=1)[0])
        kinds = ((np.int64, 8), (U64, 8), (np.uint32, 4), (np.uint8, 1))
        at = 8
        row = []
        for kind, size in kinds:
            row.append(np.frombuffer(blob, dtype=kind, count=n, offset=at))
            at += size * n
        parts.append((*row, np.frombuffer(blob, dtype=np.uint8, offset=at)))
    doc, content, key, windows, data = (np.concatenate(x) for x in zip(*parts))
    del parts
    lengths = windows.astype(np.int64) + reader.window - 1
    begin = np.cumsum(lengths) - lengths
    order = np.argsort(key, kind="stable")
    fresh = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    cut = np.cumsum(lengths[order])[fresh] // SORTED  # samples are never cut
    edges = np.append(fresh[np.flatnonzero(np.append(True, cut[1:] != cut[:-1]))], len(order))
    for a, b in zip(edges, edges[1:]):
        some = order[a:b]
        if b - a > 1:
            yield from _sorted(doc[some], content[some], windows[some].astype(np.int64), data[_ranges(begin[some], lengths[some])], reader)


def _sorted(doc: np.ndarray, content: np.ndarray, windows: np.ndarray, data: np.ndarray, reader: Reader) -> Iterator[pa.RecordBatch]:
    lengths = windows + reader.window - 1
    entry = np.repeat(np.arange(len(doc)), windows)
    place = _ranges(np.zeros(len(doc), dtype=np.int64), windows)
    pointer = reader.sort(data, (np.cumsum(lengths) - lengths)[entry] + place)
    owner = doc[entry]
    order = np.lexsort((owner, pointer))
    fresh = np.append(True, pointer[order][1:] != pointer[order][:-1])
    gone = order[owner[order] > owner[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]]  # of neighbours with one pointer the first stays
    mask = np.zeros(len(doc), dtype=U64)
    np.add.at(mask, entry[gone], U64(1) << place[gone].astype(U64))  # each window is there once
    some = np.flatnonzero(mask)
    yield from _replies(np.repeat(doc[some], 2), np.stack((content[some], mask[some]), axis=1).ravel(), MASK, None)


def _send_windows(reader: Reader, buckets: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = size = 0
        known = hot.value if hot is not None else None
        raw: list[tuple[np.ndarray, ...]] = []
        for batch, texts, told, some in _told_texts(batches):
            ids = _ids(batch)
            for u, s, owner, _ in reader.chunks(texts, some):
                edges = np.searchsorted(s.doc, np.arange(len(owner) + 1))
                for k, i in enumerate(owner.tolist()):
                    a, b = edges[k], edges[k + 1]
                    at = np.flatnonzero(np.isin(s.content[a:b], _told(told[i], OPEN))) + a
                    if known is not None and len(at):
                        bucket, key = _places(s.sample[at], buckets)
                        cold = ~np.isin((bucket.astype(U64) << U64(32)) | key, known)
                        if cold.any():
                            raw.append(_raw(u, s, at[cold], int(ids[i]), reader.window, buckets))
                            size += len(raw[-1][-1])
                        at = at[~cold]
                    if len(at):
                        spread = s.last[at] - s.first[at] + 1
                        places = np.arange(spread.sum()) + np.repeat(s.first[at] - (np.cumsum(spread) - spread), spread)
                        names = u.names[places]
                        # dealt by their own names: a common sample's windows spread over all buckets
                        held.append((names, window_ids(names, np.repeat(s.sample[at], spread)), np.full(len(names), ids[i])))
                        count += len(names)
                if count >= HELD:
                    yield from _flush(held, buckets, WINDOW)
                    count = 0
                if size >= PARCEL:
                    yield from _parcels(raw, reader.window)
                    size = 0
        if held:
            yield from _flush(held, buckets, WINDOW)
        yield from _parcels(raw, reader.window)

    return run


def cover(batches: Iterator[pa.RecordBatch], reader: Reader) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[np.ndarray | None]]]:
    """For each slice: the batch, its texts, and for each document which units go (None: none)."""
    window = reader.window
    for batch, texts, told, some in _told_texts(batches):
        masks: list[np.ndarray | None] = [None] * len(texts)
        for u, s, owner, offset in reader.chunks(texts, some):
            edges = np.searchsorted(s.doc, np.arange(len(owner) + 1))
            for k, i in enumerate(owner.tolist()):
                a, b = edges[k], edges[k + 1]
                n, begin = int(u.count[k]), int(u.begin[k])
                change = np.zeros(n + 1, dtype=np.int64)
                if b > a:
                    at = np.flatnonzero(np.isin(s.content[a:b], _told(told[i], SETTLED))) + a
                    np.add.at(change, s.first[at] - begin, 1)
                    np.add.at(change, s.last[at] - begin + window, -1)
                    masked = _told(told[i], MASK).reshape(-1, 2)
                    if len(masked):
                        names, which = np.unique(masked[:, 0], return_inverse=True)
                        bits = np.zeros(len(names), dtype=U64)
                        np.bitwise_or.at(bits, which, masked[:, 1])
                        row = np.minimum(np.searchsorted(names, s.content[a:b]), len(names) - 1)
                        at = np.flatnonzero(names[row] == s.content[a:b])
                        step = np.arange(RUN)
                        set_ = ((bits[row[at]][:, None] >> step.astype(U64)) & U64(1)).astype(bool)
                        places = (s.first[a + at][:, None] - begin + step)[set_]
                        np.add.at(change, places, 1)
                        np.add.at(change, places + window, -1)
                    single = _told(told[i], WINDOW)
                    if len(single):
                        whole = slice(begin, begin + n - window + 1)
                        places = np.flatnonzero(np.isin(window_ids(u.names[whole], u.samples[whole]), single))
                        change[places] += 1
                        np.add.at(change, places + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                before = masks[i]
                if before is None:
                    masks[i] = gone
                else:  # a later chunk: its first units were the end of the chunk before
                    both = len(before) - offset
                    before[offset:] |= gone[:both]
                    masks[i] = np.concatenate((before, gone[both:]))
        yield batch, texts, masks


def _hot_samples(first: DataFrame):
    """The samples with very many contents, for all tasks; None where they are too many."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.frombuffer(b"".join(batch.column("payload").to_pylist()), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(names))], ["name"])

    found = first.where(F.col("kind") == HOT).select("payload").mapInArrow(run, "name long").distinct()
    if found.count() > HOT_MOST:
        return None
    names = found.toArrow().column("name").to_numpy().astype(np.int64)
    return first.sparkSession.sparkContext.broadcast(np.sort(names.view(U64)))


def remove_repeats(docs: DataFrame, reader: Reader, finish: Callable, schema: str, name: str) -> DataFrame:
    """docs: doc_id long, text string. finish: an Arrow map over (doc_id, text, told) that uses cover(). Rows without id or
    text go straight to it."""
    spark = docs.sparkSession
    buckets = buckets_for(docs)
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    first = materialise(small_batches(known).mapInArrow(tidy(_send_segments(reader, buckets)), ROUTED).groupBy("bucket").applyInArrow(tidy_group(_settle(SETTLED, reader)), REPLY), f"{name}-segments")
    release(spark)

    def gathered(replies: DataFrame) -> DataFrame:
        return replies.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "payload")).alias("told"))

    hot = _hot_samples(first) if reader.sort else None
    opened = known.join(gathered(first.where(F.col("kind") == OPEN)), "doc_id")
    second = materialise(opened.mapInArrow(tidy(_send_windows(reader, buckets, hot)), ROUTED).groupBy("bucket").applyInArrow(tidy_group(_settle(WINDOW, reader)), REPLY), f"{name}-windows")
    release(spark)
    told = gathered(first.where(F.col("kind") == SETTLED).unionByName(second))
    whole = known.join(told, "doc_id", "left").mapInArrow(tidy(finish), schema)
    rest = docs.where("doc_id IS NULL OR text IS NULL").withColumn("told", F.lit(None).cast("array<struct<kind:int,payload:binary>>"))
    return whole.unionByName(rest.mapInArrow(tidy(finish), schema))
