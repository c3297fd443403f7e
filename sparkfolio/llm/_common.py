"""Shared pieces of the corpus operators: checkpoints, Arrow batches and vectorised text hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

from sparkfolio.shipping import ship

U64 = np.uint64
#: Odd multipliers of the mixing functions (fixed values).
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
#: Bytes that separate words: space and \t to \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_GAP = SPACE.tobytes()
#: Raw bytes of text handled at once by the vectorised code; a longer text is handled alone.
SLICE_BYTES = 600_000


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Without one a cluster's job stops: others would not see a folder of this
    machine. Only a local session (tests) may write to its own warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = held.get() if held.isDefined() else spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


#: What materialise writes goes to a folder of this process, below the shared one.
_RUN = f"sparkfolio-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Deletes all that this process has materialised. For the end of a job, when its results are written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark)}/{_RUN}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df under the shared folder and reads it again: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    ship(spark)
    path = f"{checkpoint_root(spark)}/{_RUN}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Ids that are broadcast at most (16 MB); beyond that both sides are shuffled.
BROADCAST_IDS = 1_000_000


def few(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """ids, marked for broadcast where they are counted to be `most` rows or fewer; beyond that a join shuffles both sides."""
    return broadcast(ids) if ids.count() <= most else ids


def without(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """documents but those whose doc_id is in ids (materialised, one long column doc_id); rows without doc_id stay. The ids
    are counted, and texts are only shuffled where they are too many to send."""
    ids = ids.where("doc_id IS NOT NULL").distinct()
    return documents.join(few(ids), "doc_id", "left_anti").select(documents.columns)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files that no live DataFrame needs. What the first collection finds unused is
    queued, so a second one follows after a moment."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def small_batches(df: DataFrame, rows: int = 1000, size: int = 8 << 20) -> DataFrame:
    """Bounds the Arrow batches of the session, by rows and (where Spark can) by bytes, so that long texts don't fill a
    worker; a lower setting stays. Returns df."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = conf.get(key, None)
        if now is not None and not 0 < int(str(now).rstrip("b")) <= most:
            conf.set(key, str(most))
    return df


def trim() -> None:
    """Gives a worker's free memory back to the system: a worker that waits for its next task must not hold it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """run over Arrow batches, then trim."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def tidy_group(run: Callable) -> Callable:
    """run over one group, then trim."""

    def tidied(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            trim()

    return tidied


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df; 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def buckets_for(df: DataFrame, bytes_each: int = 8 << 20, least: int = 32) -> int:
    """How many hash buckets keep each one of bounded size; grows with the input."""
    return int(min(max(least, -(-input_bytes(df) // bytes_each)), 10_000_000))


def mix(x: np.ndarray, k: int = 1) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> U64(31))
    x = x * U64(MULTIPLIERS[k])
    x ^= x >> U64(29)
    return x


def join_names(left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    """The global name of each pair (left, right) at level k: a 64-bit hash, equal wherever the pair is equal."""
    out = left >> U64(29)
    out ^= left
    out *= U64(MULTIPLIERS[k % 6])
    out += right
    return out


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches (columns include doc_id and text) with about `limit` bytes of text each; null texts are empty."""
    for batch in batches:
        texts = binary_column(batch, "text")
        at = size = 0
        for i, t in enumerate(texts):
            n = len(t or b"")
            if size + n > limit and i > at:
                yield batch.slice(at, i - at), [x or b"" for x in texts[at:i]]
                at, size = i, 0
            size += n
        if at < len(texts):
            yield batch.slice(at), [x or b"" for x in texts[at:]]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with a line feed between, as bytes, and where each begins (one more entry at the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    return data, np.concatenate(([0], np.cumsum(lengths)))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after it; data ends with a separator."""
    gap = np.frombuffer(data.tobytes().translate(_GAP), dtype=bool)
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, SLICE_BYTES * 2)
        base = 0x5851F42D4C957F2D
        for key, b in (("p", base), ("i", pow(base, -1, 1 << 64))):
            _powers[key] = np.multiply.accumulate(np.full(size, b, dtype=U64))
    return _powers["p"], _powers["i"]


def fold(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the values of each span, by differences of prefix sums."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    power, inverse = _power_tables(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    raw = (total[ends] - total[starts]) * inverse[starts]
    return mix(mix(raw, 1) + (ends - starts).astype(U64), 2)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    return fold(data.astype(U64) + U64(1), starts, ends)


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values that are consecutive parts of data; offsets in items, one more than values."""
    width = data.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
