"""Shared pieces of the training-data operators: shared-folder tables and byte-level text kernels.

Words are maximal runs of bytes other than space and 0x09-0x0D.  Hashes are 64-bit and fixed: they
depend on nothing but the bytes, so any two executors agree.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tissueloom.shipping import ship

WORD_PATTERN = r"[^\x20\x09-\x0D]+"

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where unset, a temporary one is set in local mode, and anything else raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tissueloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and reread it: cuts lineage, survives lost executors.

    The shuffle files of the write go with it: nothing reads them again, and left to the driver's garbage
    collection, those of all steps would lie on disk together.
    """
    path = f"{shared_dir(df.sparkSession)}/tissueloom/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` whose every reader has itself been written."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(conf).delete(path, True)


#: Session setting, its default, and what the operators set in place of that: a Python worker gets a few MB at a time.
SMALL_BATCHES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b")
IDLE_SECONDS = 3.0
#: Tables that workers keep from task to task; emptied when a worker has been idle for a while.
kept_by_worker: list[dict] = []
_timer: list = []


def _forget() -> None:
    for cache in kept_by_worker:
        cache.clear()
    release()


def begin_task() -> None:
    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())
    while _timer:
        _timer.pop().cancel()


def end_task() -> None:
    """Memory goes back at a task's end, and kept tables once no task has followed for a while."""
    import threading

    release()
    if any(kept_by_worker):
        _timer.append(threading.Timer(IDLE_SECONDS, _forget))
        _timer[-1].daemon = True
        _timer[-1].start()


def working(function):
    """Wraps a task's iterator with :func:`begin_task` and :func:`end_task`, by name: a closure's copy would not see the worker's own tables."""

    def run(batches):
        begin_task()
        try:
            yield from function(batches)
        finally:
            end_task()

    return run


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with this package at hand on the executors, in batches of a few MB."""
    spark = df.sparkSession
    ship(spark)
    key, usual, small = SMALL_BATCHES
    if spark.conf.get(key, usual) == usual:
        spark.conf.set(key, small)
    return df.mapInArrow(working(function), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def splitmix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective mixer of uint64 values."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
LONG_SPAN = 64


def span_hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[begin:end] for arrays of spans, independent of where the span lies.

    Spans are read in words of 8 bytes, each mixed in by a bijection, so spans of up to 8 bytes never collide
    with others of their size, and no text, however regular, makes longer ones collide more often than
    random values would.  Spans over ``LONG_SPAN`` bytes are hashed by XXH3.
    """
    import xxhash

    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    begin, size = np.asarray(begin, np.int64), np.asarray(end, np.int64) - begin

    def word(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(eight[at]).view("<u8")[:, 0] & _KEEP[np.minimum(left, 8)]

    out = splitmix(word(begin, size) ^ splitmix(size.astype(U64)))
    live, done = np.flatnonzero((size > 8) & (size <= LONG_SPAN)), 8
    while len(live):
        out[live] = splitmix(splitmix(out[live]) ^ word(begin[live] + done, size[live] - done))
        done += 8
        live = live[size[live] > done]
    long = np.flatnonzero(size > LONG_SPAN)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(begin[long].tolist(), (begin + size)[long].tolist())]
    return out


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


class Block:
    """Some texts as one byte array, with the spans and hashes of their words.

    ``first[i] : first[i + 1]`` are the words of text i.
    """

    def __init__(self, texts: Sequence[bytes | None], fold: bool = False):
        texts = [t or b"" for t in texts]
        self.data = np.frombuffer(b"\n".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)))
        self.sizes = sizes
        self.begin, self.end = word_spans(self.data)
        self.first = np.searchsorted(self.begin, self.starts)
        self.first[-1] = len(self.begin)
        self.words = span_hash(_FOLD[self.data] if fold else self.data, self.begin, self.end)

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; meaningful where n words follow within the text."""
        m = len(self.words) - n + 1
        if m <= 0:
            return np.zeros(0, U64)
        out = np.zeros(m, U64)
        for k in range(n):
            out += splitmix(self.words[k : k + m] ^ U64(0xA5A5A5A5 + k)) * U64(2 * k + 3)
        return splitmix(out)


def blocks(values: Sequence[bytes | None], limit: int = 1_000_000) -> Iterator[slice]:
    """Slices of rows of about ``limit`` bytes; one longer text is a slice of its own."""
    start = size = 0
    for i, v in enumerate(values):
        size += len(v) if v else 0
        if size >= limit:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(values):
        yield slice(start, len(values))


def release() -> None:
    """Give freed memory back to the system; a worker lives on while other stages run beside it."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: memory is kept for reuse


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def column_names(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns, so that others of any name cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])
