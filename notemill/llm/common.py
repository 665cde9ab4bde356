"""Shared plumbing of the training-data operators.

* ``Scratch`` writes tables into the folder that ``spark.checkpoint.dir`` names and reads
  them back: lineage is cut by files that every executor can see, so a lost executor costs
  only its own tasks.
* ``Words`` finds and hashes the words of a block of texts with numpy, over the UTF-8
  bytes of the Arrow buffer, without making one Python object per word.
"""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than these; all multi-byte UTF-8 bytes belong to words.
SPACE_BYTES = (9, 10, 11, 12, 13, 32)

#: Where tables go that a lazy result reads; None: they stay until the cluster's folder is cleared.
_holder: contextvars.ContextVar[list | None] = contextvars.ContextVar("notemill_holder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, else the one set on the context. Only on one
    machine (a ``local`` master) and with neither set, as in tests, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.notemill.scratch", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="notemill-")
        spark.conf.set("spark.notemill.scratch", base)
    return base.rstrip("/")


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of a file system that Spark knows."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """The intermediate tables of one call of an operator, in the shared folder.

    ``with Scratch(spark) as run:`` deletes at its end what ``run.table`` wrote, so nothing that
    leaves the block may read that. ``run.keep`` writes a table that the operator's lazy result
    reads; it is left in the folder, or, within ``holding``, deleted when that ends. Calls share
    nothing, so one never takes away what another's result reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.paths)
        self.paths = []

    def _write(self, df: DataFrame, name: str) -> tuple[str, DataFrame]:
        path = f"{shared_dir(self.spark)}/notemill-{uuid.uuid4().hex}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path, back = self._write(df, name)
        self.paths.append(path)
        return back

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path, back = self._write(df, name)
        held = _holder.get()
        if held is not None:
            held.append(path)
        return back


@contextlib.contextmanager
def holding(spark: SparkSession) -> Iterator[list]:
    """Tables that results made in this block read are deleted at its end; use it where those results
    are written within the block."""
    held: list[str] = []
    token = _holder.set(held)
    try:
        yield held
    finally:
        _holder.reset(token)
        delete(spark, held)


def stored_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes that the planner expects ``df`` to hold, or, where it has no figure but its default for
    unknown, half the bytes of its texts; it sizes partitions, never results."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if n >= 1 << 55:
        n = (df.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0) // 2
    return n


def buckets(df: DataFrame, text_col: str, each_mb: float = 8, least: int = 64) -> int:
    """One bucket for each ``each_mb`` MB of the stored table, so that the memory that a
    bucket takes stays the same however large the table is."""
    return int(max(least, stored_bytes(df, text_col) // int(each_mb * 1_000_000)))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def free_names(df: DataFrame, *names: str) -> list[str]:
    return [free_name(df, x) for x in names]


def row_key(doc_id: Column, text: Column, column: str = "_id", other: str = "_key") -> list[Column]:
    """96 bits (a long and an int) that stand for an id of any type and a text, null or not: rows that
    share both are alike to every operator, and no others share the key."""
    seed = [doc_id.isNull(), doc_id, text.isNull(), text]
    return [F.xxhash64(F.lit(1), *seed).alias(column), F.xxhash64(F.lit(2), *seed).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias(other)]


def id_order(doc_id: Column) -> list[Column]:
    """What ids of any type are ordered by: null last."""
    return [doc_id.isNull(), doc_id]


#: Rows of a table that is broadcast at most (16 bytes each); larger ones are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def small(df: DataFrame, n: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it is counted to be small enough."""
    return F.broadcast(df) if (df.count() if n is None else n) <= MOST_BROADCAST else df


def by_bucket(df: DataFrame, n_buckets: int, column: str = "bucket", each: int = 4) -> DataFrame:
    """``df`` dealt out by bucket to a number of partitions that grows with the buckets."""
    return df.repartition(max(1, -(-n_buckets // each)), column)


def tidy() -> None:
    """Give memory that a worker no longer uses back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def _generator(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=np.uint64)


_BYTE_VALUE = _generator(7, 256)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and doubled as needed."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 21:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's constants): each output bit hangs on all input bits."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` values, from prefix sums."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * powers(_BASE, len(values)), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(_BASE_INV, n))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each begins; null as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1] or bytes(8), np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
    return data, offsets - low


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mapped(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """The texts with each byte replaced by its entry in a table."""
    data, at = text_bytes(texts)
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(table[data])])


def lowered(texts: pa.Array) -> pa.Array:
    """A-Z as a-z; null as empty."""
    return mapped(texts, _LOWER)


class Words:
    """Words of several texts that lie one after the other in one byte buffer.

    ``start`` and ``end`` are the words' byte places in ``data``; ``first[i]:first[i+1]``
    are the words of text ``i``. A null text has no words.
    """

    def __init__(self, texts: pa.Array):
        self.data, self.at = text_bytes(texts)
        n = len(self.data)
        inside = ~_SPACE[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = self.at[:-1][self.at[:-1] < n]
        begins[cut] = inside[cut]
        cut = self.at[1:][self.at[1:] > 0] - 1
        ends[cut] = inside[cut]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.at)

    def sums(self) -> np.ndarray:
        """Prefix sums from which the hash of any stretch of bytes follows."""
        sums = np.zeros(len(self.data) + 1, np.uint64)
        part = _BYTE_VALUE[self.data]
        part *= powers(_BASE, len(part))
        np.cumsum(part, out=sums[1:])
        return sums

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, a function of its bytes alone."""
        sums = self.sums()
        h = sums[self.end] - sums[self.start]
        h *= powers(_BASE_INV, len(self.data) + 1)[self.start]
        return mix(h)


def slices(rows, most: int = 1 << 20, column: int | None = None):
    """Slices of an array, or of a record batch by one of its columns, of about ``most`` bytes
    of text at a time, one row at least."""
    sizes = pc.fill_null(pc.binary_length(rows if column is None else rows.column(column)), 0)
    part = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
        if end > begin:
            yield rows.slice(begin, end - begin)


def texts_of(array: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null as empty."""
    return pc.fill_null(array, "").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
