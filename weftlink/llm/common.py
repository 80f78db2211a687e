"""What the training-data operators share: shared-folder tables, word hashing, row ranges."""
from __future__ import annotations

import ctypes
import gc
import hashlib
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: everything but blanks and the ASCII controls 09-0D.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)

#: Texts are hashed in pieces of about so many bytes, which bounds numpy's temporaries.
PIECE = 1 << 19
#: Spark hands rows to Python in batches of about so many bytes, as the JVM and the worker both hold them whole.
BATCH = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

U = np.uint64


# --- tables in the shared folder -------------------------------------------------------------
def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one of this machine,
    which only a local master (as in tests) may use."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = getattr(spark, "_weft_shared", None) or tempfile.mkdtemp(prefix="weft-")
        spark._weft_shared = path
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here, and an executor's
    loss costs nothing that was finished.  The files go when the driver's JVM ends."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/weft/{spark.sparkContext.applicationId}"
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._weft_path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema) over batches of BATCH bytes (or what the session has, if less), after
    which a task's Python worker, which goes on to other tasks, gives its free memory back."""
    spark = df.sparkSession
    ship(spark)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_KEY)) > BATCH:
        spark.conf.set(_BATCH_KEY, f"{BATCH}b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_weft_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(root):  # imported from a zip that was sent already
        return
    to = os.path.join(tempfile.mkdtemp(prefix="weft-zip-"), "weftlink_pkg.zip")
    with zipfile.ZipFile(to, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("weftlink", os.path.relpath(full, root)))
    sc.addPyFile(to)
    sc._weft_shipped = True


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have: the given one, with underscores before it if need be."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod(col: str, m: int):
    """crc32 of an id as text, mod m; -1 for a null id, which so belongs to no held-out part."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(m)), F.lit(-1))


# --- hashing ---------------------------------------------------------------------------------
def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _table(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) + U(seed))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_R = U(0x9E3779B97F4A7C15)
#: The bytes of a uint64 that belong to a range of 0 to 8 bytes.
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
#: Longer ranges than this are hashed one by one.
_LONG = 512


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range: eight at a time, mixed after every step, so that no
    pattern of bytes cancels out."""
    size = end - start
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray((len(padded) - 7,), np.dtype("<u8"), padded, strides=(1,))
    h = mix((eight[start] & _KEPT[np.minimum(size, 8)]) + size.astype(U) * _R)
    at = 8
    live = np.flatnonzero((size > 8) & (size <= _LONG))
    while len(live):
        h[live] = mix((h[live] ^ (eight[start[live] + at] & _KEPT[np.minimum(size[live] - at, 8)])) * _R)
        at += 8
        live = live[size[live] > at]
    for k in np.flatnonzero(size > _LONG).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[start[k]:end[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def exact_groups(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of ranges by hash, made groups of equal bytes: those that differ from the first of their
    group, whose hash they share by chance, get groups of their own."""
    size, lead = end - start, first[group]
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray((len(padded) - 7,), np.dtype("<u8"), padded, strides=(1,))
    differ = size != size[lead]
    at, live = 0, np.flatnonzero(~differ & (lead != np.arange(len(size))))
    while len(live):
        kept = _KEPT[np.minimum(size[live] - at, 8)]
        differ[live] = ((eight[start[live] + at] ^ eight[start[lead[live]] + at]) & kept) != 0
        at += 8
        live = live[~differ[live] & (size[live] > at)]
    if differ.any():
        others: dict[bytes, int] = {}
        first, group = first.tolist(), group.copy()
        for k in np.flatnonzero(differ).tolist():
            raw = data[start[k]:end[k]].tobytes()
            if raw not in others:
                others[raw] = len(first)
                first.append(k)
            group[k] = others[raw]
        first = np.array(first)
    return first, group


class Words:
    """The words of some texts: byte ranges, the text each belongs to, and 64-bit hashes."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, self.off = text_bytes(texts)
        data, off = self.data, self.off
        self.n = len(off) - 1
        word = ~_SPACE[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = off[1:-1]
        inner = inner[inner < len(data)]
        first[inner] = word[inner]
        self.start = np.flatnonzero(first)
        if len(self.start):
            last = word.copy()
            last[:-1] &= ~word[1:]
            cut = inner[inner > 0] - 1
            last[cut] = word[cut]
            self.end = np.flatnonzero(last) + 1
            self.hash = range_hash(_LOWER[data] if lower else data, self.start, self.end)
        else:
            self.end = self.start
            self.hash = np.zeros(0, U)
        #: Words of text i are first[i] .. first[i + 1].
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and where each begins; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values; the result has k - 1 fewer.  Eight values at a time make
    a block by Horner's rule, and so do the blocks, mixed in between."""
    if len(h) < k:
        return np.zeros(0, U)

    def horner(values: np.ndarray, terms: int, step: int, n: int) -> np.ndarray:
        out = values[:n].copy()
        for j in range(1, terms):
            out *= _R
            out += values[j * step:j * step + n]
        return mix(out)

    if k <= 8:
        return horner(h, k, 1, len(h) - k + 1)
    n = len(h) - k + 1
    whole, rest = divmod(k, 8)
    out = horner(horner(h, 8, 1, len(h) - 7), whole, 8, n)
    if rest:
        out = mix(out * _R + horner(h[8 * whole:], rest, 1, n))
    return out


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about `most` bytes of text each; a longer text stands alone."""
    if not batch.num_rows:
        return
    _, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(off, off[at] + most, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
