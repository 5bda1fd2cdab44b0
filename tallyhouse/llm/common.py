"""What several operators share: the shared scratch folder, size-checked broadcasts and byte-level word hashing.

Texts reach Python as Arrow batches and are handled as UTF-8 bytes in numpy arrays, a block of
about a megabyte at a time, so that memory does not follow the length of a batch.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at once; long documents make larger batches than Spark's 10,000 rows could bear.
BATCH_ROWS = 2048
#: UTF-8 bytes that one numpy pass handles; a single longer text is still taken whole.
BLOCK_BYTES = 1 << 20
#: Largest table that is sent to every executor.
BROADCAST_BYTES = 64 << 20
#: Marks the end of a document between joined texts; no UTF-8 text holds this byte.
END = 0xFF

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_BASE = U64(0xD6E8FEB86659FD93)


#: How the tables that a Python worker keeps from task to task are dropped, by operator.
_kept: dict[str, Callable[[], None]] = {}


def keeps(name: str, drop: Callable[[], None]) -> None:
    """Say that this worker now keeps tables for operator ``name``; those of other operators go.

    Workers outlive a stage. Without this the tables of one stage of a pipeline stay while the next fills its own, and
    what its arrays took stays with the worker's allocators.
    """
    new = name not in _kept
    for other in [n for n in _kept if n != name]:
        _kept.pop(other)()
    _kept[name] = drop
    if new:
        _powers.clear()
        give_back()


def give_back() -> None:
    """Return freed memory to the system; the C library's part only where it has a call for that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, whose worker gives freed memory back when a task ends: it may idle while the next stage needs the room."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return task


def prepare(spark: SparkSession) -> None:
    """Bound what Spark hands to a Python worker at once, and let local workers find this package."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def scratch_dir(spark: SparkSession) -> str:
    """A new path below the cluster's shared checkpoint folder; a temporary folder only for a local session without one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/tallyhouse-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor costs no rerun."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the rows of the stored table ``df`` take at most ``most`` bytes; larger ones join by shuffle."""
    return F.broadcast(df) if table_bytes(df) <= most else df


def table_bytes(df: DataFrame) -> int:
    """Bytes of the rows in memory: 16 a column, and what strings and binaries hold."""
    held = F.lit(16 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        if f.dataType.typeName() in ("string", "binary"):
            held = held + F.coalesce(F.octet_length(f.name), F.lit(0))
    return df.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0]


def hot_keys(counted: DataFrame, key: str, n: str, most: int = 50_000, least: int = 1000) -> DataFrame:
    """Keys of the stored table ``counted`` that hold over ``least`` rows each, and so many that there are at most ``most``."""
    total = counted.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return F.broadcast(counted.where(F.col(n) > max(least, total // most)).select(key))


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join with a table of one row a key; rows of ``hot`` keys meet a broadcast where they are.

    ``hot`` has a proven bound (hot_keys), so the part of ``keyed`` that is broadcast has it too.
    """
    met = F.broadcast(keyed.join(hot, key, "left_semi"))
    return rows.join(hot, key, "left_anti").join(keyed, key).unionByName(rows.join(met, key))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo ``n``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_table(chars: bytes) -> np.ndarray:
    """A look-up table that is true for the bytes of ``chars``."""
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


SPACE = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
BREAK = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d\xff")
#: For words of letters and digits alone: every other ASCII byte separates.
NOT_ALNUM = np.array([b == END or (b < 128 and not chr(b).isalnum()) for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(texts: list[bytes], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``most`` bytes together, one text at least."""
    lo, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield lo, i
            lo, total = i, 0
        total += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each followed by END, and the positions of those ENDs."""
    data = np.frombuffer(b"\xff".join([*texts, b""]), dtype=np.uint8)
    return data, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + (BLOCK_BYTES >> 2))
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)]).cumprod(dtype=U64) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span [start, end), spans in order: prefix sums of a polynomial, modulo 2^64.

    Works through the data in pieces between spans, so a long text needs no table of its own length.
    """
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, side="right")))
        base = int(starts[at])
        piece = data[base : int(ends[to - 1])]
        power, inverse = _power(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, U64)
        np.cumsum((piece.astype(U64) + U64(1)) * power[: len(piece)], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64) * _ODD
        at = to
    return mix(out)


def words(data: np.ndarray, ends: np.ndarray, breaks: np.ndarray = BREAK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of every maximal run of bytes that are not in ``breaks``."""
    edge = np.diff(breaks[data].astype(np.int8), prepend=1, append=1)
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return starts, stops, np.searchsorted(ends, starts)
