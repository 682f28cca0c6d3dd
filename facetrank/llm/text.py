"""Vectorised text kernels shared by the operators that run on Arrow batches.

Texts are handled as the UTF-8 bytes of an Arrow string column, in slices of a few MB, so that a task's memory follows
the slice (or the longest single document) and not the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

#: Bytes of text that a kernel handles at once; its arrays take some 100 times that.
SLICE_BYTES = 1 << 20
U64 = np.uint64
#: 16 bytes; a deployment that fears made-up collisions sets its own, the same on all workers.
HASH_KEY = "content of texts"
_BASE = 0x9E3779B97F4A7C15 | 1  # odd, hence invertible modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def unused(name: str, *taken: Iterable[str]) -> str:
    """A column name like ``name`` that none of the lists holds; names are compared as Spark does, without case."""
    held = {c.lower() for some in taken for c in some}
    while name.lower() in held:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def with_columns_of(docs: DataFrame, text: str, added: list[StructField], make: Callable[[pa.RecordBatch, str], list[pa.Array]]) -> DataFrame:
    """``docs`` with the columns ``added``, which ``make`` works out from slices of rows; it is given the slice and the
    name that the text column has in it.

    Columns travel under numbers, as a batch function's input can't have every name that a table can.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = names[[c.lower() for c in docs.columns].index(text.lower())]
    more = [f"added{i}" for i in range(len(added))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, held):
            yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch, held)], names=[*names, *more])

    fields = [StructField(n, f.dataType) for n, f in zip(names + more, [*docs.schema.fields, *added], strict=True)]
    return docs.toDF(*names).mapInArrow(run, StructType(fields)).toDF(*docs.columns, *(f.name for f in added))


def worker_cache(name: str, make):
    """An object that lives as long as this Python worker process, so that tasks share it."""
    held = sys.__dict__.setdefault("_facetrank_worker_cache", {})
    if name not in held:
        held[name] = make()
    return held[name]


def release(using: str | None = None) -> None:
    """Drop what other operators' tasks have left in this worker, which serves one stage after the other."""
    held = sys.__dict__.get("_facetrank_worker_cache", {})
    gone = [n for n in held if n not in ("powers", using)]
    for name in gone:
        del held[name]
    if gone:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)  # give the pages back, where the system's library can


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, using: str | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text (a longer document stands alone).

    ``using`` names the object of :func:`worker_cache` that the caller needs; others go.
    """
    release(using)
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offset of each text and the end); a null text is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64, so that near values fall far apart."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[:1] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
        done += step
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of each, kept by the worker."""
    held = worker_cache("powers", dict)
    if not held or len(held["up"]) < n:
        size = max(n, SLICE_BYTES + 1024)
        held["up"], held["down"] = _powers(_BASE, size), _powers(_BASE_INV, size)
    return held["up"], held["down"]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`range_hashes` gets the hash of any byte range."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal ranges have equal hashes wherever they stand.

    The reverse doesn't hold for all bytes (a power of two as modulus), so this only brings candidates together; where
    equality decides a result, use :func:`content_hashes`.
    """
    _, down = powers(len(prefix))
    return mix((prefix[stop] - prefix[start]) * down[start])


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start and end of each word, first word of each document and the end); words never cross documents."""
    solid = ~IS_SPACE[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(raw)]
    before[inner] = False
    after = np.zeros(len(raw), bool)
    after[:-1] = solid[1:]
    last = inner - 1
    after[last[last >= 0]] = False
    start, stop = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return start, stop, np.searchsorted(start, offsets)


def content_hashes(values: Iterable[bytes] | np.ndarray) -> np.ndarray:
    """64 bits of a keyed hash (SipHash) of each value, for equality that decides results: a pseudo-random function, so no
    pattern of bytes makes different values collide more often than chance does."""
    if not isinstance(values, np.ndarray):
        held = [bytes(v) for v in values]
        values = np.empty(len(held), object)
        values[:] = held
    return hash_array(values, hash_key=HASH_KEY, categorize=False) if len(values) else np.empty(0, U64)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit content hash of each word, first word of each document and the end); distinct words are hashed once."""
    start, stop, first = words(raw, offsets)
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(stop - start, out=ends[1:])
    letters = raw[~IS_SPACE[raw]]
    every = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letters))])
    coded = every.dictionary_encode()
    return content_hashes(coded.dictionary.to_numpy(zero_copy_only=False))[np.asarray(coded.indices)], first


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the ``n`` words from each word on, whether they all stand in one document)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, U64), np.empty(0, bool)
    out = hashes[:m].copy()
    for k in range(1, n):
        out *= U64(_BASE)
        out += hashes[k : k + m]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return mix(out), doc[:m] == doc[n - 1 : n - 1 + m]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each range between neighbouring offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
