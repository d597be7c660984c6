"""numpy kernels over Arrow string batches: word bounds, word hashes, line hashes, per-document sums.

A batch is worked on in chunks of whole documents (about ``CHUNK`` bytes, or one longer document),
so that memory follows the chunk and the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 18

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 2**63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: 1 for bytes of words: ASCII letters, digits, underscore, and all bytes of non-ASCII characters.
WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser (splitmix) of an array."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, lower: bool = False, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of runs of documents; nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b - a, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def runs(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` bytes; none crosses a document's bounds."""
    n = len(data)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = off[:-1][off[:-1] < n]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_at = off[1:][off[1:] > 0] - 1
    last[ends_at] = inside[ends_at]
    return starts, np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray | None) -> np.ndarray:
    """64-bit hash of each run; ``inside`` marks exactly the bytes of the runs (None: the runs cover all)."""
    lens = ends - starts
    if not len(lens):
        return np.zeros(0, dtype=np.uint64)
    kept = data if inside is None else data[inside]
    at = np.concatenate(([0], np.cumsum(lens)[:-1]))
    within = np.arange(len(kept), dtype=np.int64) - np.repeat(at, lens)
    with np.errstate(over="ignore"):
        step = _STEP[within & 4095]
        far = within > 4095
        if far.any():
            step = np.where(far, mix((within >> 12).astype(np.uint64)) * step, step)
        x = np.add.reduceat(_BYTE[kept] * step, at)
    return mix(x + lens.astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, hash, length in bytes) of every word of a chunk, in order."""
    inside = WORD[data]
    starts, ends = runs(data, off, inside)
    doc = np.searchsorted(off, starts, side="right") - 1
    return doc, hashes(data, starts, ends, inside), ends - starts


def sums(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Per-document sum (or count) as float64."""
    return np.bincount(doc, weights=weights, minlength=n).astype(np.float64)


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs of a chunk, ordered; hashes cut to 44 bits for one integer sort."""
    key = (doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1)


def sampled(h: Column, most: int, rows: int) -> Column:
    """Whether a row with the 64-bit hash ``h`` is among about ``most`` of ``rows``, at any number of rows: all, if they are fewer."""
    if rows <= most:
        return F.lit(True)
    return h < F.lit(-(1 << 63) + max(1, (most << 64) // rows))


def summed(df: DataFrame, of, arrays: int) -> list[np.ndarray] | None:
    """Adds up the flat float64 arrays that ``of(batch)`` gives: in tasks, then in 16 groups, then here. A task's group is its partition's
    number and sums are added in that order, so that a task that runs again changes nothing."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                got = of(b)
                total = got if total is None else [x + y for x, y in zip(total, got, strict=True)]
        if total is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part % 16], pa.int32()), pa.array([part], pa.int64())] + [pa.array([x.tobytes()]) for x in total], ["g", "part"] + names)

    names = [f"a{i}" for i in range(arrays)]
    shape = ", ".join(f"{x} binary" for x in names)

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        return pa.table({"g": t.column("g").slice(0, 1), **{x: [sum(np.frombuffer(v, dtype=np.float64) for v in t.column(x).to_pylist()).tobytes()] for x in names}})

    rows = df.mapInArrow(run, f"g int, part long, {shape}").groupBy("g").applyInArrow(add, f"g int, {shape}").orderBy("g").collect()
    return [sum(np.frombuffer(r[i + 1], dtype=np.float64) for r in rows) for i in range(arrays)] if rows else None
