"""Embedding near-dedup: Euclidean p-stable hashing of normalised vectors, then exact cosine checks.

1. Every vector is scaled to length 1 and filed in ``tables`` buckets; a bucket is the tuple of ``k`` quantised
   Gaussian projections floor((a.v + b) / width). ``k`` and ``tables`` follow from the number of rows, the
   threshold and the wanted recall by the collision probability of the family (see :func:`planned`).
2. What travels to the buckets is 24 bytes a filing: bucket, id and a 64-bit sign sketch. Inside a bucket the
   sketches are compared, all pairs, with a bound five standard deviations beyond the threshold's angle; rows
   that no sketch links to another drop out here, which are nearly all chance collisions.
3. The linked sets, told apart by a hash of their members, get their vectors by one join, and all pairs of a
   set are compared by exact cosine in blocks. Equal vectors are collapsed first, by their bytes. Hits leave a
   task as a spanning star, so output is linear in the size of a group.
   Ids that are repeated are merged first; only their vectors are shuffled for that.
4. Connected components of the hits; the least id of a group stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.components import components, stars
from scriptorium.llm.kernels import mix
from scriptorium.runtime import Cut, split_by_keys, without_keys

SKETCH = 64


def collision(distance: float, width: float) -> float:
    """Chance that one projection puts two vectors at this distance into one cell."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def planned(rows: int, threshold: float, width: float, recall: float, strangers: float = 4.0) -> tuple[int, int]:
    """(k, tables): with k projections about ``strangers`` unrelated rows share a row's bucket; as many tables
    as find a pair exactly at the threshold with chance ``recall``."""
    near, far = collision(math.sqrt(2 - 2 * threshold), width), collision(math.sqrt(2), width)
    k = max(1, math.ceil(math.log(max(rows, 2) / strangers) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def sketch_bound(threshold: float) -> int:
    share = math.acos(threshold) / math.pi
    return min(SKETCH, math.ceil(SKETCH * share + 5 * math.sqrt(SKETCH * share * (1 - share))))


def unit_rows(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, unit vectors) of the rows that have a direction, by number of dimensions. Rows that are null,
    empty, all zero, or hold a null, NaN or infinite component have none."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    at = np.concatenate(([0], np.cumsum(sizes)))
    for dims in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == dims)
        x = flat[at[rows][:, None] + np.arange(dims)]
        with np.errstate(invalid="ignore", over="ignore"):
            top = np.abs(x).max(axis=1)
            good = np.isfinite(top) & (top > 0)
        x = x[good] / top[good, None]
        yield rows[good], x / np.sqrt((x * x).sum(axis=1))[:, None]


def sketches(x: np.ndarray, seed: int) -> np.ndarray:
    planes = np.random.default_rng((seed, x.shape[1], 1)).normal(size=(x.shape[1], SKETCH))
    return np.packbits(x @ planes > 0, axis=1).view(np.uint64).ravel()


def buckets(x: np.ndarray, k: int, tables: int, width: float, seed: int) -> np.ndarray:
    """(rows, tables) bucket keys."""
    rng = np.random.default_rng((seed, x.shape[1], 0))
    a, b = rng.normal(size=(x.shape[1], tables * k)), rng.uniform(0, width, tables * k)
    cells = np.floor((x @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(x), tables, k)
    key = np.broadcast_to(mix(np.arange(tables, dtype=np.uint64), x.shape[1]), cells.shape[:2])
    for i in range(k):
        key = mix(key ^ cells[:, :, i], i)
    return key


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray]]:
    """(columns, bounds of the runs of equal first columns) of stretches of sorted batches; no run is split between stretches."""
    held: list | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        if held is not None:
            cols = [np.concatenate((x, y)) for x, y in zip(held, cols, strict=True)]
        cut = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
        if len(cut):
            yield [c[: cut[-1]] for c in cols], np.concatenate(([0], cut))
        held = [c[cut[-1] if len(cut) else 0 :].copy() for c in cols]
    if held is not None:
        yield held, np.array([0, len(held[0])])


def near_pairs(sketch: np.ndarray, edges: np.ndarray, bound: int, few: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that join, within each run, the sketches within ``bound``. Runs of up to ``few`` rows are compared all at once,
    by shifting; longer ones one by one."""
    size = np.diff(edges)
    run, held_a, held_b = np.repeat(np.arange(len(size)), size), [], []
    small = size[run] <= few
    for s in range(1, few):
        at = np.flatnonzero((run[s:] == run[:-s]) & small[s:])
        at = at[np.bitwise_count(sketch[at] ^ sketch[at + s]) <= bound]
        held_a.append(at)
        held_b.append(at + s)
    for r in np.flatnonzero(size > few):
        lo = edges[r]
        _, first, inv = np.unique(linked(sketch[lo : edges[r + 1]], bound), return_index=True, return_inverse=True)
        at = np.flatnonzero(first[inv] != np.arange(len(inv)))
        held_a.append(at + lo)
        held_b.append(first[inv][at] + lo)
    return np.concatenate(held_a), np.concatenate(held_b)


def linked(sketch: np.ndarray, bound: int, cells: int = 1 << 22) -> np.ndarray:
    """Label of every row's component under sketch distances up to ``bound``."""
    u, inv = np.unique(sketch, return_inverse=True)
    n, a, b, held = len(u), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    step = max(1, cells // n)
    for lo in range(0, n, step):
        i, j = np.nonzero(np.bitwise_count(u[lo : lo + step, None] ^ u[None, lo:]) <= bound)
        up = j > i
        held.append((i[up] + lo, j[up] + lo))
        if sum(len(x) for x, _ in held) > cells or lo + step >= n:
            a, b = stars(np.arange(n), np.concatenate([a, *(x for x, _ in held)]), np.concatenate([b, *(y for _, y in held)]))
            held = []
    label = np.arange(n)
    label[a] = b
    return label[inv]


def close_pairs(ids: np.ndarray, x: np.ndarray, threshold: float, cells: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Spanning star of all pairs of unit vectors whose cosine is at least ``threshold``."""
    _, first, inv = np.unique(x, axis=0, return_index=True, return_inverse=True)
    inv = inv.ravel()
    n, at = len(first), np.arange(len(ids))
    a, b = at[first[inv] != at], first[inv][first[inv] != at]
    y, held, count = x[first], [], 0
    step = max(1, cells // n)
    for lo in range(0, n, step):
        i, j = np.nonzero(y[lo : lo + step] @ y[lo:].T >= threshold)
        up = j > i
        held.append((first[i[up] + lo], first[j[up] + lo]))
        count += int(up.sum())
        if count > cells:
            a, b = stars(at, np.concatenate([a, *(p for p, _ in held)]), np.concatenate([b, *(q for _, q in held)]))
            held, count = [], 0
    a, b = np.concatenate([a, *(p for p, _ in held)]), np.concatenate([b, *(q for _, q in held)])
    return stars(ids, a, b) if len(a) else (a, b)


def close_in_runs(ids: np.ndarray, x: np.ndarray, run: np.ndarray, threshold: float, few: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) that join, within each run of equal ``run``, the ids whose unit vectors ``x`` have a cosine of at least ``threshold``."""
    edges = np.concatenate(([0], np.flatnonzero(run[1:] != run[:-1]) + 1, [len(run)]))
    size = np.diff(edges)
    no, out_u, out_v = np.repeat(np.arange(len(size)), size), [], []
    small = size[no] <= few
    for s in range(1, few):
        at = np.flatnonzero((no[s:] == no[:-s]) & small[s:])
        for lo in range(0, len(at), 1 << 16):
            p = at[lo : lo + (1 << 16)]
            p = p[np.einsum("ij,ij->i", x[p], x[p + s]) >= threshold]
            out_u.append(np.maximum(ids[p], ids[p + s]))
            out_v.append(np.minimum(ids[p], ids[p + s]))
    for r in np.flatnonzero(size > few):
        u, v = close_pairs(ids[edges[r] : edges[r + 1]], x[edges[r] : edges[r + 1]], threshold)
        out_u.append(u)
        out_v.append(v)
    return np.concatenate(out_u), np.concatenate(out_v)


def _stretches(batches: Iterator[pa.RecordBatch], least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole runs of equal first columns, out of sorted batches."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        if sum(t.num_rows for t in held) < least:
            continue
        whole = pa.concat_tables(held).combine_chunks()
        key = whole.column(0).to_numpy()
        cut = np.flatnonzero(key[1:] != key[:-1])
        held = [whole]
        if len(cut):
            yield whole.slice(0, int(cut[-1]) + 1)
            held = [whole.slice(int(cut[-1]) + 1)]
    if held:
        yield pa.concat_tables(held)


def whole_numbers(df: DataFrame, id_col: str) -> None:
    """Ids are nodes of components and 64-bit numbers: an error says so where the column isn't of an integer type."""
    kind = df.schema[id_col].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be of an integer type, not {kind}: number the rows first")


def embedding_groups(vectors: DataFrame, threshold: float = 0.95, width: float = 2.0, recall: float = 0.97, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row (id, keep_id) for every id: keep_id is the least id of its group of near copies.

    Near: cosine at least ``threshold``, and all that such links connect. Pairs exactly at the threshold are
    found with chance ``recall``, closer ones with more; what is found is checked exactly, so nothing further apart
    is linked. The number of rows sets how many projections a bucket has and how many tables there are, so that one pair may be found in one
    table and missed in a larger one; the chance is the same. Ids are whole numbers; others are an error. Vectors of different numbers of dimensions are never near. A vector without a direction (null, empty, all
    zero, or with a null, NaN or infinite component) is near to none and keeps its own id. Rows with a null id are
    left out here. An id stands for one vector: of rows that repeat it, the one with the least components counts. Equal vectors are near.
    Other columns are ignored under any name; an empty table gives an empty table.
    """
    whole_numbers(vectors, id_col)
    kind = vectors.schema[vec_col].dataType.simpleString()
    rows = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias("v"))
    repeated = Cut(rows.groupBy("id").count().filter("count > 1").select(F.col("id").alias("key")), "repeated")
    again = repeated.df.count()
    if again:
        once, more = split_by_keys(rows, F.col("id"), repeated.df, F.col("key"), again)
        rows = once.unionByName(more.groupBy("id").agg(F.min("v").alias("v")))
    every = Cut(rows, "vectors")
    repeated.drop()
    count = every.df.count()
    k, tables = planned(count, threshold, width, recall)
    bound = sketch_bound(threshold)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for at, x in unit_rows(b.column(1)):
                sk = sketches(x, seed)
                for lo in range(0, len(at), 2048):
                    key = buckets(x[lo : lo + 2048], k, tables, width, seed)
                    some = at[lo : lo + 2048]
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(ids[some], tables)), pa.array(np.repeat(sk[lo : lo + 2048], tables).view(np.int64))], ["key", "id", "sketch"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, ids, sk), edges in whole_keys(batches):
            a, b = near_pairs(sk.view(np.uint64), edges, bound)
            if not len(a):
                continue
            node, root = stars(np.arange(len(ids)), a, b)
            top = np.unique(root)
            node, root = np.concatenate((node, top)), np.concatenate((root, top))
            order = np.lexsort((ids[node], root))
            own, root = ids[node][order], root[order]
            start = np.flatnonzero(np.concatenate(([True], root[1:] != root[:-1])))
            with np.errstate(over="ignore"):
                sums = np.add.reduceat(mix(own.astype(np.uint64), 5), start)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sums.view(np.int64), np.diff(np.append(start, len(own))))), pa.array(own)], ["set", "id"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _stretches(batches):
            run, ids = t.column(0).to_numpy(), t.column(1).to_numpy()
            for at, x in unit_rows(t.column(2).combine_chunks()):
                if len(at) > 1:
                    u, v = close_in_runs(ids[at], x, run[at], threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    filed = every.df.mapInArrow(file, "key long, id long, sketch long").repartition(F.col("key")).sortWithinPartitions("key")
    sets = Cut(filed.mapInArrow(link, "set long, id long").distinct(), "sets")
    members = sets.df.join(every.df, "id").select("set", "id", "v")
    edges = members.repartition(F.col("set")).sortWithinPartitions("set").mapInArrow(verify, "u long, v long").distinct()
    found = components(edges)
    sets.drop()
    return every.df.select("id").join(found.df, F.col("id") == F.col("u"), "left").select(F.col("id").alias(id_col), F.coalesce("v", "id").alias("keep_id"))


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **params) -> DataFrame:
    """``vectors`` without the rows whose id :func:`embedding_groups` maps to another id. Rows with a null id stay; so do
    all rows of an id that stays. All columns pass through under any name."""
    gone = Cut(embedding_groups(vectors, id_col=id_col, vec_col=vec_col, **params).filter(F.col(id_col) != F.col("keep_id")).select(id_col), "gone")
    return without_keys(vectors, id_col, gone.df, gone.df.count())
