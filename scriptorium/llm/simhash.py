"""SimHash near-dedup by the generalised pigeonhole principle.

Signature: 128 bits over the set of a text's lower-cased words. Search, exact for Hamming <= k:

1. One pass sums the bits' correlations; correlated bits are put into the same of m partitions, so that
   skew gathers in few partitions and the others stay close to uniform.
2. If thresholds t_1..t_m (each -1 or more) sum to k - m + 1, two signatures within k differ by at most
   t_i in some partition i. The t_i are allotted by dynamic programming on the number of candidates that
   each (partition, threshold) gives, from the distances of all rows' values in each partition.
3. Both sides of a pair are rows of one table, so probes meet in the middle: for t = 2 every row files
   itself under all values within 1 of its own (17 keys of 16 bits, where probing would take 137).
   t = 1 needs neighbours from rows of odd parity only, t = 3 radius 2 from those, t = 4 radius 2 from all.
4. Rows under one key are compared as whole signatures in numpy, all pairs but those that a few pivots show to be connected already, and hits
   are reduced to a spanning star before they leave the task, so that output is linear even in groups of thousands. A key with more rows
   than a task should hold is split into a grid of cells, each of two blocks of its rows.

Equal signatures are collapsed before the search, so exact copies cost one row. A group is a connected component; the document with the least
id stays. The number of partitions follows from the number of rows by the same estimate: with more rows fewer and wider ones pay, candidates
fall as 2^(-128/parts) while keys per row rise. Work per row still grows with the number of distinct signatures: an exact search within 18 of
128 bits has no linear way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from scriptorium.llm.components import components, stars
from scriptorium.llm.kernels import chunks, distinct, mix, summed, words
from scriptorium.runtime import Cut, broadcast_if, free_name, split_by_keys, without_keys

BITS = 128
#: Rows of one key, or of one block of a key, that a task compares.
HEAVY = 1 << 18
#: What filing a row under a key costs (making, shuffling and sorting 28 bytes), in comparisons of two signatures (some 6 ns).
KEY_COST = 400.0
#: Numbers of partitions that may be chosen.
PARTS = (8, 7, 6, 5, 4)


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) signatures as uint64, and which texts have words at all."""
    sig, has = np.zeros((len(texts), 2), dtype=np.uint64), np.zeros(len(texts), dtype=bool)
    for a, n, data, off in chunks(texts, lower=True):
        doc, h, _ = words(data, off)
        doc, h = distinct(doc, h)
        raw = np.stack((mix(h, 1), mix(h, 2)), axis=1).view(np.uint8)
        at = np.searchsorted(doc, np.arange(n + 1))
        for i in range(n):
            lo, hi = at[i], at[i + 1]
            if hi > lo:
                ones = np.zeros(BITS, dtype=np.int64)
                for p in range(lo, hi, 1 << 14):
                    ones += np.unpackbits(raw[p : min(hi, p + (1 << 14))], axis=1).sum(axis=0, dtype=np.uint16)
                sig[a + i] = np.packbits(2 * ones > hi - lo).view(np.uint64)
                has[a + i] = True
    return sig, has


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, s0, s1) of every row that has an id; the signature is null where the text is null or has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, has = signatures(b.column(1))
            s = sig.view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s[:, 0].copy(), mask=~has), pa.array(s[:, 1].copy(), mask=~has)], ["id", "s0", "s1"])

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, StructType([rows.schema["id"], StructField("s0", LongType()), StructField("s1", LongType())]))


@F.arrow_udf(StructType([StructField("s0", LongType()), StructField("s1", LongType()), StructField("has", BooleanType())]))
def signature(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in parts:
        sig, has = signatures(texts)
        s = sig.view(np.int64).reshape(-1, 2)
        yield pa.StructArray.from_arrays([pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy()), pa.array(has)], ["s0", "s1", "has"])


def _bits(s0: pa.Array, s1: pa.Array) -> np.ndarray:
    s = np.stack((s0.to_numpy(), s1.to_numpy()), axis=1)
    return np.unpackbits(np.ascontiguousarray(s).view(np.uint8).reshape(-1, 16), axis=1)


def correlations(sigs: DataFrame) -> np.ndarray:
    """128 x 128 correlation of the bits over all rows."""

    def of(b):
        x = _bits(b.column(0), b.column(1)).astype(np.float32) * 2 - 1
        return [(x.T @ x).astype(np.float64).ravel(), np.array([float(len(x))])]

    got = summed(sigs.select("s0", "s1"), of, 2)
    return np.eye(BITS) if got is None else got[0].reshape(BITS, BITS) / got[1][0]


def grouped_bits(corr: np.ndarray, parts: int) -> list[np.ndarray]:
    """Partitions of equal width (up to one bit): each takes the free bit that is most correlated with
    its members so far, started from the strongest pair left."""
    free, out, c = list(range(len(corr))), [], np.abs(np.round(corr, 6))
    for p in range(parts):
        width = len(free) // (parts - p)
        sub = c[np.ix_(free, free)] - np.eye(len(free)) * 2
        group = [free[int(np.unravel_index(sub.argmax(), sub.shape)[0])]]
        while len(group) < width:
            rest = [x for x in free if x not in group]
            group.append(rest[int(c[np.ix_(rest, group)].sum(axis=1).argmax())])
        free = [x for x in free if x not in group]
        out.append(np.array(sorted(group)))
    return out


def _values(bits: np.ndarray, group: np.ndarray) -> np.ndarray:
    return bits[:, group].astype(np.int64) @ (np.int64(1) << np.arange(len(group), dtype=np.int64))


def _halves(group: np.ndarray) -> list[np.ndarray]:
    """A partition of up to 16 bits as it is, a wider one in two."""
    return [group] if len(group) <= 16 else [group[: len(group) // 2], group[len(group) // 2 :]]


def histograms(sigs: DataFrame, groups: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Counts of every value of every partition over all rows, wider partitions by halves: at most 16 * 2^16 numbers."""
    halves = [h for g in groups for h in _halves(g)]

    def run(batches):
        for b in batches:
            bits = _bits(b.column(0), b.column(1))
            for p, g in enumerate(halves):
                v, n = np.unique(_values(bits, g), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), p, dtype=np.int32)), pa.array(v.astype(np.int32)), pa.array(n.astype(np.int64))], ["p", "v", "n"])

    got = sigs.select("s0", "s1").mapInArrow(run, "p int, v int, n long").groupBy("p", "v").agg(F.sum("n").alias("n")).toArrow()
    p, v, n = (got.column(i).to_numpy() for i in range(3))
    flat = [np.zeros(1 << len(h)) for h in halves]
    for i, h in enumerate(flat):
        h[v[p == i]] = n[p == i]
    left = iter(flat)
    return [[next(left) for _ in _halves(g)] for g in groups]


def distances(hists: list[np.ndarray]) -> np.ndarray:
    """How many ordered pairs of rows (a row with itself, too) differ by d bits in a partition, for all d, from the histograms of its halves, which count
    as independent. Sums over all XOR offsets come from a Walsh-Hadamard transform."""
    out, rows = np.ones(1), hists[0].sum()
    for h in hists:
        x = h.astype(np.float64).copy()
        for _ in range(2):
            step = 1
            while step < len(x):
                y = x.reshape(-1, 2, step)
                x = np.stack((y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]), axis=1).ravel()
                step *= 2
            x = x * x if _ == 0 else x / len(x)
        d = np.bincount(np.bitwise_count(np.arange(len(x), dtype=np.uint64)).astype(np.int64), np.maximum(np.round(x), 0))
        out = np.convolve(out, d / max(rows, 1) ** 2)
    return out * rows**2


def uniform(rows: float, width: int) -> np.ndarray:
    """The same for random bits."""
    d = np.array([math.comb(width, i) for i in range(width + 1)]) * (rows * rows / 2.0**width)
    d[0] += rows
    return d


def ball(width: int, radius: int) -> np.ndarray:
    """All XOR masks of up to ``radius`` bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], dtype=np.int64)


def _odd(v: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(v.astype(np.uint64)) & 1).astype(bool)


def radii(t: int) -> tuple[int, int]:
    """Radius of the filing ball for rows of even and of odd parity (-1: none); they meet within t."""
    return {-1: (-1, -1), 0: (0, 0), 1: (0, 1), 2: (1, 1), 3: (1, 2), 4: (2, 2)}[t]


def _common(width: int, d: int, r1: int, r2: int) -> int:
    """Keys that two values ``d`` bits apart share, filed with these radii."""
    return sum(math.comb(d, i) * math.comb(width - d, j) for i in range(d + 1) for j in range(width - d + 1) if i + j <= r1 and d - i + j <= r2)


def work(pairs: np.ndarray, t: int) -> float:
    """Estimated comparisons of a partition with threshold ``t``, keys counted as so many: from its ordered pairs by distance."""
    if t < 0:
        return 0.0
    width, rows, (even, odd) = len(pairs) - 1, math.sqrt(pairs.sum()), radii(t)
    met = 0.0
    for d in range(min(width, 2 * max(even, odd)) + 1):
        shared = _common(width, d, even, odd) if d % 2 else (_common(width, d, even, even) + _common(width, d, odd, odd)) / 2
        met += (pairs[d] - (rows if d == 0 else 0)) / 2 * shared
    keys = rows / 2 * sum(math.comb(width, i) for r in (even, odd) for i in range(r + 1))
    return max(met, 0.0) + KEY_COST * keys


def allotted(pairs: list[np.ndarray], k: int, top: int = 4) -> tuple[float, list[int]]:
    """Thresholds t_i in -1..top with sum k - m + 1 at the least estimated work, and that work. ``pairs``: of each partition, by distance."""
    need, best = k - len(pairs) + 1, {0: (0.0, [])}
    for d in pairs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for t in range(-1, top + 1):
            x = work(d, t)
            for s, (c, ts) in best.items():
                if s + t not in nxt or c + x < nxt[s + t][0]:
                    nxt[s + t] = (c + x, [*ts, t])
        best = nxt
    if need not in best:
        raise ValueError(f"{len(pairs)} partitions with thresholds up to {top} can't cover a distance of {k}")
    return best[need]


def chosen_parts(rows: float, k: int, parts: tuple[int, ...] = PARTS) -> int:
    """The number of partitions with the least estimated work for so many signatures of random bits."""
    cost = {}
    for m in parts:
        widths = [BITS // m + (i < BITS % m) for i in range(m)]
        if k - m + 1 <= 4 * m:
            cost[m] = allotted([uniform(rows, w) for w in widths], k)[0]
    return min(cost, key=cost.get)


def filed_keys(bits: np.ndarray, groups: list[np.ndarray], ts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(row index, key) of every filing; a key holds the partition's number above its widest value."""
    rows, keys, shift = [], [], max(len(g) for g in groups)
    for p, (g, t) in enumerate(zip(groups, ts, strict=True)):
        v = _values(bits, g)
        odd = _odd(v)
        for parity, r in zip((False, True), radii(t), strict=True):
            if r >= 0:
                at, masks = np.flatnonzero(odd == parity), ball(len(g), r)
                rows.append(np.repeat(at, len(masks)))
                keys.append(((v[at, None] ^ masks[None, :]) | (p << shift)).ravel())
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(rows), np.concatenate(keys)) if rows else (none, none)


def group_hits(ids: np.ndarray, s0: np.ndarray, s1: np.ndarray, k: int, cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Spanning star of the pairs within ``k`` of each other. Where many rows lie around a few pivots, which makes them connected, pairs among
    those are left out; all others are compared, in blocks."""
    n, held_a, held_b, held = len(ids), [], [], 0
    last = n - 1  # rows from here on need not be compared with each other
    if n > 512:
        free = np.ones(n, dtype=bool)
        for _ in range(32):
            if not free.any():
                break
            p = int(free.argmax())
            hit = np.flatnonzero(np.bitwise_count(s0 ^ s0[p]) + np.bitwise_count(s1 ^ s1[p]) <= k)
            free[hit] = False
            held_a.append(np.full(len(hit), p))
            held_b.append(hit)
        a, b = stars(np.arange(n), np.concatenate(held_a), np.concatenate(held_b))
        label = np.arange(n)
        label[a] = b
        most = np.bincount(label).argmax()
        order = np.argsort(label == most, kind="stable")
        back = np.empty(n, dtype=np.int64)
        back[order] = np.arange(n)
        ids, s0, s1 = ids[order], s0[order], s1[order]
        last = min(n - 1, n - int((label == most).sum()))
        held_a, held_b = [back[a]], [back[b]]
        held = len(a)
    step = max(1, cells // n)
    for lo in range(0, last, step):
        hi = min(last, lo + step)
        d = np.bitwise_count(s0[lo:hi, None] ^ s0[None, lo:]) + np.bitwise_count(s1[lo:hi, None] ^ s1[None, lo:])
        hit = d <= k
        if np.count_nonzero(hit) == hi - lo:  # each with itself only
            continue
        a, b = np.nonzero(hit)
        up = b > a
        held_a.append(a[up] + lo)
        held_b.append(b[up] + lo)
        held += len(held_a[-1])
        if held > cells:
            a, b = stars(np.arange(n), np.concatenate(held_a), np.concatenate(held_b))
            held_a, held_b, held = [a], [b], len(a)
    if not held:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    return stars(ids, np.concatenate(held_a), np.concatenate(held_b))


def near_edges(sigs: DataFrame, k: int = 18, parts: int | None = None, plan: tuple | None = None, heavy_rows: int | None = None) -> DataFrame:
    """(u, v) that join all signatures of (id, s0, s1), with distinct ids, within Hamming ``k`` into their components. ``parts`` partitions, or as
    many as the number of rows makes cheapest; keys of more than ``heavy_rows`` (``HEAVY``) rows are split."""
    groups, ts, most = plan or planned(sigs, k, parts)
    heavy_rows = heavy_rows or HEAVY
    wide = max(len(g) for g in groups) + (len(groups) - 1).bit_length() > 31

    def file(batches):
        for b in batches:
            ids, s0, s1 = (b.column(i).to_numpy() for i in range(3))
            for lo in range(0, len(ids), 4096):
                rows, keys = filed_keys(_bits(b.column(1)[lo : lo + 4096], b.column(2)[lo : lo + 4096]), groups, ts)
                rows = rows + lo
                if heavy:
                    rows, keys = spread_out(ids, rows, keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys if long else keys.astype(np.int32)), pa.array(ids[rows]), pa.array(s0[rows]), pa.array(s1[rows])], ["key", "id", "s0", "s1"])

    def spread_out(ids, rows, keys):
        """Rows under a heavy key of b blocks go to the b cells (their block, any block) of its grid, so that any two meet."""
        at = np.searchsorted(marked, keys)
        at[at == len(marked)] = 0
        hot = marked[at] == keys
        blocks = counts[at[hot]]
        own = (mix(ids[rows[hot]].astype(np.uint64), 4) % blocks.astype(np.uint64)).astype(np.int64)
        again = np.repeat(np.arange(len(own)), blocks)
        other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        i, j = np.minimum(own[again], other), np.maximum(own[again], other)
        cell = mix(keys[hot][again].astype(np.uint64) ^ (i.astype(np.uint64) << np.uint64(42)), 6) ^ mix(j.astype(np.uint64), 7)
        return np.concatenate((rows[~hot], rows[hot][again])), np.concatenate((keys[~hot], (cell | np.uint64(1 << 63)).view(np.int64)))

    def tally(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                key, n = np.unique(filed_keys(_bits(b.column(1)[lo : lo + 4096], b.column(2)[lo : lo + 4096]), groups, ts)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    heavy = []
    if most > heavy_rows:  # some key may have that many rows: count
        counted = sigs.select("id", "s0", "s1").mapInArrow(tally, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        heavy = counted.filter(F.col("n") > heavy_rows).orderBy("key").collect()  # few: each stands for more than heavy_rows filings
    marked, counts = np.array([r.key for r in heavy], dtype=np.int64), np.array([-(-r.n // heavy_rows) for r in heavy], dtype=np.int64)
    long = wide or bool(heavy)

    def compare(batches):
        held: list[np.ndarray] | None = None
        out_u, out_v, size = [], [], 0

        def edges(cols):
            ids, s0, s1 = cols[1], cols[2].view(np.uint64), cols[3].view(np.uint64)
            return group_hits(ids, s0, s1, k)

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_u)), pa.array(np.concatenate(out_v))], ["u", "v"])

        def take(cols, bounds):
            nonlocal size
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo > 1:
                    u, v = edges([c[lo:hi] for c in cols])
                    if len(u):
                        out_u.append(u)
                        out_v.append(v)
                        size += len(u)

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy() for i in range(4)]
            if held is not None:
                cols = [np.concatenate((x, y)) for x, y in zip(held, cols, strict=True)]
            cut = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
            last = int(cut[-1]) if len(cut) else 0
            take(cols, np.concatenate(([0], cut)))
            held = [c[last:].copy() for c in cols]
            if size > 50_000:
                yield batch()
                out_u, out_v, size = [], [], 0
        if held is not None:
            take(held, np.array([0, len(held[0])]))
        if size:
            yield batch()

    filed = sigs.select("id", "s0", "s1").mapInArrow(file, f"key {'long' if long else 'int'}, id long, s0 long, s1 long")
    by_key = filed.repartition(F.col("key")).sortWithinPartitions("key")
    return by_key.mapInArrow(compare, "u long, v long").distinct()


def planned(sigs: DataFrame, k: int, parts: int | None = None) -> tuple[list[np.ndarray], list[int], float]:
    """The bit groups and thresholds for a table of signatures, and a bound for the rows of any key."""
    groups = grouped_bits(correlations(sigs), parts or chosen_parts(sigs.count(), k))
    hists = histograms(sigs, groups)
    ts, most = allotted([distances(h) for h in hists], k)[1], 0.0
    for halves, t in zip(hists, ts, strict=True):
        r, bounds = max(radii(t)), []
        for h in halves if r >= 0 else ():
            at, filed = np.arange(len(h)), np.zeros(len(h))
            for m in ball(len(h).bit_length() - 1, r):
                filed += h[at ^ m]
            bounds.append(filed.max())
        most = max(most, min(bounds, default=0.0))
    return groups, ts, most


def near_groups(docs: DataFrame, k: int = 18, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Cut, list[Cut]]:
    """(s0, s1, root, keep): the group of every signature and the least id of its documents; the signatures of all rows with an id; and the
    written tables behind the former, to be dropped when done."""
    signs = Cut(signed(docs, id_col, text_col), "signed")
    some = signs.df.filter("s0 is not null").groupBy("s0", "s1").agg(F.min("id").alias("least"))
    heads = Cut(some.withColumn("id", F.monotonically_increasing_id()), "heads")  # numbered when written
    edges = components(near_edges(heads.df, k, parts))
    roots = heads.df.join(edges.df, heads.df["id"] == edges.df["u"], "left").select("s0", "s1", "least", F.coalesce("v", "id").alias("root"))
    roots = Cut(roots, "roots")
    keep = roots.df.groupBy("root").agg(F.min("least").alias("keep"))
    return roots.df.join(keep, "root").select("s0", "s1", "root", "keep"), signs, [heads, edges, roots]


def simhash_dedup(docs: DataFrame, k: int = 18, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the least id.

    Near: signatures at most ``k`` of 128 bits apart, and all that such links connect; found exactly.
    Rows with a null id or text, or without any word (empty, white space, signs only), have no signature
    and stay. Word order and repetition don't count, so texts of the same words are near. Rows that repeat an id are documents of their own:
    they go only where they are near to another row that stays; of a group's rows with its least id, one stays (the least by JSON form).
    Ids are of any type that sorts. Long texts are read whole. Further columns pass through under any name; an empty table gives an empty table.
    """
    groups, signs, held = near_groups(docs, k, parts, id_col, text_col)
    again = Cut(signs.df.groupBy("id").count().filter("count > 1").select(F.col("id").alias("key")), "again")
    repeats = again.df.count()
    rows = signs.df.filter("s0 is not null").join(groups, ["s0", "s1"])
    single = rows if not repeats else without_keys(rows, "id", again.df, repeats)
    gone = Cut(single.filter("id <> keep").select("id"), "gone")
    few = Cut(rows.join(again.df, F.col("id") == F.col("key"), "left_semi").select("id", "s0", "s1", "root", "keep").distinct(), "few") if repeats else None
    for t in (signs, *held):
        t.drop()
    out = without_keys(docs, id_col, gone.df, gone.df.count())
    if not repeats:
        return out
    sure, may = split_by_keys(out, F.col(id_col), again.df, F.col("key"), repeats)
    key, sig, row = (free_name(docs, x) for x in ("again", "signature", "row"))
    keys = broadcast_if(again.df.select(F.col("key").alias(key)), repeats)
    other = may.join(keys, F.col(id_col) == F.col(key), "left_anti")
    same = may.join(keys, F.col(id_col) == F.col(key), "left_semi").withColumn(sig, signature(F.col(text_col).cast("string")))
    d = few.df.select(*(F.col(c).alias(f"{key}{c}") for c in few.df.columns))
    near = same.filter(F.col(sig)["has"]).join(d, (F.col(id_col) == F.col(f"{key}id")) & (F.col(sig)["s0"] == F.col(f"{key}s0")) & (F.col(sig)["s1"] == F.col(f"{key}s1")))
    best = near.filter(F.col(f"{key}id") == F.col(f"{key}keep")).groupBy(f"{key}root").agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias(row))
    return sure.unionByName(other).unionByName(same.filter(~F.col(sig)["has"]).select(*docs.columns)).unionByName(best.select(*(F.col(row)[c].alias(c) for c in docs.columns)))
