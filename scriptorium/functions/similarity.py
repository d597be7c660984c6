"""Indel similarity of words, for whole arrays of pairs at a time.

ratio = 200 * lcs / (len(a) + len(b)): a substitution costs a deletion and an insertion.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_ONE = np.uint64(1)


def lcs_small(codes: np.ndarray, lens: np.ndarray, masks: np.ndarray, mlens: np.ndarray) -> np.ndarray:
    """Longest common subsequences of pairs. ``codes`` (n, width) are the letters of one side, ``masks`` (n, letters) the bit
    positions of each letter in the other, whose length ``mlens`` is 64 at most. One bit-parallel step a letter, over all pairs."""
    n = len(codes)
    v, rows = np.full(n, ~np.uint64(0)), np.arange(n)
    with np.errstate(over="ignore"):
        for j in range(codes.shape[1]):
            u = v & masks[rows, codes[:, j]]
            step = (v + u) | (v - u)
            v = np.where(j < lens, step, v)
    full = np.where(mlens >= 64, ~np.uint64(0), (_ONE << np.minimum(mlens, 63).astype(np.uint64)) - _ONE)
    return np.bitwise_count(~v & full).astype(np.int64)


def lcs(a: str, b: str) -> int:
    """Of two strings of any length, by the same step on one big integer."""
    v, mask = (1 << len(b)) - 1, {}
    full = v
    for i, c in enumerate(b):
        mask[c] = mask.get(c, 0) | 1 << i
    for c in a:
        u = v & mask.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


@F.arrow_udf(DoubleType())
def indel_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else ratio(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


class Forms:
    """Sorted valid forms, ready to be searched for the most similar to many words."""

    def __init__(self, forms: list[str]):
        self.forms = sorted(set(forms))
        letters = sorted({c for f in self.forms for c in f})
        self.code = {c: i for i, c in enumerate(letters)}
        n, k = len(self.forms), len(letters)
        self.lens = np.array([len(f) for f in self.forms], dtype=np.int64)
        self.masks, self.counts = np.zeros((n, k + 1), dtype=np.uint64), np.zeros((n, k + 1), dtype=np.int16)
        for i, f in enumerate(self.forms):
            for p, c in enumerate(f):
                self.counts[i, self.code[c]] += 1
                if p < 64:
                    self.masks[i, self.code[c]] |= _ONE << np.uint64(p)
        self.by_len = {int(m): np.flatnonzero(self.lens == m) for m in np.unique(self.lens)}
        small = np.uint8 if n and self.lens.max() < 256 else np.int16
        #: counts of each letter in the forms of each length: letters in rows
        self.rows = {m: np.ascontiguousarray(self.counts[at].T.astype(small)) for m, at in self.by_len.items()}

    def best(self, words: list[str], least: np.ndarray, cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
        """(index of the most similar form or -1, its ratio) of each word, where the ratio is at least ``least``; the smallest form
        on ties. Two lossless bounds come first: lengths, and letters in common. Both are held against the best ratio so far, which
        is soon high: the likeliest lengths come first, and in each the form with most letters in common."""
        k = len(self.code)
        out, score = np.full(len(words), -1), np.full(len(words), -1.0)
        lens = np.array([len(w) for w in words], dtype=np.int64)
        for m in np.unique(lens).tolist():
            of_len = np.flatnonzero(lens == m)
            codes = np.array([[self.code.get(c, k) for c in words[i]] for i in of_len], dtype=np.int64).reshape(len(of_len), m)
            counts = np.zeros((len(of_len), k + 1), dtype=np.int16)
            np.add.at(counts, (np.arange(len(of_len))[:, None], codes), 1)
            counts[:, k] = 0
            for fl, forms in sorted(self.by_len.items(), key=lambda x: -min(m, x[0]) / (m + x[0])):
                bound = 200.0 * min(m, fl) / (m + fl)
                live = np.flatnonzero(np.maximum(least[of_len], score[of_len]) <= bound + 1e-9)
                step = max(1, cells // (len(forms) * (k + 1)))
                for lo in range(0, len(live), step):
                    rows = live[lo : lo + step]
                    table = self.rows[fl]
                    own = np.minimum(counts[rows], 255).T.astype(table.dtype) if table.dtype == np.uint8 else counts[rows].T
                    common = np.zeros((len(rows), len(forms)), dtype=table.dtype)  # no letter is common more often than the form has it
                    for c in np.flatnonzero(own.any(axis=1) & table.any(axis=1)).tolist():
                        common += np.minimum(own[c][:, None], table[c][None, :])
                    need = np.maximum(least[of_len[rows]], score[of_len[rows]])
                    if fl <= 64:
                        top = common.argmax(axis=1)
                        seed = lcs_small(codes[rows], np.full(len(rows), m), self.masks[forms[top]], np.full(len(rows), fl))
                        need = np.maximum(need, 200.0 * seed / (m + fl))
                    enough = np.clip(np.ceil((need - 1e-9) * (m + fl) / 200.0 - 1e-9), 0, None)
                    sure = np.flatnonzero(enough <= fl)
                    a, b = np.nonzero(common[sure] >= enough[sure].astype(table.dtype)[:, None])
                    a = sure[a]
                    if not len(a):
                        continue
                    if fl <= 64:
                        got = lcs_small(codes[rows[a]], np.full(len(a), m), self.masks[forms[b]], np.full(len(a), fl))
                    else:
                        got = np.array([lcs(words[of_len[rows[x]]], self.forms[forms[y]]) for x, y in zip(a, b, strict=True)])
                    r = 200.0 * got / (m + fl)
                    order = np.lexsort((forms[b], -r, a))
                    first = order[np.concatenate(([True], a[order][1:] != a[order][:-1]))]
                    w, s, f = of_len[rows[a[first]]], r[first], forms[b[first]]
                    better = (s >= least[w] - 1e-9) & ((s > score[w]) | ((s == score[w]) & (f < out[w])))
                    out[w[better]], score[w[better]] = f[better], s[better]
        return out, score
