"""Aligning noisy page texts with a clean reference edition.

Finding anchors, n-gram scores and best lines are declarative. The word alignment of a page and the cursor that
goes from page to page are sequential by nature: they run as one Arrow task per reference edition, many editions at once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from scriptorium.functions import text as T
from scriptorium.functions.blocks import Blocks
from scriptorium.runtime import spread

_BREAK, _OTHER = re.compile(r"-\s*\n\s*"), re.compile(r"[^a-z0-9\s]")


def plain_words(text: str) -> list[str]:
    """As the expression of the same name."""
    t = unicodedata.normalize("NFD", _BREAK.sub("", text).lower())
    return _OTHER.sub(" ", "".join(c for c in t if unicodedata.category(c) != "Mn")).split()


def grams(text: str, n: int = 3) -> set[str]:
    return {text[i : i + n] for i in range(len(text) - n + 1)}


def find_anchor(page: list[str], ref: list[str], start: int = 0, probe: int = 30, step: int = 10, window: int = 6, forward: int = 3, least: float = 0.10) -> tuple[int, float]:
    """(word of the reference where the page most likely begins, its score). Candidates lie every ``step`` words up to ``forward`` page
    lengths ahead; the first best counts; under ``least`` the search's start is trusted."""
    own, best, top = grams(" ".join(page[:probe])), start, -1.0
    for i in range(start, min(len(ref) - probe, start + forward * len(page)), step):
        there = grams(" ".join(ref[i : i + probe * window]))
        score = len(own & there) / len(own | there) if own and there else 0.0
        if score > top:
            best, top = i, score
    return (best, top) if top >= least else (start, top)


def _matching(a: str, b: str) -> int:
    """Letters in the longest common block (the first in a, then in b) and, again, left and right of it."""
    for size in range(min(len(a), len(b)), 0, -1):
        for i in range(len(a) - size + 1):
            j = b.find(a[i : i + size])
            if j >= 0:
                left = _matching(a[:i], b[:j]) if i and j else 0
                return size + left + (_matching(a[i + size :], b[j + size :]) if i + size < len(a) and j + size < len(b) else 0)
    return 0


def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio. Words of usual length are compared by substring search, which is several times faster."""
    if a == b:
        return 1.0
    if max(len(a), len(b)) > 30:
        return SequenceMatcher(None, a, b).ratio()
    return 2.0 * _matching(a, b) / (len(a) + len(b))


def _letters(words: list[str]) -> np.ndarray:
    return np.array([sum(1 << (ord(c) % 37) for c in set(w)) for w in words], dtype=np.uint64)


def _similarities(own: list[str], other: list[str]) -> np.ndarray:
    """Block ratios of each word with each other one, all at once. Words without a common letter aren't compared."""
    out = np.zeros((len(own), len(other)))
    if out.size:
        of, to = np.nonzero(_letters(own)[:, None] & _letters(other)[None, :])
        out[of, to] = Blocks(other).ratios(own, of, to)
        place = {w: i for i, w in enumerate(other)}
        for k, w in enumerate(own):
            if w in place:
                out[k, place[w]] = 1.0
    return out


def align_words(page: list[str], ref: list[str], match: float = 2.0, mismatch: float = -1.0, gap: float = -0.5, enough: float = 0.6) -> list[tuple[int | None, int | None]]:
    """Pairs (page word, reference word) of the best alignment; None is a gap. The reference's ends are free.
    Of equal choices a pair goes before a gap in the reference, that before a gap in the page."""
    m, n = len(page), len(ref)
    word_id: dict[str, int] = {}
    cols = np.array([word_id.setdefault(w, len(word_id)) for w in ref], dtype=np.int64)
    distinct = list(word_id)
    best, way = np.zeros(n + 1), np.zeros((m + 1, n + 1), dtype=np.int8)  # 0 pair, 1 gap in the reference, 2 gap in the page
    way[0, 1:], way[1:, 0] = 2, 1
    own = list(dict.fromkeys(page))
    sims = _similarities(own, distinct)
    rows = {w: np.where(sim >= enough, match, mismatch * (1 - sim)) if len(sim) else sim for w, sim in zip(own, sims, strict=True)}
    for i, w in enumerate(page, 1):
        score = rows[w]
        diag, up = best[:-1] + (score[cols] if n else 0.0), best[1:] + gap
        kind = np.where(diag >= up, 0, 1)
        now, row, gaps = float(best[0]) + gap, [], []
        row.append(now)
        for j, top in enumerate(np.maximum(diag, up).tolist()):  # a gap in the page depends on the cell before
            now += gap
            if now > top:
                gaps.append(j)
            else:
                now = top
            row.append(now)
        kind[gaps] = 2
        way[i, 1:] = kind
        best = np.array(row)
    i, j, out = m, int(best.argmax()), []
    while i or j:
        k = way[i, j]
        if k == 0:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif k == 1:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def align_edition(pages: list[str], reference: str, probe: int = 25, tail: int = 300, behind: int = 1500, forward: int = 3, least: float = 0.10, restart: bool = True, corrected: bool = False) -> Iterator[tuple[int, int, str, str, int, int]]:
    """(page, line, page line, reference line, first word, last word) over the pages in order.

    Each page is searched from the earlier of the running cursor and the place that the words so far would suggest. The reference
    line is what lies between a line's first and last matched word. Words are found in the normalised text and cut from the raw one:
    stand-alone punctuation makes the two drift apart. With ``corrected`` each normalised word keeps its raw place, so they don't.
    """
    raw = reference.split()
    if corrected:
        pairs = [(w, i) for i, r in enumerate(raw) for w in plain_words(r)]
        norm, place = [w for w, _ in pairs], [i for _, i in pairs]
    else:
        norm = plain_words(reference)
        place = list(range(len(norm)))
    total = sum(len(p.split()) for p in pages)
    rate = len(norm) / total if restart and total else 0.0
    cursor = before = 0
    for no, text in enumerate(pages):
        lines = text.splitlines()
        each = [plain_words(x) for x in lines]
        words = [w for x in each for w in x]
        count = len(text.split())
        if not words:
            before += count
            continue
        expected = int(before * rate) if restart else cursor
        start = max(0, min(cursor, expected) - max(behind, len(words)))
        anchor, _ = find_anchor(words, norm, start, min(probe, len(words)), forward=forward, least=least)
        end = min(len(norm), anchor + len(words) + tail)
        to = {a: b for a, b in align_words(words, norm[anchor:end]) if a is not None and b is not None}
        at = 0
        for k, x in enumerate(each):
            hit = [to[i] for i in range(at, at + len(x)) if i in to]
            at += len(x)
            if hit:
                lo, hi = anchor + min(hit), anchor + max(hit)
                yield no, k, lines[k], " ".join(raw[place[lo] : place[hi] + 1]), lo, hi
            else:
                yield no, k, lines[k], "", -1, -1
        cursor = anchor + max(to.values()) + 1 if to else anchor + len(words)
        before += count


def align_pages(pages: DataFrame, references: DataFrame, edition: str, order: str, text_col: str = "text", corrected: bool = False, **params) -> DataFrame:
    """(edition, page, line, ocr_line, ref_line, first_word, last_word). ``pages`` (edition, order, text) are aligned in order with the one text
    that ``references`` (edition, text) has for their edition; null texts count as empty."""
    shape = f"{edition} {pages.schema[edition].dataType.simpleString()}, {order} {pages.schema[order].dataType.simpleString()}, line int, ocr_line string, ref_line string, first_word int, last_word int"
    kinds = [edition, order, "line", "ocr_line", "ref_line", "first_word", "last_word"]

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(order, kind="stable")
        texts = [t or "" for t in left[text_col]]
        names = left[order].tolist()
        ref = (right[text_col].iloc[0] or "") if len(right) else ""
        rows = [(key[0], names[p], line, a, b, lo, hi) for p, line, a, b, lo, hi in align_edition(texts, ref, corrected=corrected, **params)]
        return pd.DataFrame(rows, columns=kinds)

    left, right = spread(pages.select(edition, order, text_col), edition), spread(references.select(edition, text_col), edition)
    return left.groupBy(edition).cogroup(right.groupBy(edition)).applyInPandas(run, shape)


def anchor_candidates(pages: DataFrame, references: DataFrame, edition: str, page: str, probe: int = 30, step: int = 10, window: int = 6, forward: int = 3, text_col: str = "text") -> DataFrame:
    """(edition, page, at, score): the best place of each page in its reference, searched from the reference's start. A page whose
    reference is missing or no longer than the probe has no place to try: at is 0 and the score -1. Pages without words have no row."""
    w = F.col("w")
    p = pages.select(edition, page, T.plain_words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    p = p.groupBy(edition).agg(F.collect_list(F.struct(page, F.array_join(F.slice(w, 1, probe), " ").alias("head"), F.size(w).alias("n"))).alias("p"))
    r = references.select(edition, T.plain_text(F.col(text_col)).alias("r"))

    @F.arrow_udf("array<struct<at:int,score:double>>")
    def search(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for heads, counts, texts in parts:
            rows = zip(heads.to_pylist(), counts.to_pylist(), texts.to_pylist(), strict=True)
            found = [[{"at": at, "score": score} for at, score in _candidates(h, n, t or "", probe, step, window, forward)] for h, n, t in rows]
            yield pa.array(found, pa.list_(pa.struct([("at", pa.int32()), ("score", pa.float64())])))

    # a reference is sent once for all its pages, of which only the beginnings go along
    both = p.join(r, edition, "left").withColumn("x", search(F.col("p")["head"], F.col("p")["n"], "r"))
    rows = both.select(edition, F.explode(F.arrays_zip(F.col("p"), F.col("x"))).alias("z"))
    scored = rows.select(edition, F.col("z.p")[page].alias(page), F.col("z.x.at").alias("at"), F.col("z.x.score").alias("score"))
    return scored.groupBy(edition, page).agg(F.min_by("at", F.struct(-F.col("score"), "at")).alias("at"), F.max("score").alias("score"))


_GRAM_CODE = np.full(128, 0, dtype=np.int64)
_GRAM_CODE[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789"]] = np.arange(1, 37)


def _gram_codes(text: str) -> np.ndarray:
    """A number for each three characters of a plain text (a-z, 0-9 and blanks)."""
    c = _GRAM_CODE[np.frombuffer(text.encode(), dtype=np.uint8)]
    return c[:-2] * 1369 + c[1:-1] * 37 + c[2:] if len(c) > 2 else c[:0]


def _candidates(heads: list[str], counts: list[int], text: str, probe: int, step: int, window: int, forward: int) -> Iterator[tuple[int, float]]:
    """As :func:`find_anchor` from the start of a plain text, without its least score, for pages of so many words that begin so. A window has as
    many different grams as have no earlier place in it."""
    grams_ = _gram_codes(text)
    blanks = np.flatnonzero(np.frombuffer(text.encode(), dtype=np.uint8) == 32)
    size = len(blanks) + 1 if text else 0
    starts, ends = np.append(0, blanks + 1), np.append(blanks, len(text))
    order = np.argsort(grams_, kind="stable")
    before = np.full(len(grams_), -1)
    same = np.flatnonzero(grams_[order[1:]] == grams_[order[:-1]])
    before[order[same + 1]] = order[same]
    mine = np.zeros(37**3, dtype=bool)
    for head, n in zip(heads, counts, strict=True):
        k = min(probe, n)
        own = np.unique(_gram_codes(head))
        mine[own] = True
        has = mine[grams_]
        at, top = 0, -1.0
        for i in range(0, min(size - k, forward * n), step):
            lo, hi = starts[i], max(starts[i], ends[min(i + k * window, size) - 1] - 2)
            new = before[lo:hi] < lo
            there, both = np.count_nonzero(new), np.count_nonzero(new & has[lo:hi])
            score = both / (len(own) + there - both) if len(own) and there else 0.0
            if score > top:
                at, top = i, score
        mine[own] = False
        yield at, top


class BlockIndex:
    """Reference texts in order, ready to be searched for the most similar to many lines."""

    def __init__(self, texts: list[str], part: int = 500):
        self.same = {t: i for i, t in reversed(list(enumerate(texts)))}
        self.parts = [(lo, Blocks(texts[lo : lo + part]), len(texts[lo : lo + part])) for lo in range(0, len(texts), part)]

    def best(self, lines: list[str], pairs: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
        """(index of the most similar text, its block ratio) of each line; the first on ties."""
        at, top = np.full(len(lines), -1), np.full(len(lines), -1.0)
        for first, index, n in self.parts:
            step = max(1, pairs // n)
            for lo in range(0, len(lines), step):
                some = lines[lo : lo + step]
                k = len(some)
                r = index.ratios(some, np.repeat(np.arange(k), n), np.tile(np.arange(n), k)).reshape(k, n)
                i = r.argmax(axis=1)
                x = r[np.arange(k), i]
                better = x > top[lo : lo + k]
                at[lo : lo + k][better], top[lo : lo + k][better] = first + i[better], x[better]
        for k, t in enumerate(lines):
            if t in self.same:
                at[k], top[k] = self.same[t], 1.0
        return at, top


def line_best_match(lines: DataFrame, references: DataFrame, line: str, ref: str, text_col: str = "text") -> DataFrame:
    """(line, ocr_text, ref, ref_text, similarity): each line's most similar reference line by block ratio; the first on ties. The
    references go to the lines where their counted size allows, else both are paired in the shuffle."""
    a = lines.select(line, F.col(text_col).alias("ocr_text")).filter("ocr_text is not null")
    b = references.select(ref, F.col(text_col).alias("ref_text")).filter("ref_text is not null")
    if b.count() > 20_000:
        pairs = a.crossJoin(b).withColumn("similarity", T.block_ratio("ocr_text", "ref_text"))
        best = pairs.groupBy(line, "ocr_text").agg(F.min_by(F.struct(ref, "ref_text", "similarity"), F.struct(-F.col("similarity"), ref)).alias("b"))
        return best.select(line, "ocr_text", f"b.{ref}", "b.ref_text", "b.similarity")
    rows = b.orderBy(ref, "ref_text").collect()
    texts = [r.ref_text for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = BlockIndex(texts)
        for x in batches:
            at, top = index.best(x.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(at, pa.int32()), pa.array(top, pa.float64())], [line, "ocr_text", "at", "similarity"])

    shape = StructType([*a.schema.fields, StructField("at", IntegerType()), StructField("similarity", DoubleType())])
    found = spread(a, "ocr_text").mapInArrow(run, shape)
    place = lines.sparkSession.createDataFrame([(i, r[ref], r.ref_text) for i, r in enumerate(rows)], StructType([StructField("at", IntegerType()), *b.schema.fields]))
    return found.join(F.broadcast(place), "at").select(line, "ocr_text", ref, "ref_text", "similarity")


def words_before(pages: DataFrame, edition: str, order: str, text_col: str = "text") -> DataFrame:
    """(edition, page, words, words_before): running total of the words of the pages before."""
    w = Window.partitionBy(edition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.select(edition, order, F.size(F.filter(F.split(F.trim(F.regexp_replace(text_col, T.BLANK + "+", " ")), " "), lambda x: x != "")).cast("long").alias("words"))
    return rows.withColumn("words_before", F.coalesce(F.sum("words").over(w), F.lit(0)))


def side_by_side(aligned: DataFrame, width: int = 55) -> DataFrame:
    """``aligned`` with a column of both lines in columns of fixed width."""
    def cell(c: str) -> Column:
        return F.rpad(F.coalesce(F.col(c), F.lit("")), width, " ")

    return aligned.withColumn("side_by_side", F.concat(cell("ocr_line"), F.lit(" | "), cell("ref_line")))
