"""Text expressions; all are built-in column expressions unless said otherwise.

Character classes are spelled out because engines disagree on ``\\w`` and ``\\s``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

WORD = r"[\p{L}\p{N}_]+"
BLANK = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _plain_map() -> tuple[str, str]:
    """Accented Latin letters that are one base letter once their marks are gone."""
    pairs = []
    for c in map(chr, [*range(0x80, 0x250), *range(0x1E00, 0x1F00)]):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


PLAIN = _plain_map()


def words(text: Column) -> Column:
    """Lower-cased words, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def letters_only(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^\p{L}]", ""))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]+>", "")


def strip_notes(text: Column) -> Column:
    """Drops bracketed editorial notes that stay on one line."""
    return F.regexp_replace(text, r"\[[^\n]*?\]", "")


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANK + "+", " "))


def strip_diacritics(text: Column) -> Column:
    """Base letters of Latin text: mapped letters, then all remaining non-spacing marks dropped."""
    return F.regexp_replace(F.translate(text, *PLAIN), r"\p{Mn}", "")


def plain_text(text: Column) -> Column:
    """Joins words hyphenated over a line end, lower-cases, strips marks, keeps a-z and 0-9, single blanks."""
    joined = F.lower(F.regexp_replace(text, f"-{BLANK}*\n{BLANK}*", ""))
    return F.trim(F.regexp_replace(strip_diacritics(joined), "[^a-z0-9]+", " "))


def plain_words(text: Column) -> Column:
    return F.array_remove(F.split(plain_text(text), " "), "")


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Set of the substrings of ``n`` characters. Shifted character arrays are zipped, which is linear in the text."""
    chars = F.split(text, "")
    out = chars
    for k in range(1, n):
        out = F.zip_with(out, F.slice(chars, k + 1, F.greatest(F.length(text), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(out, lambda g: F.length(g) == n))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets held as arrays; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def length_aware_threshold(word: Column, base: float) -> Column:
    """None up to four letters, stricter by 10 (100 at most) for five, else ``base``."""
    n = F.length(word)
    return F.when(n <= 4, F.lit(None).cast("double")).when(n == 5, F.lit(float(min(base + 10, 100)))).otherwise(F.lit(float(base)))


def first_slices(text: Column, size: int = 500, most: int = 10) -> Column:
    """A validation sample: the first ``most`` slices of ``size`` characters."""
    return slices(F.substring(text, 1, size * most), size)


def slices(text: Column, size: int = 500) -> Column:
    """All slices of ``size`` characters, in one pass over the text; null of null."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def page_file_name(name: Column, padding: int = 2) -> Column:
    """Pads leading digits to ``padding``, drops blanks, and joins by underscores."""
    digits = F.length(F.regexp_extract(name, r"^([0-9]+)", 1))
    padded = F.when((digits > 0) & (digits < padding), F.concat(F.repeat(F.lit("0"), F.lit(padding) - digits), name)).otherwise(name)
    return F.replace(F.replace(F.replace(padded, F.lit(" "), F.lit("")), F.lit("-"), F.lit("_")), F.lit("f."), F.lit("f_"))


def posix_path(path: Column) -> Column:
    """A path with single slashes, without "." steps and without a slash at the end; the empty path is "."."""
    steps = F.filter(F.split(path, "/+"), lambda x: (x != "") & (x != "."))
    root = F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    out = F.concat(root, F.array_join(steps, "/"))
    return F.when(out == "", F.lit(".")).otherwise(out)


def output_path(name: Column, folder: Column, padding: int = 2, suffix: str = "json") -> Column:
    """struct path, filename, page of what a page's segmentation is written to."""
    page = page_file_name(name, padding)
    file = F.concat(page, F.lit(f".{suffix}"))
    return F.struct(F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), file).alias("path"), file.alias("filename"), page.alias("page"))


def line_index(stem: Column) -> Column:
    """Number after the last underscore, or null."""
    return F.substring_index(stem, "_", -1).try_cast("int")


def natural_key(name: Column, width: int = 12) -> Column:
    """Sort key that orders digit runs as numbers and letters without case: digit runs are zero-padded to ``width``."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]") & (F.length(p) < width), F.lpad(p, width, "0")).otherwise(p)), "")


def text_pad(text: Column, width: int = 55) -> Column:
    return F.rpad(text, width, " ")


@F.arrow_udf(DoubleType())
def block_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratcliff-Obershelp ratio of two strings: 2 * matching characters / all characters, by longest common blocks."""
    from scriptorium.functions.blocks import block_ratios

    return pa.array(block_ratios(a.to_pylist(), b.to_pylist()), pa.float64())


@F.arrow_udf(StringType())
def shown(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A character as it is written in source code, quotes included."""
    for p in parts:
        yield pa.array([None if x is None else repr(x) for x in p.to_pylist()], pa.string())
