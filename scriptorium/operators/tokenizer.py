"""Reading and judging byte-pair tokenizers: merges, vocabulary, compression, merge frequencies, the size where gains end.

Tokenizers come from files; none is trained here. A smaller tokenizer of the same kind is the first merges of a larger one: a merge never needs a
later one, so that applying the first n merges in order gives what a tokenizer of n merges gives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.runtime import Cut, broadcast_if, spread

#: The cut of texts before merging, as byte-level tokenizers make it.
PIECE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^" + T.BLANK[1:-1] + r"\p{L}\p{N}]+|" + T.BLANK + "+(?!" + T.BLANK.replace("[", "[^", 1) + ")|" + T.BLANK + "+"
#: A public byte-level tokenizer file on this machine; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def vocabulary_table(files: DataFrame) -> DataFrame:
    """(name, token, id) of tokenizer files (name, value: JSON)."""
    v = F.from_json(F.get_json_object("value", "$.model.vocab"), "map<string,int>")
    return files.select("name", F.explode(v).alias("token", "id"))


def merge_table(files: DataFrame) -> DataFrame:
    """(name, rank, left, right) in the order of merging; pairs may be arrays or two words in one string."""
    raw = F.get_json_object("value", "$.model.merges")
    pairs = F.from_json(raw, "array<array<string>>")
    texts = F.transform(F.from_json(raw, "array<string>"), lambda s: F.split(s, " ", 2))
    both = F.when(F.substring(F.get_json_object("value", "$.model.merges[0]"), 1, 1) == "[", pairs).otherwise(texts)
    return files.select("name", F.posexplode(both).alias("rank", "p")).select("name", "rank", F.col("p")[0].alias("left"), F.col("p")[1].alias("right"))


def with_end(ids: Column, end: int) -> Column:
    """Ids with the end token appended."""
    return F.concat(ids, F.array(F.lit(end)))


def compression_ratio(encoded: DataFrame, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """One row: characters, tokens, characters per token."""
    one = encoded.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.size(ids_col)), F.lit(0)).alias("tokens"))
    return one.withColumn("compression_ratio", F.col("chars") / F.greatest("tokens", F.lit(1)))


def merge_frequencies(merges: DataFrame, texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(rank, token, n): how often each merged token occurs in the texts, without overlap.

    A token without blanks lies within one run of other characters: those are counted for each distinct run, not for each text. The few
    tokens with blanks are counted in the texts. The merges (rank, left, right) are a tokenizer's: few, and held against the broadcast bound.
    """
    m = merges.select("rank", F.concat("left", "right").alias("token"))
    size = m.agg(F.count("*").alias("n"), F.avg(F.octet_length("token")).alias("w")).first()
    runs = texts.select(F.explode(F.split(F.col(text_col), T.BLANK + "+")).alias("t")).filter("t <> ''").groupBy("t").agg(F.count("*").alias("times"))

    def counted(rows: DataFrame, own: DataFrame) -> DataFrame:
        times = ((F.length("t") - F.length(F.replace("t", F.col("token"), F.lit("")))) / F.length("token")).cast("long") * F.col("times")
        hits = spread(rows, "t").join(broadcast_if(own, size.n, 24 + (size.w or 0)), F.contains("t", "token"))
        return hits.groupBy("rank", "token").agg(F.sum(times).alias("n"))

    blank = F.col("token").rlike(T.BLANK)
    found = counted(runs, m.filter(~blank)).unionByName(counted(texts.select(F.col(text_col).alias("t"), F.lit(1).alias("times")), m.filter(blank)))
    return m.join(found, ["rank", "token"], "left").select("rank", "token", F.coalesce("n", F.lit(0)).alias("n"))


def rare_merges(frequencies: DataFrame, under: int = 10) -> DataFrame:
    return frequencies.filter(F.col("n") < under)


def top_merges(frequencies: DataFrame, most: int = 10) -> DataFrame:
    """(side, place, token, n): the ``most`` most frequent merges and the ``most`` least frequent ones, the report's two lists."""
    up = frequencies.orderBy(F.desc("n"), "rank").limit(most).select(F.lit("top").alias("side"), "rank", "token", "n")
    low = frequencies.orderBy("n", F.desc("rank")).limit(most).select(F.lit("bottom").alias("side"), "rank", "token", "n")
    key = F.when(F.col("side") == "top", -F.col("n")).otherwise(F.col("n"))
    place = F.row_number().over(Window.partitionBy("side").orderBy(key, F.when(F.col("side") == "top", F.col("rank")).otherwise(-F.col("rank"))))
    return up.unionByName(low).select("side", place.alias("place"), "token", "n")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level tokenizer files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(rest)}}


_LETTERS = byte_letters()


def as_hex(token: str) -> str:
    """A byte-level token as upper-case hexadecimal bytes."""
    return "".join(f"{_LETTERS[c]:02X}" for c in token)


def pieces(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(piece, n): the distinct pieces of the texts, each text with a blank put before it where it has none."""
    t = F.col(text_col)
    led = F.when((t == "") | t.startswith(" "), t).otherwise(F.concat(F.lit(" "), t))
    return texts.select(F.explode(F.regexp_extract_all(led, F.lit(PIECE), F.lit(0))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def symbols(piece: Column) -> Column:
    """Every byte of a piece as a symbol: "<61><62>"."""
    return F.regexp_replace(F.hex(piece), "(..)", "<$1>")


def _rules(pairs: list[tuple[str, str]]) -> Column:
    """A constant array of replacements, sent as one text."""
    return F.from_json(F.lit(json.dumps([{"find": a, "put": b} for a, b in pairs])), "array<struct<find:string,put:string>>")


def merged(syms: Column, merges: list[tuple[str, str]]) -> Column:
    """Symbols after these merges of hexadecimal tokens, each wherever it applies, from the left."""
    if not merges:
        return syms
    rules = _rules([(f"<{a}><{b}>", f"<{a}{b}>") for a, b in merges])
    return F.aggregate(rules, syms, lambda s, r: F.replace(s, r["find"], r["put"]))


def hex_merges(merges: DataFrame, count: int) -> list[tuple[str, str]]:
    """The first ``count`` merges (rank, left, right) of a byte-level tokenizer, in order."""
    rows = merges.filter(F.col("rank") < count).select("rank", "left", "right").orderBy("rank").collect()
    return [(as_hex(r.left), as_hex(r.right)) for r in rows]


def encoded(texts: DataFrame, merges: DataFrame, count: int, text_col: str = "text", name: str = "tokens") -> DataFrame:
    """``texts`` with ``name``: the tokens (hexadecimal bytes) of each text by the first ``count`` merges. Meant for small vocabularies."""
    t = F.col(text_col)
    led = F.when((t == "") | t.startswith(" "), t).otherwise(F.concat(F.lit(" "), t))
    rules = hex_merges(merges, count)
    each = F.transform(F.regexp_extract_all(led, F.lit(PIECE), F.lit(0)), lambda p: F.regexp_extract_all(merged(symbols(p), rules), F.lit("<([0-9A-F]+)>"), F.lit(1)))
    return texts.withColumn(name, F.flatten(each))


def _counter(rules: list[tuple[str, str]], counts: list[int]):
    """(i, c): how many symbols pieces (piece, n) have together, each n times, after the first ``counts[i]`` merges: a row for each part. Each merge is applied to the symbols of all pieces of a part at once, wherever it applies, from the left."""
    number = {f"{b:02X}": b for b in range(256)}
    steps = [tuple(number.setdefault(x, len(number)) for x in (a, b, a + b)) for a, b in rules]  # a token that two pairs make has one number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _PIECES):
                part = batch.slice(lo, _PIECES)
                data = [x.encode() for x in part.column("piece").to_pylist()]
                n = part.column("n").to_numpy()
                s = np.frombuffer(b"".join(x + b"\0" for x in data), dtype=np.uint8).astype(np.int32)
                lens = np.array([len(x) for x in data], dtype=np.int64)
                s[np.cumsum(lens + 1) - 1] = -1  # between pieces nothing merges
                weight = np.repeat(n, lens + 1)
                weight[s < 0] = 0
                done, sums = 0, []
                for k in counts:
                    for a, b, new in steps[done:k]:
                        at = np.flatnonzero((s[:-1] == a) & (s[1:] == b))
                        if not len(at):
                            continue
                        if a == b:  # of a run of overlapping pairs, every second one from its first
                            first = np.concatenate(([True], at[1:] != at[:-1] + 1))
                            at = at[(np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]) % 2 == 0]
                        s[at] = new
                        keep = np.ones(len(s), dtype=bool)
                        keep[at + 1] = False
                        s, weight = s[keep], weight[keep]
                    done = max(done, k)
                    sums.append(int(weight.sum()))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(counts)), pa.int32()), pa.array(sums, pa.int64())], ["i", "c"])

    return run


#: Pieces whose symbols are merged at once.
_PIECES = 20_000


def size_sweep(texts: DataFrame, merges: DataFrame, sizes: tuple[int, ...] = (50, 100, 150, 200, 250, 300), specials: int = 4, alphabet: int | None = None, end: bool = True, text_col: str = "text") -> DataFrame:
    """(vocab_size_requested, vocab_size_actual, chars, tokens, compression_ratio) for every size: the specials, the alphabet (that of the
    texts, or ``alphabet`` symbols) and as many of the first merges as then fit. With ``end`` every text has one more token.

    Texts are cut and counted once; merges are applied to distinct pieces alone, each size going on from the one before.
    """
    sizes = tuple(sorted(set(sizes)))
    seen = Cut(pieces(texts, text_col), "pieces")
    if alphabet is None:
        alphabet = seen.df.select(F.explode(F.regexp_extract_all(F.hex("piece"), F.lit(".."), F.lit(0))).alias("b")).distinct().count()
    rules = hex_merges(merges, max(0, sizes[-1] - specials - alphabet))
    counts = [min(len(rules), max(0, s - specials - alphabet)) for s in sizes]
    rows = spread(seen.df, "piece").mapInArrow(_counter(rules, counts), "i int, c long")
    sums = rows.agg(*(F.coalesce(F.sum(F.when(F.col("i") == i, F.col("c"))), F.lit(0)).alias(f"t{i}") for i in range(len(sizes))))
    whole = texts.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars"), F.count(text_col).alias("texts"))
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("size"), F.lit(specials + alphabet + k).alias("actual"), F.col(f"t{i}").alias("t")) for i, (s, k) in enumerate(zip(sizes, counts, strict=True)))))
    out = sums.crossJoin(F.broadcast(whole)).select("chars", "texts", each.alias("e"))  # one row each
    out = out.select(F.col("e.size").alias("vocab_size_requested"), F.col("e.actual").alias("vocab_size_actual"), "chars", (F.col("e.t") + (F.col("texts") if end else F.lit(0))).alias("tokens"))
    return out.withColumn("compression_ratio", F.col("chars") / F.greatest("tokens", F.lit(1)))


def size_elbow(sweep: DataFrame, least: float = 0.02) -> DataFrame:
    """One row, the vocabulary size before the first step whose compression gains under ``least`` though the vocabulary grows; else the last.

    ``sweep`` has (vocab_size_requested, vocab_size_actual, compression_ratio), a row for each size tried."""
    w = Window.orderBy("vocab_size_requested")  # a few rows
    rows = sweep.withColumns({"before": F.lag("vocab_size_requested").over(w), "grown": F.col("vocab_size_actual") - F.lag("vocab_size_actual").over(w), "gain": F.col("compression_ratio") - F.lag("compression_ratio").over(w)})
    flat = F.min(F.when((F.col("grown") > 0) & (F.col("gain") < least), F.struct("vocab_size_requested", "before")))
    return rows.agg(F.coalesce(flat["before"], F.max("vocab_size_requested")).alias("vocab_size"))


def growth(sweep: DataFrame) -> DataFrame:
    """``sweep`` with the gain of each step in vocabulary and in compression."""
    w = Window.orderBy("vocab_size_requested")
    return sweep.withColumns({"vocab_gain": F.col("vocab_size_actual") - F.lag("vocab_size_actual").over(w), "compression_gain": F.col("compression_ratio") - F.lag("compression_ratio").over(w)})


