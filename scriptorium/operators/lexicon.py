"""Scoring transcriptions against a lexicon: vocabulary, exact and length-aware fuzzy matches, what is left over.

Lexicons have columns (position long, headword string, variants array<string>).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from scriptorium.functions import text as T
from scriptorium.functions.geometry import share
from scriptorium.functions.similarity import Forms
from scriptorium.runtime import Cut, spread

#: Forms that one pass of the fuzzy search holds in each task; larger lexicons are searched in so many parts.
FORMS = 50_000


def token_frequency(pages: DataFrame, text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """(word, n): every lower-cased word and how often it occurs; with ``order_col`` also ``first``, where it occurs first. Places in pages that
    are numbered are one number, whose minimum a hash aggregate can keep; others are structs, which have to be sorted."""
    if order_col is None:
        return pages.select(F.explode(T.words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    rows = pages.select(F.col(order_col).alias("page"), F.posexplode(T.words(F.col(text_col))).alias("pos", "word"))
    numbered = pages.schema[order_col].dataType.typeName() in ("byte", "short", "integer", "long")
    place = (F.col("page").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("pos")).cast("decimal(38,0)") if numbered else F.struct("page", "pos")
    return rows.select("word", place.alias("place")).groupBy("word").agg(F.count("*").alias("n"), F.min("place").alias("first"))


def all_norms(freq: DataFrame) -> DataFrame:
    """(norm, original, n): words merged by their letters. Of several originals the one that occurs first stands for all; the least, where
    ``freq`` doesn't say where words occur."""
    original = F.min_by("word", "first") if "first" in freq.columns else F.min("word")
    return freq.withColumn("norm", T.letters_only(F.col("word"))).filter("norm <> ''").groupBy("norm").agg(original.alias("original"), F.sum("n").alias("n"))


def vocabulary(freq: DataFrame, min_length: int = 2) -> DataFrame:
    return all_norms(freq).filter(F.length("norm") >= min_length)


def dropped_short(freq: DataFrame, min_length: int = 2) -> DataFrame:
    """One row: tokens whose word has some letters, but too few. Words without letters aren't counted."""
    return all_norms(freq).agg(F.coalesce(F.sum(F.when(F.length("norm") < min_length, F.col("n"))), F.lit(0)).alias("dropped_short_tokens"))


def lexicon_forms(lexicon: DataFrame) -> DataFrame:
    """(form, headword): headwords go before variants; of headwords the last wins, of variants the first."""
    heads = lexicon.select(T.letters_only(F.lower("headword")).alias("form"), F.lower("headword").alias("headword"), F.lit(0).alias("kind"), (-F.col("position")).alias("a"), F.lit(0).alias("b"))
    variants = lexicon.select("position", "headword", F.posexplode("variants").alias("at", "variant")).select(T.letters_only(F.lower("variant")).alias("form"), F.lower("headword").alias("headword"), F.lit(1).alias("kind"), F.col("position").alias("a"), F.col("at").alias("b"))
    return heads.union(variants).filter("form <> ''").groupBy("form").agg(F.min_by("headword", F.struct("kind", "a", "b")).alias("headword"))


def exact_matches(vocab: DataFrame, forms: DataFrame) -> DataFrame:
    return vocab.join(forms, vocab["norm"] == forms["form"], "left_semi")


def unknown_words(vocab: DataFrame, forms: DataFrame) -> DataFrame:
    return vocab.join(forms, vocab["norm"] == forms["form"], "left_anti")


def _searched(unknown: DataFrame, forms: list[str], least: Column) -> DataFrame:
    index = Forms(forms)
    rows = unknown.withColumn("_least", least).filter("_least is not null")
    names, kinds = unknown.columns, unknown.schema.fields
    norm = names.index("norm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(norm).to_pylist()
            if words:
                at, score = index.best(words, b.column(len(names)).to_numpy().astype(np.float64))
                hit = np.flatnonzero(at >= 0)
                own = b.take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([*own.columns[: len(names)], pa.array([index.forms[i] for i in at[hit]], pa.string()), pa.array(score[hit])], [*names, "matched_form", "fuzzy_score"])

    return spread(rows, "norm").mapInArrow(run, StructType([*kinds, StructField("matched_form", StringType()), StructField("fuzzy_score", DoubleType())]))


def best_forms(unknown: DataFrame, forms: DataFrame, least: Column) -> DataFrame:
    """``unknown`` (norm, ...) with matched_form and fuzzy_score: the most similar form of each word whose ratio is at least ``least``; the smallest
    form on ties. Words and what belongs to them pass the search once; the forms go to them in parts of a checked size, each part a pass over the words."""
    count = forms.count()
    if count <= FORMS:
        return _searched(unknown, [r.form for r in forms.select("form").collect()], least)
    parts = -(-count // FORMS)
    unknown = Cut(unknown, "words").df  # each part reads it
    slot = F.pmod(F.xxhash64("form"), F.lit(parts))
    found = None
    for i in range(parts):
        some = _searched(unknown, [r.form for r in forms.filter(slot == i).select("form").collect()], least)
        found = some if found is None else found.union(some)
    others = [F.first(c).alias(c) for c in unknown.columns if c != "norm"]
    return found.groupBy("norm").agg(*others, F.min_by("matched_form", F.struct(-F.col("fuzzy_score"), "matched_form")).alias("matched_form"), F.max("fuzzy_score").alias("fuzzy_score"))


def fuzzy_candidates(unknown: DataFrame, forms: DataFrame, threshold: float = 82.0) -> DataFrame:
    """Unknown words whose best form reaches the threshold for their length, with the headword it suggests."""
    used = T.length_aware_threshold(F.col("norm"), threshold)
    out = best_forms(unknown.select("norm", "original", "n"), forms, used).join(forms, F.col("matched_form") == F.col("form"), "left")
    return out.select(F.col("original").alias("ocr_original"), F.col("norm").alias("ocr_normalized"), F.col("n").alias("frequency"), "matched_form", F.coalesce("headword", "matched_form").alias("suggested_headword"), "fuzzy_score", F.length("norm").alias("word_length"), used.alias("threshold_used"))


def unmatched(unknown: DataFrame, candidates: DataFrame) -> DataFrame:
    """Unknown words that matched nothing, most frequent first."""
    left = unknown.join(candidates, unknown["norm"] == candidates["ocr_normalized"], "left_anti")
    return left.select(F.col("original").alias("ocr_original"), F.col("norm").alias("ocr_normalized"), F.col("n").alias("frequency")).orderBy(F.desc("frequency"), "ocr_normalized")


def exact_metrics(freq: DataFrame, forms: DataFrame, min_length: int = 2) -> DataFrame:
    """One row of counts and accuracies by exact matches alone."""
    known = F.col("form").isNotNull()
    rows = all_norms(freq).join(forms.select("form"), F.col("norm") == F.col("form"), "left")
    long = F.length("norm") >= min_length
    one = rows.agg(
        F.count_if(long).alias("total_unique_words"),
        F.coalesce(F.sum(F.when(long, F.col("n"))), F.lit(0)).alias("total_tokens"),
        F.count_if(long & known).alias("known_words_exact"),
        F.coalesce(F.sum(F.when(long & known, F.col("n"))), F.lit(0)).alias("known_tokens_exact"),
        F.coalesce(F.sum(F.when(~long, F.col("n"))), F.lit(0)).alias("dropped_short_tokens"),
    )
    return one.withColumns({"word_accuracy_exact": share(F.col("known_words_exact"), F.col("total_unique_words")), "token_accuracy_exact": share(F.col("known_tokens_exact"), F.col("total_tokens"))})


def dictionary_metrics(freq: DataFrame, forms: DataFrame, threshold: float = 82.0, min_length: int = 2) -> DataFrame:
    """One row of all eleven measures: exact and fuzzy accuracies, words and tokens known, near-known and unknown."""
    unknown = unknown_words(vocabulary(freq, min_length), forms)
    fuzzy = fuzzy_candidates(unknown, forms, threshold).agg(F.count("*").alias("fuzzy_match_words"), F.coalesce(F.sum("frequency"), F.lit(0)).alias("fuzzy_tokens"))
    every = exact_metrics(freq, forms, min_length).crossJoin(fuzzy)
    words, tokens = F.col("total_unique_words"), F.col("total_tokens")
    known_w, known_t = F.col("known_words_exact") + F.col("fuzzy_match_words"), F.col("known_tokens_exact") + F.col("fuzzy_tokens")
    return every.select("word_accuracy_exact", "token_accuracy_exact", share(known_w, words).alias("word_accuracy_with_fuzzy"), share(known_t, tokens).alias("token_accuracy_with_fuzzy"), "total_unique_words", "total_tokens", "known_words_exact", "fuzzy_match_words", (words - known_w).alias("oov_words"), (tokens - known_t).alias("oov_tokens"), "dropped_short_tokens")


def fuzzy_scores(unknown: DataFrame, forms: DataFrame, least: float = 0.0) -> DataFrame:
    """(norm, n, matched_form, fuzzy_score) of unknown words over four letters whose best ratio is at least ``least``: by default all of
    them. Histogram and rank curve need every best score; coverage from a threshold on needs those that reach it."""
    found = best_forms(unknown.select("norm", "n"), forms, F.when(F.length("norm") > 4, F.lit(least)))
    return found.select("norm", "n", "matched_form", "fuzzy_score")


def coverage_by_threshold(scores: DataFrame, low: int = 60, high: int = 100) -> DataFrame:
    """(threshold, accepted): how many scored words each threshold from ``low`` to ``high`` would accept."""
    steps = scores.select(F.least(F.floor("fuzzy_score"), F.lit(high)).cast("int").alias("threshold")).groupBy("threshold").agg(F.count("*").alias("at"))
    every = scores.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("threshold")).join(F.broadcast(steps), "threshold", "left")
    down = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)  # 41 rows
    return every.select("threshold", F.coalesce(F.sum("at").over(down), F.lit(0)).alias("accepted"))


def score_histogram(scores: DataFrame, bins: int = 25) -> DataFrame:
    """(bin, low, high, words): equal bins from the least score to the greatest; the last holds its upper bound. Scores that are all equal
    lie in bins around them, one wide together. Words of one score are counted first, so that the bounds need no second pass over words."""
    by = scores.groupBy("fuzzy_score").agg(F.count("*").alias("words"))
    ends = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # distinct scores only
    least, most = F.min("fuzzy_score").over(ends), F.max("fuzzy_score").over(ends)
    same = F.when(least == most, F.lit(0.5)).otherwise(F.lit(0.0))
    rows = by.select("words", "fuzzy_score", (least - same).alias("from"), ((most + same - least + same) / bins).alias("width"))
    b = F.least(F.floor((F.col("fuzzy_score") - F.col("from")) / F.col("width")).cast("int"), F.lit(bins - 1))
    low = F.col("from") + F.col("bin") * F.col("width")
    out = rows.groupBy(b.alias("bin"), "from", "width").agg(F.sum("words").alias("words"))
    return out.select("bin", low.alias("low"), (low + F.col("width")).alias("high"), "words")


def score_rank(scores: DataFrame) -> DataFrame:
    """(score, words, first_rank, last_rank): the rank curve of scores, highest first. Words of one score share a row, so that the window
    sees each distinct score once, whatever the number of words."""
    by = scores.groupBy("fuzzy_score").agg(F.count("*").alias("words"))
    upto = F.sum("words").over(Window.orderBy(F.desc("fuzzy_score")).rowsBetween(Window.unboundedPreceding, 0))
    return by.select(F.col("fuzzy_score").alias("score"), "words", (upto - F.col("words") + 1).alias("first_rank"), upto.alias("last_rank"))
