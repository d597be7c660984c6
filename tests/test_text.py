import math

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'int'}" for k, v in values.items()))
    return row.select(col.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("Lo Rei d'Aragó, 2 vetz_x", ["lo", "rei", "d", "aragó", "2", "vetz_x"]), ("ẽ̃ a", ["ẽ", "a"]), ("", []), (None, None)])
def test_words(spark, text, want):
    assert one(spark, T.words(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("A1-b_ç", "abç"), ("123", ""), (None, None)])
def test_letters_only(spark, text, want):
    assert one(spark, T.letters_only(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("a <b\nc> d", "a  d"), ("<>", "<>"), ("x</p>", "x")])
def test_strip_tags(spark, text, want):
    assert one(spark, T.strip_tags(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("a [x] b [y] c", "a  b  c"), ("a [x\ny] b", "a [x\ny] b"), ("[]", "")])
def test_strip_notes(spark, text, want):
    assert one(spark, T.strip_notes(F.col("t")), t=text) == want


def test_blanks_and_marks(spark):
    assert one(spark, T.collapse_blanks(F.col("t")), t="  a  b\t\nc\x1d ") == "a b c"
    assert one(spark, T.strip_diacritics(F.col("t")), t="çàẽéǖ ỹ") == "caeeu y"


@pytest.mark.parametrize(("text", "want"), [("Ma-\n  nu scrít, Ú!", "manu scrit u"), ("a - b", "a b"), ("x-\ny-\nz", "xyz"), ("¡¿", ""), ("ß 12", "12")])
def test_plain_text_equals_its_python_form(spark, text, want):
    from scriptorium.operators.alignment import plain_words

    assert one(spark, T.plain_text(F.col("t")), t=text) == want
    assert one(spark, T.plain_words(F.col("t")), t=text) == plain_words(text)


def test_ngrams_and_jaccard(spark):
    assert sorted(one(spark, T.char_ngrams(F.col("t")), t="abcabc")) == ["abc", "bca", "cab"]
    assert one(spark, T.char_ngrams(F.col("t")), t="ab") == []
    j = T.jaccard(T.char_ngrams(F.col("a")), T.char_ngrams(F.col("b")))
    assert one(spark, j, a="abcd", b="bcde") == pytest.approx(1 / 3)
    assert one(spark, j, a="ab", b="bcde") == 0.0


@pytest.mark.parametrize(("word", "base", "want"), [("abcd", 82, None), ("abcde", 82, 92.0), ("abcde", 95, 100.0), ("abcdef", 82, 82.0)])
def test_threshold(spark, word, base, want):
    assert one(spark, T.length_aware_threshold(F.col("t"), base), t=word) == want


def test_chunks(spark):
    got = one(spark, T.first_slices(F.col("t")), t="x" * 5600)
    assert [len(c) for c in got] == [500] * 10
    assert one(spark, T.first_slices(F.col("t")), t="") == []
    assert [len(c) for c in one(spark, T.first_slices(F.col("t")), t="y" * 501)] == [500, 1]


@pytest.mark.parametrize(("name", "want"), [("8 - f. 003v", "08_f_003v"), ("15-f.1", "15_f_1"), ("123 x", "123x"), ("x 1", "x1")])
def test_page_file_name(spark, name, want):
    assert one(spark, T.page_file_name(F.col("t")), t=name) == want


def test_line_index_and_natural_order(spark):
    assert one(spark, T.line_index(F.col("t")), t="p_line_12") == 12
    assert one(spark, T.line_index(F.col("t")), t="p_line_x") is None
    df = spark.createDataFrame([("p10",), ("P2",), ("p1b",), ("p1",)], "t string")
    assert [r.t for r in df.orderBy(T.natural_key(F.col("t"))).collect()] == ["p1", "p1b", "P2", "p10"]


def test_block_ratio(spark):
    from difflib import SequenceMatcher

    assert one(spark, T.block_ratio("a", "b"), a="abcd", b="bcde") == SequenceMatcher(None, "abcd", "bcde").ratio()
    assert one(spark, T.block_ratio("a", "b"), a=None, b="x") is None and math.isclose(one(spark, T.block_ratio("a", "b"), a="", b=""), 1.0)


def test_whole_texts_are_cut_into_slices(spark):
    from scriptorium.operators import corpus

    texts = {1: "é\n😀x" * 3_001, 2: "", 3: None, 4: "a" * 500, 5: "\r\n" * 251, 6: "b" * 501}
    rows = corpus.chunk_text(spark.createDataFrame(list(texts.items()), "doc int, text string"), "doc").collect()
    assert sorted((r.doc, r.chunk, r.text) for r in rows) == [(k, i // 500, t[i : i + 500]) for k, t in texts.items() for i in range(0, len(t or ""), 500)]
    assert max(r.chunk for r in rows) == 24


def test_plain_text_is_cut_in_one_pass(spark):
    """Runs of all that is no letter or digit, blanks or not, are one blank; no expression looks ahead at every character."""
    df = spark.createDataFrame([(1, " É—  \t!á-\n b😀9\U0001d400z\x00_\x85"), (2, "—!—"), (3, ""), (4, None), (5, "x-　\n y")], "i int, t string")
    out = df.select("i", T.plain_text(F.col("t")).alias("p"), T.plain_words(F.col("t")).alias("w"))
    assert "(?!" not in out._jdf.queryExecution().toString() and "filter(" not in out._jdf.queryExecution().toString()
    assert {r.i: (r.p, r.w) for r in out.collect()} == {1: ("e ab 9 z", ["e", "ab", "9", "z"]), 2: ("", []), 3: ("", []), 4: (None, None), 5: ("xy", ["xy"])}
