import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from scriptorium.functions.similarity import Forms, lcs, ratio
from scriptorium.operators import lexicon

TEXTS = ["Lo reis a fach lo castel 12 vetz", "lo REI e la regina 3a a1 _ x", None, "", "castell castels regina reginas reis1 reis"]
LEX = [(0, "Rei", ["reis", "castel"]), (1, "castel", None), (2, "regina", ["reginas", "reis", "7"]), (3, "REI", ["lo"]), (4, "99", ["fach"])]


def letters(w):
    return "".join(c for c in w.lower() if c.isalpha())


def brute_forms():
    heads = {}
    forms = {}
    for _, h, vs in LEX:
        n = letters(h)
        if n:
            forms[n] = h.lower()
            heads[n] = 1
        for v in vs or []:
            if letters(v):
                forms.setdefault(letters(v), h.lower())
    return forms


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def frames(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc long, text string")
    lex = spark.createDataFrame(LEX, "position long, headword string, variants array<string>")
    return lexicon.token_frequency(docs, order_col="doc"), lexicon.lexicon_forms(lex)


def vocab():
    words = [w for t in TEXTS for w in re.findall(r"\b\w+\b", (t or "").lower())]
    out = {}
    for w, n in Counter(words).items():
        if letters(w):
            out.setdefault(letters(w), [w, 0])[1] += n
    return out


def test_vocabulary_keeps_the_first_original(frames):
    got = {r.norm: [r.original, r.n] for r in lexicon.vocabulary(frames[0]).collect()}
    assert got == {k: v for k, v in vocab().items() if len(k) >= 2}
    assert lexicon.dropped_short(frames[0]).first()[0] == sum(v[1] for k, v in vocab().items() if len(k) < 2)


def test_forms(frames):
    assert {r.form: r.headword for r in frames[1].collect()} == brute_forms()


def brute_fuzzy(words, forms, base=82):
    out = {}
    for w in words:
        t = None if len(w) <= 4 else min(base + 10, 100) if len(w) == 5 else base
        if t is None:
            continue
        best = max(sorted(forms), key=lambda f: 200 * plain_lcs(w, f) / (len(w) + len(f)))
        s = 200 * plain_lcs(w, best) / (len(w) + len(best))
        if s >= t:
            out[w] = (best, s, t)
    return out


def test_fuzzy_and_metrics_equal_brute_force(spark, frames):
    freq, forms = frames
    v = {k: x for k, x in vocab().items() if len(k) >= 2}
    unknown = {k for k in v if k not in brute_forms()}
    want = brute_fuzzy(unknown, brute_forms())
    df = lexicon.unknown_words(lexicon.vocabulary(freq), forms)
    got = lexicon.fuzzy_candidates(df, forms)
    rows = {r.ocr_normalized: (r.matched_form, r.fuzzy_score, r.threshold_used) for r in got.collect()}
    assert rows == want and "castell" in rows
    assert all(r.suggested_headword == brute_forms()[r.matched_form] and r.word_length == len(r.ocr_normalized) for r in got.collect())
    m = lexicon.dictionary_metrics(freq, forms).first().asDict()
    known = [k for k in v if k in brute_forms()]
    tokens = sum(x[1] for x in v.values())
    assert m["total_unique_words"] == len(v) and m["total_tokens"] == tokens and m["known_words_exact"] == len(known)
    assert m["word_accuracy_with_fuzzy"] == (len(known) + len(want)) / len(v)
    assert m["oov_words"] == len(unknown) - len(want) and m["oov_tokens"] == sum(v[k][1] for k in unknown - set(want))
    assert len(m) == 11
    left = [(r.ocr_normalized, r.frequency) for r in lexicon.unmatched(df, got).collect()]
    assert left == sorted(((k, v[k][1]) for k in unknown - set(want)), key=lambda x: (-x[1], x[0]))


def test_a_large_lexicon_goes_in_parts(spark, frames, monkeypatch):
    freq, forms = frames
    df = lexicon.unknown_words(lexicon.vocabulary(freq), forms)
    whole = sorted(map(str, lexicon.fuzzy_candidates(df, forms, 60).collect()))
    monkeypatch.setattr(lexicon, "FORMS", 2)
    assert sorted(map(str, lexicon.fuzzy_candidates(df, forms, 60).collect())) == whole


def test_search_equals_brute_force_on_many_words():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 14)))
    forms = sorted({word() for _ in range(300)} | {"ab" * 40, "ab" * 40 + "c"})
    words = [word() for _ in range(400)] + ["ba" * 39, "zzzz"]
    least = np.array([r.choice([0.0, 60.0, 82.0]) for _ in words])
    at, score = Forms(forms).best(words, least)
    for w, t, i, s in zip(words, least, at, score):
        best = max(forms, key=lambda f: 200 * plain_lcs(w, f) / (len(w) + len(f)))
        top = 200 * plain_lcs(w, best) / (len(w) + len(best))
        assert (i, s) == (-1, -1.0) if top < t else (forms[i] == best and s == pytest.approx(top))


@given(st.text("abcü", max_size=80), st.text("abcü", max_size=80))
def test_lcs(a, b):
    assert lcs(a, b) == plain_lcs(a, b)
    assert ratio(a, b) == (100.0 if not a + b else 200.0 * plain_lcs(a, b) / len(a + b))


def test_published_examples():
    assert ratio("lequal", "eyqual") == pytest.approx(83.33, abs=0.01)


def test_curves(spark, frames):
    freq, forms = frames
    s = lexicon.fuzzy_scores(lexicon.unknown_words(lexicon.vocabulary(freq), forms), forms)
    scores = [r.fuzzy_score for r in s.collect()]
    assert {r.threshold: r.accepted for r in lexicon.coverage_by_threshold(s).collect()} == {t: sum(x >= t for x in scores) for t in range(60, 101)}
    rank = lexicon.score_rank(s).orderBy("first_rank").collect()
    assert list(itertools.chain(*([r.score] * r.words for r in rank))) == sorted(scores, reverse=True)
    assert sum(r.words for r in lexicon.score_histogram(s).collect()) == len(scores)


def test_curves_hold_every_best_score(spark):
    words = ["castell", "xxxxxx", "qqqqzzzz", "regnnaxx", "four", "xyzxyzo"]
    unknown = spark.createDataFrame([(w, 1) for w in words], "norm string, n long")
    forms = spark.createDataFrame([("castel", "castel"), ("regina", "regina"), ("lo", "lo")], "form string, headword string")
    every = sorted((max(200 * plain_lcs(w, f) / (len(w) + len(f)) for f in ("castel", "regina", "lo")) for w in words if len(w) > 4), reverse=True)
    assert min(every) < 60
    s = lexicon.fuzzy_scores(unknown, forms)
    rank = lexicon.score_rank(s).orderBy("first_rank").collect()
    assert [r.score for r in rank for _ in range(r.words)] == pytest.approx(every)
    counts, edges = np.histogram(every, bins=25)
    bins = {r.bin: r for r in lexicon.score_histogram(s).collect()}
    assert [bins[i].words if i in bins else 0 for i in range(25)] == counts.tolist()
    assert all(r.low == pytest.approx(edges[i]) and r.high == pytest.approx(edges[i + 1]) for i, r in bins.items())
    one = lexicon.score_histogram(s.filter("norm = 'castell'")).collect()
    assert [r.words for r in one] == [1]
    assert lexicon.coverage_by_threshold(s).orderBy("threshold").collect() == lexicon.coverage_by_threshold(lexicon.fuzzy_scores(unknown, forms, 60.0)).orderBy("threshold").collect()


def test_empty_corpus(spark, frames):
    empty = lexicon.token_frequency(spark.createDataFrame([], "text string"))
    m = lexicon.dictionary_metrics(empty, frames[1]).first()
    assert m.total_tokens == 0 and m.word_accuracy_exact == 0 and m.oov_words == 0


def test_scores_pass_the_search_once(spark, frames):
    """Words and their counts go through the search together: no join back to the words, whose making would be run twice."""
    from scriptorium import catalog

    for name in ("fuzzy_scores", "score_rank", "score_histogram", "coverage_by_threshold", "fuzzy_candidates"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [doc_id#") == 1, name


def test_long_words_and_long_forms(spark):
    import numpy as np

    from scriptorium.functions import similarity

    words, forms = ["a" * 300, "ab" * 150, "b" * 40, "xyz"], ["a" * 290, "ab" * 140, "b" * 41, "a"]
    for some in (forms, forms[2:]):
        at, score = similarity.Forms(some).best(words, np.zeros(4))
        got = [(sorted(set(some))[i], s) for i, s in zip(at, score, strict=True)]
        assert got == [min(((f, similarity.ratio(w, f)) for f in some), key=lambda x: (-x[1], x[0])) for w in words]
