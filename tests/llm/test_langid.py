import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm.kernels import mix, sampled
from scriptorium.llm.langid import BUCKETS, ORDERS, fit, identified, language_ids

SHAPE = "doc_id long, text string, lang string, language string, predicted_lang int"
WORDS = {"en": "the of and to in that is was he for it with as his on be at by had".split(), "es": "el la de que y en un ser se no haber por con su para como estar".split(), "ru": "и в не на я быть он с что а по это она этот к но они".split()}


def make(lang, seed, n=40):
    r = np.random.default_rng((seed, len(lang), ord(lang[0])))
    return " ".join(r.choice(WORDS[lang], n))


@pytest.fixture(scope="module")
def rows():
    return [(i, make(lang, i), lang, "x", 1) for i, lang in enumerate(["en", "es", "ru", "en"] * 60)]


def test_held_out_accuracy(spark, rows):
    model = fit(spark.createDataFrame(rows[:120], SHAPE))
    got = identified(spark.createDataFrame(rows[120:], SHAPE), model).collect()
    assert np.mean([r.predicted_lang == r.lang for r in got]) > 0.98


def buckets(text):
    cp = [ord(c) for c in text.lower()]
    out = []
    for i in range(len(cp)):
        h = 0
        for n in range(1, max(ORDERS) + 1):
            if i + n > len(cp):
                break
            h = (h * 0x9E3779B97F4A7C15 % 2**64) ^ cp[i + n - 1]
            out.append(int(mix(np.array([h], dtype=np.uint64), n)[0] >> np.uint64(48)))
    return out


def test_scores_equal_brute_force(spark, rows):
    model = fit(spark.createDataFrame(rows, SHAPE))
    assert model.langs == ["en", "es", "ru"]
    counts = np.zeros((3, BUCKETS))
    for _, text, lang, *_ in rows:
        np.add.at(counts[model.langs.index(lang)], buckets(text), 1)
    logp = np.log((counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True))
    assert np.allclose(model.logp, logp, atol=1e-4)
    some = ["the cat", "", "éл", "a"]
    got, n = model.scores(pa.array(some))
    want = np.array([model.prior + sum((logp[:, b] for b in buckets(t)), np.zeros(3)) for t in some])
    assert np.allclose(got, want, atol=1e-3) and n.tolist() == [len(buckets(t)) for t in some]


def test_nulls_empty_long_repeats_and_clashes(spark, rows):
    more = rows + [(900, None, "en", None, None), (901, "", None, None, None), (902, make("es", 1, 40_000), None, None, None), (None, make("ru", 2), None, None, None), rows[0]]
    df = spark.createDataFrame(more, SHAPE)
    got = language_ids(df).collect()
    assert len(got) == len(more)
    by = {r.doc_id: r for r in got}
    assert by[900].predicted_lang is None and by[901].confidence is None
    assert by[902].predicted_lang == "es" and by[None].predicted_lang == "ru"


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "abc", None, None, None)], SHAPE)
    assert [r.predicted_lang for r in language_ids(df).collect()] == [None]
    assert language_ids(spark.createDataFrame([], SHAPE)).count() == 0


def test_bounded_sample_still_reads_every_document(spark, rows):
    got = language_ids(spark.createDataFrame(rows, SHAPE), train_rows=60).collect()
    assert len(got) == len(rows) and np.mean([r.predicted_lang == r.lang for r in got]) > 0.95


def test_equal_languages_and_too_many(spark):
    df = spark.createDataFrame([(1, "aba", "zz"), (2, "aba", "yy"), (3, "aba", "xx")], "doc_id long, text string, lang string")
    assert {r.predicted_lang for r in language_ids(df).collect()} == {"xx"}
    with pytest.raises(ValueError, match="languages"):
        language_ids(df, most_languages=2)


@pytest.mark.parametrize(("most", "rows"), [(100, 100_000), (20_000, 3 * 10**10), (1, 10**18), (5, 5)])
def test_samples_have_their_share_at_every_size(spark, most, rows):
    low, whole = -(2**63), 2**64
    edge = low + most * whole // rows
    h = spark.createDataFrame([(low,), (edge - 2,), (min(edge + 2, 2**63 - 1),)], "h long")
    assert [r[0] for r in h.select(sampled(F.col("h"), most, rows)).collect()] == [True, True, most >= rows]
    n = spark.range(200_000).filter(sampled(F.xxhash64("id"), 20_000, 200_000)).count()
    assert 19_000 < n < 21_000
