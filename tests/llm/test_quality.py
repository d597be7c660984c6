import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm.quality import NAMES, _stats_table, fit, isotonic, quality_filter, quality_scores, statistics

SHAPE = "doc_id long, text string, score int, id string"
LABELS = "doc_id long, quality int, toxic int"


def junk(seed):
    r = np.random.default_rng(seed)
    return "".join(r.choice(list("#$%@!| ABC0123456789"), 200))


@pytest.fixture(scope="module")
def corpus(spark, prose):
    rows = [(i, prose(i, 80) if i % 4 else junk(i), i, "x") for i in range(400)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(0, 400, 1) if i % 2 == 0 or i % 8 == 1]
    return rows, labels


def test_held_out_accuracy_and_filter(spark, corpus):
    rows, labels = corpus
    docs, lab = spark.createDataFrame(rows, SHAPE), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in quality_scores(docs, lab).collect()}
    held = set(range(400)) - {x[0] for x in labels}
    assert len(got) == 400
    assert np.mean([got[i].keep == (i % 4 > 0) for i in held]) > 0.97
    kept = quality_filter(docs, lab)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep}


def test_nulls_empty_long_repeats(spark, corpus, prose):
    rows, labels = corpus
    more = rows + [(900, None, 1, None), (901, "", 1, None), (902, prose(1, 60_000), 1, None), (None, prose(2, 50), 1, None), (3, rows[3][1], 1, None)]
    got = quality_scores(spark.createDataFrame(more, SHAPE), spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0), (8, 1, 0), (8, 0, 0)], LABELS)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 405 and by[900].score is None and not by[900].keep
    assert by[901].score is not None and by[902].keep and by[None].keep
    assert len({r.score for r in got if r.doc_id == 3}) == 1


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(None, 1, 0)]])
def test_no_usable_labels_rejects_none_but_null_texts(spark, labels):
    docs = spark.createDataFrame([(1, "a b", 0, ""), (2, None, 0, "")], SHAPE)
    got = {r.doc_id: r for r in quality_scores(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert got[1].keep and not got[2].keep and got[1].probability is None


def test_empty_table(spark):
    docs, lab = spark.createDataFrame([], SHAPE), spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS)
    assert quality_scores(docs, lab).count() == 0 and quality_filter(docs, lab).columns == docs.columns


def test_statistics_follow_the_text():
    x = statistics(pa.array(["ab AB 12", None, "", "a\na\nb"]))
    at = {n: i for i, n in enumerate(NAMES)}
    assert x[0, at["lower"]] == 0.25 and x[0, at["upper"]] == 0.25 and x[0, at["digit"]] == 0.25
    assert (x[1] == 0).all() and (x[2] == 0).all()
    assert x[3, at["distinct_lines"]] == pytest.approx(2 / 3)
    assert x[0, at["word_length"]] == 2


def test_isotonic_rises():
    k, v = isotonic(np.arange(6.0), np.full(6, 10.0), np.array([1.0, 3, 2, 5, 9, 8]))
    assert (np.diff(v) >= 0).all() and len(k) == len(v)
    assert np.interp(1.0, k, v) == pytest.approx(0.25)


def test_the_fit_equals_a_direct_solution(spark, corpus):
    rows, labels = corpus
    stats = _stats_table(spark.createDataFrame(rows, SHAPE), "doc_id", "text")
    labels = [*labels, (4, 1, 0), (4, 0, 0)]
    model = fit(stats, spark.createDataFrame(labels, LABELS), ridge=1e-2)
    held = {r.id: r.held for r in stats.select("id", (F.pmod(F.xxhash64("id", "h", F.lit(8)), F.lit(5)) == 0).alias("held")).collect()}
    x = {r.id: np.array(r.x) for r in stats.collect()}
    every = np.array(list(x.values()))
    assert np.allclose(model.mean, every.mean(0)) and np.allclose(model.scale, np.sqrt(np.maximum(every.var(0), 1e-8)), atol=1e-4)
    train = [(i, q) for i, q, _ in labels if not held[i]]
    z, y = model.features(np.array([x[i] for i, _ in train])), np.array([float(q) for _, q in train])
    f = z.shape[1] - 1
    want = np.linalg.solve(z.T @ z + np.diag([1e-2 * len(y) / f] * f + [0.0]) + 1e-9 * np.eye(f + 1), z.T @ y)
    assert np.allclose(z @ model.weights, z @ want, atol=1e-5)
    rest = [(i, q) for i, q, _ in labels if held[i]]
    bins = np.clip(np.round(model.scores(np.array([x[i] for i, _ in rest])) * 512), -2048, 2048) / 512
    at, inv = np.unique(bins, return_inverse=True)
    knots, values = isotonic(at, np.bincount(inv).astype(float), np.bincount(inv, [q for _, q in rest]).astype(float))
    assert np.allclose(model.knots, knots) and np.allclose(model.values, values)


def test_ids_of_any_type_and_bounded_samples(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame([(f"d{i}", t) for i, t, *_ in rows], "doc_id string, text string")
    lab = spark.createDataFrame([(f"d{i}", q) for i, q, _ in labels], "doc_id string, quality int")
    got = quality_scores(docs, lab, train_rows=100).collect()
    assert np.mean([r.keep == (int(r.doc_id[1:]) % 4 > 0) for r in got]) > 0.95
    numbers = spark.createDataFrame(labels, LABELS)
    assert quality_scores(docs, numbers).filter("score is null").count() == 400  # no id of theirs is a number


def test_filter_of_empty_tables_and_clashing_names(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, *_ in rows], "doc_id long, text string, __hash string, score int")
    kept = quality_filter(docs, spark.createDataFrame(labels, LABELS))
    assert kept.columns == docs.columns and 250 < kept.count() < 330
    assert quality_filter(docs.filter("false"), spark.createDataFrame(labels, LABELS)).count() == 0
