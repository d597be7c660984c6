from pyspark.sql import functions as F

from scriptorium.llm.exact_dedup import exact_dedup

SHAPE = "doc_id long, text string, Hash int, `count` string"


def test_copies_nulls_ties_and_clashing_columns(spark):
    long = "x" * 300_000
    rows = [(5, "a", 1, "p"), (3, "a", 2, "q"), (3, "a", 2, "q"), (9, "", 0, None), (8, "", 0, None), (1, None, 0, "n"), (1, None, 0, "n"), (None, "a", 7, "z"), (None, "only", 7, "z"), (20, long, 1, "l"), (21, long, 1, "l"), (22, long + "y", 1, "l")]
    out = exact_dedup(spark.createDataFrame(rows, SHAPE))
    assert out.columns == ["doc_id", "text", "Hash", "count"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(3, "a"), (8, ""), (1, None), (1, None), (None, "only"), (20, long), (22, long + "y")], key=str)


def test_colliding_hashes_are_told_apart_by_bytes(spark):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "c")]
    out = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), hash_of=lambda t: F.unhex(F.md5(F.lit("same"))))
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 4]


def test_empty_table(spark):
    out = exact_dedup(spark.createDataFrame([], SHAPE))
    assert out.count() == 0 and out.columns == ["doc_id", "text", "Hash", "count"]


def test_rows_of_one_id_and_text_are_chosen_by_their_json(spark):
    rows = [(1, "a", 2, "x"), (1, "a", 1, "z"), (1, "a", 1, "y"), (2, "b", 5, "q")]
    got = sorted(tuple(r) for r in exact_dedup(spark.createDataFrame(rows, SHAPE)).collect())
    assert got == [(1, "a", 1, "y"), (2, "b", 5, "q")]


def test_ids_of_other_types(spark):
    rows = [("b", "t"), ("a", "t"), ("c", "u")]
    assert sorted(r.doc_id for r in exact_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()) == ["a", "c"]


def test_only_repeated_hashes_are_shuffled(spark):
    df = spark.createDataFrame([(i, f"text {i % 900}") for i in range(1000)], "doc_id long, text string")
    out = exact_dedup(df)
    assert out.count() == 900
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("__words") >= 2 and "SortMergeJoin" not in plan
