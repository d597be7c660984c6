import os

import pytest
from pyspark.sql import functions as F

from scriptorium import runtime


def test_keys_are_split_without_loss(spark):
    df = spark.createDataFrame([(str(i) if i % 7 else None, "text") for i in range(3000)], "k string, text string")
    keys = spark.createDataFrame([(str(i),) for i in range(0, 3000, 30)] + [(None,)], "q string")
    sure, may = runtime.split_by_keys(df, F.col("k"), keys, F.col("q"), 101)
    wanted = {str(i) for i in range(0, 3000, 30) if i % 7}
    kept = {r.k for r in may.collect()}
    assert wanted <= kept and len(kept - wanted) < 100
    assert sure.count() + may.count() == 3000 and sure.filter("k is null").count() == df.filter("k is null").count()
    none, _ = runtime.split_by_keys(df, F.col("k"), keys.filter("false"), F.col("q"), 0)
    assert none.count() == 3000


def test_a_full_filter_is_still_right(spark):
    df = spark.range(20_000).select("id")
    sure, may = runtime.split_by_keys(df, F.col("id"), df.filter("id % 2 = 0").toDF("q"), F.col("q"), 10_000, most=4096)
    assert may.filter("id % 2 = 0").count() == 10_000 and sure.count() + may.count() == 20_000


def test_many_keys_move_only_rows_that_the_filter_holds_back(spark, monkeypatch):
    df = spark.createDataFrame([(i, "t" * 50) for i in range(2000)], "id long, text string")
    gone = spark.range(0, 2000, 100).toDF("g")
    few = {r.id for r in runtime.without_keys(df, "id", gone, 20).collect()}
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 10)
    out = runtime.without_keys(df, "id", gone, 20)
    assert {r.id for r in out.collect()} == few == {i for i in range(2000) if i % 100}
    plan = out._jdf.queryExecution().executedPlan().toString()
    clear, held = plan.split("Filter coalesce")[0], plan
    assert "Union" in clear and held.count("__words") >= 2
    sure, _ = runtime.split_by_keys(df, F.col("id"), gone, F.col("g"), 20)
    shuffles = [x for x in sure._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
    assert shuffles and all("fblock" in x for x in shuffles)  # of the filter alone


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Other:
        class conf:
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k: None)}))

    with pytest.raises(RuntimeError, match="checkpoint"):
        runtime.shared_dir(Other)
    Other.sparkContext.master = "local[2]"
    monkeypatch.setattr(runtime, "_own_dir", None)
    assert os.path.isdir(runtime.shared_dir(Other).removeprefix("file://"))


def test_width_bounds_a_broadcast_too(spark):
    df = spark.range(3)
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(runtime.broadcast_if(df, 1000)) and not hinted(runtime.broadcast_if(df, 1000, 1 << 20)) and not hinted(runtime.broadcast_if(df, 10**6))
