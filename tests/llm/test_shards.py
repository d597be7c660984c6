import copy
import hashlib
import math

import pytest

from scriptorium.llm.shards import TREE, checked, placed, write_shards

SHAPE = "doc_id long, text string, Region int, x string"


def brute(key, tree=TREE, path=""):
    if tree is None:
        return []
    best = min((-math.log((int(hashlib.md5(f"{key}|{path}/{n}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w, n) for n, (w, _) in tree.items() if w > 0)[1]
    return [best, *brute(key, tree[best][1], f"{path}/{best}")]


def rows(n):
    return [(i, "t", 1, "x") for i in range(n)]


def at(spark, n, tree):
    return {r.doc_id: (r.region, r.rack, r.shard) for r in placed(spark.createDataFrame(rows(n), SHAPE), tree).collect()}


def test_equals_brute_force_and_weights(spark):
    got = at(spark, 6000, TREE)
    assert all(list(got[i]) == brute(str(i)) for i in range(6000))
    share = sum(v[0] == "east" for v in got.values()) / 6000
    assert abs(share - 0.5) < 0.03


def test_a_changed_weight_moves_keys_only_to_or_from_it(spark):
    before = at(spark, 3000, TREE)
    more = copy.deepcopy(TREE)
    rack = more["north"][1]["n1"][1]
    rack["n1a"] = (3.0, None)
    after = at(spark, 3000, more)
    moved = [i for i in before if before[i] != after[i]]
    assert moved and all(after[i] == ("north", "n1", "n1a") and before[i][1] == "n1" for i in moved)
    del rack["n1c"]
    gone = at(spark, 3000, more)
    assert all(gone[i] == after[i] for i in after if after[i][2] != "n1c")


def test_nulls_repeats_long_texts_and_clashes(spark):
    data = [(None, None, 1, None), (None, "", 2, "x"), (5, "t" * 300_000, 3, "x"), (5, "t", 4, "y")]
    out = placed(spark.createDataFrame(data, SHAPE))
    assert out.columns == ["doc_id", "text", "x", "region", "rack", "shard"]
    got = [(r.doc_id, [r.region, r.rack, r.shard]) for r in out.collect()]
    assert len(got) == 4 and all(p == brute("null" if i is None else str(i)) for i, p in got)
    assert placed(spark.createDataFrame([], SHAPE)).count() == 0


@pytest.mark.parametrize("tree", [{}, {"a": (0.0, {"b": (1.0, {"c": (1.0, None)})})}, {"a": (1.0, None)}, {"a": (1.0, {"b": (1.0, {"c": (-1.0, None)})})}, {"a": (1.0, {"b": (1.0, {"c": (1.0, {"d": (1.0, None)})})})}])
def test_bad_trees(tree):
    with pytest.raises(ValueError):
        checked(tree)


def test_written_folders(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    write_shards(spark.createDataFrame(rows(500), SHAPE), path, files=2)
    back = spark.read.parquet(path)
    assert back.count() == 500
    assert {(r.region, r.rack, r.shard) for r in back.select("region", "rack", "shard").distinct().collect()} <= {tuple(brute(str(i))) for i in range(500)}
