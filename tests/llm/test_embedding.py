import numpy as np
import pyarrow as pa
import pytest

from scriptorium.llm.embedding import close_in_runs, collision, embedding_dedup, embedding_groups, near_pairs, planned, unit_rows

SHAPE = "vec_id long, embedding array<float>, key string, id int"


def brute(ids, x, t):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(x @ x.T >= t, 1))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(a, b):
        p, q = find(ids[i]), find(ids[j])
        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}, {(ids[i], ids[j]) for i, j in zip(a, b)}


def test_against_brute_force(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(400, 32))
    near = base[:120] + r.normal(size=(120, 32)) * 0.12
    many = base[0] + r.normal(size=(150, 32)) * 0.08
    x = np.concatenate((base, near, many, base[5:9] * 3)).astype(np.float32)
    ids = r.permutation(len(x) * 3)[: len(x)].tolist()
    out = embedding_groups(spark.createDataFrame([(i, v.tolist(), "k", 0) for i, v in zip(ids, x)], SHAPE), threshold=0.95)
    got = {a: b for a, b in out.collect()}
    want, pairs = brute(ids, x.astype(np.float64), 0.95)
    assert set(got) == set(ids)
    found = sum(got[a] == got[b] for a, b in pairs)
    assert found >= 0.97 * len(pairs)
    assert all(want[i] == want[g] for i, g in got.items())  # nothing further apart is linked


def test_vectors_without_direction_and_repeats(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], "a", 1), (1, [1.0, 0.0], "a", 1), (2, [2.0, 0.0], None, None), (3, None, "a", 1), (4, [], "a", 1), (5, [0.0, 0.0], "a", 1), (6, [0.0, 0.0], "a", 1), (7, [nan, 1.0], "a", 1), (8, [None, 1.0], "a", 1), (9, [1.0, 0.0, 0.0], "a", 1), (None, [1.0, 0.0], "a", 1)]
    df = spark.createDataFrame(rows, SHAPE)
    assert {a: b for a, b in embedding_groups(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9}
    kept = embedding_dedup(df)
    assert kept.columns == df.columns
    assert sorted(str(r.vec_id) for r in kept.collect()) == sorted(["1", "1", "3", "4", "5", "6", "7", "8", "9", "None"])


def test_empty_table(spark):
    assert embedding_groups(spark.createDataFrame([], SHAPE)).count() == 0
    assert embedding_dedup(spark.createDataFrame([], SHAPE)).count() == 0


def test_plan_and_collision_chances():
    r = np.random.default_rng(2)
    a, b = r.normal(size=(200_000, 2)), r.uniform(0, 2, 200_000)
    x, y = np.array([1.0, 0.0]), np.array([0.8, 0.6])
    same = np.floor((a @ x + b) / 2) == np.floor((a @ y + b) / 2)
    assert abs(same.mean() - collision(float(np.linalg.norm(x - y)), 2.0)) < 0.005
    k, tables = planned(10**9, 0.95, 2.0, 0.97)
    assert 1 - (1 - collision(np.sqrt(0.1), 2.0) ** k) ** tables >= 0.97


def test_unit_rows():
    got = list(unit_rows(pa.array([[3.0, 4.0], None, [0.0, 0.0], [1.0]], pa.list_(pa.float64()))))
    assert {len(x[0]) for _, x in got if len(x)} == {1, 2}


def test_near_pairs_join_each_run_as_brute_force_does():
    r = np.random.default_rng(6)
    size = r.integers(1, 12, 400)
    edges = np.concatenate(([0], np.cumsum(size)))
    sk = r.integers(0, 2**63, edges[-1], dtype=np.uint64)
    for e in edges[:-1][size > 1][::3]:
        sk[e + 1] = sk[e] ^ np.uint64(5)
    run = np.repeat(np.arange(400), size)
    want = {(i, j) for i in range(len(sk)) for j in range(i + 1, edges[run[i] + 1]) if int(sk[i] ^ sk[j]).bit_count() <= 10}
    a, b = near_pairs(sk, edges, 10)
    assert {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist())} == want and any(size[run[i]] > 8 for i, _ in want)


def test_cosines_within_runs_only():
    r = np.random.default_rng(7)
    x = r.normal(size=(60, 8))
    x[1::2] = x[::2] + r.normal(size=(30, 8)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, run = r.permutation(60), np.repeat([0, 1, 2, 3], [20, 4, 3, 33])
    u, v = close_in_runs(ids, x, run, 0.9)
    want = {(max(ids[i], ids[j]), min(ids[i], ids[j])) for i in range(60) for j in range(i) if run[i] == run[j] and x[i] @ x[j] >= 0.9}
    assert set(zip(u.tolist(), v.tolist())) == want and len(want) > 20


def test_ids_must_be_whole_numbers_and_may_have_any_name(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "gone int, embedding array<double>")
    assert [r.gone for r in embedding_dedup(df, id_col="gone").collect()] == [1]
    with pytest.raises(TypeError, match="integer"):
        embedding_groups(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"))


def test_huge_components_and_ids(spark):
    top = 2**63 - 1
    df = spark.createDataFrame([(top, [1e300, 1e300]), (-top, [1.0, 1.0]), (0, [2e-300, 2e-300])], "vec_id long, embedding array<double>")
    assert {a: b for a, b in embedding_groups(df).collect()} == {top: -top, -top: -top, 0: -top}
