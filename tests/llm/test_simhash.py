import numpy as np
import pyarrow as pa
import pytest

from scriptorium.llm.components import components
from scriptorium.llm.simhash import BITS, KEY_COST, allotted, ball, chosen_parts, distances, group_hits, grouped_bits, near_edges, radii, signatures, signed, simhash_dedup, uniform, work

SHAPE = "doc_id long, text string, copies int, keep string"


def groups_of(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def edited(text, seed, share=0.03):
    r, w = np.random.default_rng(seed), text.split()
    for i in r.choice(len(w), max(1, int(len(w) * share)), replace=False):
        w[i] = f"new{r.integers(10**6)}"
    return " ".join(w)


def test_search_is_exact_for_random_and_skewed_bits(spark):
    r = np.random.default_rng(3)
    bits = r.random((1500, BITS)) < np.concatenate((np.full(100, 0.5), np.full(28, 0.9)))
    bits[:, 101:120] = bits[:, [100]] ^ (r.random((1500, 19)) < 0.05)
    near = bits[r.integers(0, 1500, 500)] ^ (r.random((500, BITS)) < r.choice([0.03, 0.1, 0.15], 500)[:, None])
    s = np.packbits(np.concatenate((bits, near)), axis=1).view(np.int64)
    df = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(s)], "id long, s0 long, s1 long")
    k = 18
    u = s.view(np.uint64)
    d = np.bitwise_count(u[:, None, 0] ^ u[None, :, 0]).astype(int) + np.bitwise_count(u[:, None, 1] ^ u[None, :, 1])
    want = groups_of(zip(*map(list, np.nonzero(np.triu(d <= k, 1)))), range(len(s)))
    for settings in ({}, {"parts": 8}, {"parts": 7}, {"parts": 6}, {"parts": 8, "heavy_rows": 300}):
        got = groups_of([(r.u, r.v) for r in near_edges(df, k, **settings).collect()], range(len(s)))
        assert got == want and len(set(want.values())) < len(s) - 100, settings
    few = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(s) if i % 3 == 0 or i >= 1500], "id long, s0 long, s1 long")
    left = [i for i in range(len(s)) if i % 3 == 0 or i >= 1500]
    at = np.array(left)
    want = groups_of([(left[i], left[j]) for i, j in zip(*np.nonzero(np.triu(d[np.ix_(at, at)] <= k, 1)))], left)
    for parts in (5, 4):
        assert groups_of([(r.u, r.v) for r in near_edges(few, k, parts).collect()], left) == want, parts


def test_copies_are_caught_and_others_left_alone(spark, prose):
    base = [prose(i, 150) for i in range(120)]
    rows = [(i, t, 0, "x") for i, t in enumerate(base)] + [(200 + i, edited(base[i], i), 0, "x") for i in range(40)] + [(300 + i, edited(base[50], 100 + i, 0.01), 0, "x") for i in range(60)]
    kept = {r.doc_id for r in simhash_dedup(spark.createDataFrame(rows, SHAPE)).collect()}
    assert set(range(120)) <= kept and len(kept - set(range(120))) <= 2


def test_nulls_wordless_long_repeats(spark, prose):
    long = prose(7, 60_000)
    rows = [(1, None, 0, "x"), (1, None, 0, "x"), (2, "", 0, "x"), (3, " .,; ", 0, "x"), (4, long, 0, "x"), (5, long + " end", 0, "x"), (None, long, 0, "n"), (9, prose(8, 50), 2, "b"), (9, prose(8, 50), 1, "a"), (9, prose(8, 50), 1, "a"), (6, prose(9, 50), None, None), (7, prose(9, 50).upper(), None, None)]
    out = simhash_dedup(spark.createDataFrame(rows, SHAPE))
    assert out.columns == ["doc_id", "text", "copies", "keep"]
    got = sorted(str(r.doc_id) for r in out.collect())
    assert got == sorted(["1", "1", "2", "3", "4", "None", "9", "6"])


def test_empty_table_and_nothing_near(spark, prose):
    assert simhash_dedup(spark.createDataFrame([], SHAPE)).count() == 0
    assert simhash_dedup(spark.createDataFrame([(1, prose(1, 60), 0, ""), (2, prose(2, 60), 0, "")], SHAPE)).count() == 2


def test_allotment_sums_and_prefers_even_partitions():
    h = [np.full(1 << 8, 1000.0) for _ in range(3)] + [np.concatenate(([256_000.0], np.zeros(255)))]
    ts = allotted([distances([x]) for x in h], 5)[1]
    assert sum(ts) == 5 - 4 + 1 and ts[3] == -1
    with pytest.raises(ValueError):
        allotted([uniform(100, 32)] * 2, 18)


def test_distances_and_shared_keys_equal_counting():
    r = np.random.default_rng(4)
    v = r.integers(0, 256, 300)
    h = np.bincount(v, minlength=256).astype(float)
    want = np.bincount(np.bitwise_count(v[:, None] ^ v[None, :]).ravel(), minlength=9)
    assert distances([h]).round().tolist() == want.tolist()
    assert np.allclose(distances([np.full(16, 10.0), np.full(8, 20.0)]), uniform(160, 7) - np.eye(8)[0] * 160)
    for t in range(5):
        e, o = radii(t)
        keys = [set((x ^ ball(8, o if x.bit_count() % 2 else e)).tolist()) for x in v[:80].tolist()]
        met = sum(len(keys[i] & keys[j]) for i in range(80) for j in range(i))
        pairs = distances([np.bincount(v[:80], minlength=256).astype(float)])
        assert work(pairs, t) - KEY_COST * 40 * sum(len(ball(8, x)) for x in (e, o)) == pytest.approx(met, rel=0.15)
        assert all(keys[i] & keys[j] for i in range(80) for j in range(i) if int(v[i] ^ v[j]).bit_count() <= t)


def test_more_rows_take_fewer_partitions():
    got = [chosen_parts(n, 18) for n in (1e4, 1e6, 1e8, 1e10)]
    assert got == sorted(got, reverse=True) and got[0] > got[-1]


def test_pivots_change_nothing():
    r = np.random.default_rng(9)
    centre = r.integers(0, 2**63, 2, dtype=np.uint64)
    flips = np.packbits(r.random((900, 128)) < 0.06, axis=1).view(np.uint64)
    far = r.integers(0, 2**63, (300, 2), dtype=np.uint64)
    s = np.concatenate((centre ^ flips, far, far[:20] ^ np.uint64(7)))[r.permutation(1220)]
    ids = r.permutation(5000)[:1220]
    d = np.bitwise_count(s[:, None, 0] ^ s[None, :, 0]).astype(int) + np.bitwise_count(s[:, None, 1] ^ s[None, :, 1])
    want = groups_of([(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(d <= 18, 1)))], ids.tolist())
    u, v = group_hits(ids, s[:, 0].copy(), s[:, 1].copy(), 18)
    assert groups_of(zip(u.tolist(), v.tolist()), ids.tolist()) == want


def test_partitions_take_correlated_bits_together():
    c = np.eye(16)
    c[2, 9] = c[9, 2] = 0.9
    g = grouped_bits(c, 4)
    assert sorted(np.concatenate(g).tolist()) == list(range(16))
    assert any({2, 9} <= set(x.tolist()) for x in g)
    assert len(ball(6, 2)) == 1 + 6 + 15


def test_signature_is_of_the_set_of_words():
    sig, has = signatures(pa.array(["one two three", "THREE one two one", "", None]))
    assert (sig[0] == sig[1]).all() and has.tolist() == [True, True, False, False]


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.u: r.v for r in components(df).df.collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u long, v long")).df.count() == 0


def test_rows_without_id_or_text_have_no_signature(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None), (2, "a b")], "doc_id long, text string")
    assert {r.id: r.s0 is None for r in signed(df).collect()} == {1: True, 2: False}


def test_one_id_with_other_texts_and_clashing_names(spark, prose):
    a, b, c = prose(21, 80), prose(22, 80), prose(23, 80)
    rows = [(5, a, 1), (5, b, 2), (5, None, 3), (5, " ", 4), (4, b, 5), (6, a + " x", 6), (7, c, 7), (8, c, 8), (8, a, 9), (8, None, 10)]
    got = sorted(r.key for r in simhash_dedup(spark.createDataFrame(rows, "row long, text string, key int"), id_col="row").collect())
    assert got == [1, 3, 4, 5, 7, 10]
    names = spark.createDataFrame([(f"n{i}", t) for i, t, _ in rows], "gone string, text string")
    assert sorted(r.gone for r in simhash_dedup(names, id_col="gone").collect()) == sorted(["n5", "n5", "n5", "n4", "n7", "n8"])
