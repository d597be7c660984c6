import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from scriptorium.llm import bpe, mixing
from scriptorium.llm.mixing import drawn, mixed, mixed_blocks, mixed_documents, permuted, tempered, unpacks
from tests.llm.plain_mixing import mixed_plainly, tokens

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, Block int, pieces map<string,int>"


def make(prose, n=120):
    return [(i, prose(i, 5 + i * 7 % 90), "en", f"s{i % 3}" if i % 10 else "s0", 1, 2, {"a": 1}) for i in range(n)]


def ids(piece):
    return unpacks([bytes(piece)], np.uint16)[0].tolist()


def test_blocks_are_the_stream_and_slots_follow_the_draws(spark, prose):
    rows = make(prose)
    out = mixed(spark.createDataFrame(rows, SHAPE), length=32, shard_slots=20, seed=4).collect()
    by = {}
    for r in out:
        by[r.source, r.block] = r
    count = Counter()
    for r in rows:
        count[r[3]] += len(tokens(r[1]))
    names, sizes = sorted(count), {s: -(-n // 32) for s, n in count.items()}
    total = sum(sizes.values())
    assert len(out) == total
    # every slot of every shard once
    assert sorted((r.shard, r.slot) for r in out) == [(i // 20, i % 20) for i in range(total)]
    # the counts are the draws
    w = np.array([tempered({f"={s}": n for s, n in count.items()}, 0.7)[f"={s}"] for s in names])
    for sh in range(-(-total // 20)):
        want = drawn(sh, min(20, total - 20 * sh), w / w.sum(), 4)
        assert [sum(r.shard == sh and r.source == s for r in out) for s in names] == want.tolist()
    # within an epoch no block twice, and none of a later epoch before the former is used up
    for s in names:
        used = Counter((r.epoch, r.block) for r in out if r.source == s)
        assert max(used.values()) == 1
        top = max(e for e, _ in used)
        assert all(sum(e == x for x, _ in used) == sizes[s] for e in range(top))
    # blocks are full but the last, and hold the tokens of their documents in order
    for (s, b), r in by.items():
        assert r.n_tokens == sum(len(ids(p.piece)) for p in r.pieces)
        assert r.n_tokens == 32 or b == sizes[s] - 1


def test_one_full_epoch_gives_every_text_back(spark, prose):
    rows = make(prose, 60)
    for source in ("s0", "s1"):
        own = [r for r in rows if r[3] == source]
        n = -(-sum(len(tokens(r[1])) for r in own) // 16)
        out = mixed(spark.createDataFrame(own, SHAPE), length=16, shard_slots=n).collect()
        assert [r.epoch for r in out] == [0] * n
        parts = {}
        for r in sorted(out, key=lambda r: r.block):
            assert [p.seq for p in r.pieces] == np.cumsum([0] + [len(ids(p.piece)) for p in r.pieces])[:-1].tolist()
            for p in r.pieces:
                parts.setdefault(p.rest.doc_id, []).extend(ids(p.piece))
        assert parts == {r[0]: tokens(r[1]) for r in own}


def test_the_whole_result_equals_a_plain_program(spark, prose):
    rows, length, slots, seed, buckets = make(prose, 80), 24, 30, 5, 7
    df = spark.createDataFrame(rows, SHAPE)
    h = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id", "text", F.lit(seed)).alias("h")).collect()}
    want, blocks = mixed_plainly([(r[0], r[1], r[3], h[r[0]]) for r in rows], length, slots, seed, buckets)
    out = mixed_blocks(df, length=length, shard_slots=slots, seed=seed, buckets=buckets).collect()
    assert sorted((r.shard, r.slot, r.source, r.epoch, r.block) for r in out) == sorted(want)
    for r in out:
        block = blocks[r.source][r.block]
        held = [rows[i][0] for i, _, _ in block]
        assert r.token_ids == [t for _, _, t in block]
        assert r.doc_ids == list(dict.fromkeys(held)) and r.doc_starts == [held.index(d) for d in r.doc_ids]
        assert r.n_tokens == len(r.token_ids) and (r.n_tokens == length or r.block == len(blocks[r.source]) - 1)


def test_scripts_without_blanks_are_cut_like_others(spark):
    r = np.random.default_rng(1)
    texts = ["".join(map(chr, r.integers(0x4E00, 0x9FFF, 700))), "é" * 900, "😀🎉" * 300]
    df = spark.createDataFrame([(i, t, "x", "s", 1, 1, None) for i, t in enumerate(texts)], SHAPE)
    out = mixed_blocks(df, length=64, shard_slots=10_000).collect()
    last = max(x.block for x in out)
    assert all(len(x.token_ids) == 64 for x in out if x.block != last) and len(out) == -(-sum(len(tokens(t)) for t in texts) // 64)
    whole = {}
    for x in sorted(mixed(df, length=64, shard_slots=10_000, as_text=True).collect(), key=lambda x: x.block):
        for p in x.pieces:
            whole[p.rest.doc_id] = whole.get(p.rest.doc_id, "") + p.piece
    assert whole == dict(enumerate(texts))


def test_weights(spark, prose):
    df = spark.createDataFrame(make(prose), SHAPE)
    out = mixed(df, weights={"s0": 1.0, "s2": 3.0, "none": 9.0}, length=16, ratio=4.0).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in out}
    assert set(n) == {"s0", "s2"} and abs(n["s2"] / sum(n.values()) - 0.75) < 0.06
    assert mixed(df, weights={"none": 1.0}).count() == 0


def test_permutation():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        for key in (0, 99):
            got = permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(got.tolist()) == list(range(n))
    a, b = (permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, k)) for k in (1, 2))
    assert (a == b).mean() < 0.05 and abs(np.corrcoef(np.arange(1000), a)[0, 1]) < 0.1


def test_nulls_blank_long_repeats_and_clashes(spark, prose):
    long = prose(3, 30_000)
    rows = [(1, None, "a", "s", 0, 1, None), (2, "", "a", "s", 0, 1, None), (3, " \n ", "a", "s", 3, 1, None), (None, "one two", None, None, 7, None, None), (4, long, None, "s", 1, 1, {"k": 1}), (5, " lead and trail ", "a", "s", 1, 1, {}), (5, " lead and trail ", "a", "s", 1, 1, {})]
    df = spark.createDataFrame(rows, SHAPE)
    out = mixed_documents(df, length=64, weights={"s": 1.0}, ratio=2.0, shard_slots=1000)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = out.collect()
    assert {r.doc_id for r in got} == {3, 4, 5} and all(r.n_chars == len(r.text) for r in got)
    both = mixed_blocks(df, length=64).collect()
    assert {r.source for r in both} == {None, "s"} and any(r.doc_ids == [None] and r.token_ids == tokens("one two") for r in both)


def test_order_of_rows_does_not_matter(spark, prose):
    rows = make(prose)
    a, b = (sorted(map(str, mixed_blocks(spark.createDataFrame(x, SHAPE).repartition(n), length=32).collect())) for x, n in ((rows, 1), (rows[::-1], 7)))
    assert a == b


def test_empty_table_and_bad_sizes(spark):
    df = spark.createDataFrame([], SHAPE)
    assert mixed_blocks(df).count() == 0 and mixed_documents(df).columns == df.columns
    with pytest.raises(ValueError):
        mixed(df, length=0)


def peak(run):
    """(result, MB of Python and numpy at the most while it ran)."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] >> 20
    finally:
        tracemalloc.stop()


def test_memory_of_cutting_does_not_follow_the_batch(prose):
    ranks, text = bpe.read_ranks(bpe.VOCABULARY), prose(3, 2000)
    own = np.array(tokens(text), dtype=np.uint16)
    n = 2_000_000 // len(own)
    batch = pa.RecordBatch.from_arrays([pa.array(["=s"] * n), pa.array([0] * n), pa.array([0] * n), pa.array([len(own)] * n), mixing.packs(np.tile(own, n), np.arange(n + 1) * len(own)), pa.array(range(n))], ["skey", "bucket", "base", "n", "ids", "rest"])
    rows = SimpleNamespace(schema={"rest": StructField("rest", LongType())}, mapInArrow=lambda cut, _: cut)
    cut = mixing._pieces(rows, 512, SimpleNamespace(value=("own", ranks)), True)
    made, mb = peak(lambda: sum(b.column(3).to_numpy().sum() for b in cut([batch])))
    assert made == n * len(own) and mb < 40
    parts = [(b.column(5).to_pylist(), b.column(4).to_pylist()) for b in cut([batch])]
    whole = dict.fromkeys(range(n), "")
    for docs, pieces in parts:
        for d, p in zip(docs, pieces, strict=True):
            whole[d] += p
    assert set(whole.values()) == {text}


def test_memory_of_encoding_does_not_follow_the_batch(prose):
    b, text = bpe.Batcher(bpe.Encoder(bpe.read_ranks(bpe.VOCABULARY))), prose(3, 2000)
    texts = pa.array([text] * 300 + [None, ""])
    b.encode(texts)  # all pieces are known from here on
    (n, packed), mb = peak(lambda: mixing.encoded_packs(b, texts))
    assert mb < 30
    assert n.to_pylist() == [len(tokens(text))] * 300 + [0, 0] and {tuple(ids(p)) for p in packed.to_pylist()[:300]} == {tuple(tokens(text))}
