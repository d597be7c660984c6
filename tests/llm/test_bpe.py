import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from scriptorium.llm import bpe

SHAPE = "doc_id long, text string, n_tokens string, `Round_Trip` int"
ODD = ["", " ", "\n\n \t", "don't I'll we've 's", "naïve café — «ça»", "日本語のテキスト", "a" * 5000, "🙂👍🏽 zwj 👩‍👩‍👧", "x y z", "12345 67,890.12", "<|endoftext|> is text", "the  quick   brown\r\n\r\nfox  ", "́combining", "'ſ 'S 'LL"]


@pytest.fixture(scope="module")
def plain():
    ranks = bpe.read_ranks(bpe.VOCABULARY)
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(prose):
    r = random.Random(3)
    mess = ["".join(chr(r.choice([r.randint(32, 126), r.randint(160, 0x2FF), r.randint(0x3040, 0x30FF), r.randint(0x1F300, 0x1F600), 10, 32])) for _ in range(r.randint(1, 400))) for _ in range(150)]
    return [*ODD, *mess, *(prose(i, 200) for i in range(40)), prose(99, 40_000)]


def test_equals_the_public_library(spark, prose, plain):
    some = texts(prose)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "doc_id long, text string")
    got = {r.doc_id: r.token_ids for r in bpe.bpe_encode(df).collect()}
    assert all(got[i] == plain.encode_ordinary(t) for i, t in enumerate(some))
    back = bpe.bpe_decode(bpe.bpe_encode(df)).collect()
    assert all(r.decoded == r.text for r in back)


def test_backtracking_on_random_bytes(plain):
    enc = bpe.Encoder(bpe.read_ranks(bpe.VOCABULARY))
    r = random.Random(4)
    for _ in range(2000):
        s = "".join(r.choice("abinterestdly") for _ in range(r.randint(1, 60)))
        assert enc.piece(s.encode()) == plain.encode_ordinary(s)


def test_round_trip_query_with_nulls_repeats_and_clashes(spark, prose):
    rows = [(1, "abc def", "x", 1), (1, "abc def", "x", 1), (2, None, "x", None), (3, "", None, 2), (None, prose(5, 30_000), "y", 3)]
    out = bpe.bpe_round_trip(spark.createDataFrame(rows, SHAPE))
    assert out.columns == ["doc_id", "token_ids", "n_tokens", "round_trip"]
    got = sorted(out.collect(), key=str)
    assert len(got) == 5
    null = next(r for r in got if r.doc_id == 2)
    assert null.token_ids is None and null.n_tokens is None and null.round_trip is None
    assert all(r.round_trip for r in got if r.doc_id != 2)
    assert next(r for r in got if r.doc_id == 3).token_ids == []


def test_decoding_of_odd_ids(spark):
    rows = [([64, None, 10**6, -1],), (None,), ([],), ([bpe.read_ranks(bpe.VOCABULARY)[b"\xff"]],)]
    got = [r.decoded for r in bpe.bpe_decode(spark.createDataFrame(rows, "token_ids array<int>")).collect()]
    assert got[0] is not None and got[1] is None and got[2] == "" and got[3] == "�"


def test_empty_table_and_other_vocabularies(spark):
    assert bpe.bpe_round_trip(spark.createDataFrame([], SHAPE)).count() == 0
    multi = bpe.VOCABULARY.replace("byte_bpe_50k", "byte_bpe_multi_50k")
    enc = bpe.Encoder(bpe.read_ranks(multi))
    want = tiktoken.Encoding("m", pat_str=bpe.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    assert all(enc.text(t) == want.encode_ordinary(t) for t in ODD)
    assert bpe.read_ranks(bpe.VOCABULARY.replace(".tiktoken", ".json")) == bpe.read_ranks(bpe.VOCABULARY)


def test_pairs_that_a_worker_keeps_are_bounded():
    enc = bpe.Encoder(bpe.read_ranks(bpe.VOCABULARY))
    pairs = np.random.default_rng(2).integers(0, len(enc.token), (300_000, 2)).tolist()
    first = [enc.compatible(a, b) for a, b in pairs]
    assert len(enc.pairs) <= 1 << 18  # some 30 MB
    assert [enc.compatible(a, b) for a, b in pairs[:5000]] == first[:5000]


def test_a_full_pool_is_emptied_between_chunks(prose, plain):
    some = texts(prose)
    b = bpe.Batcher(bpe.Encoder(bpe.read_ranks(bpe.VOCABULARY)), slots=1 << 12)
    used = []
    parts = [(ids, n) for ids, n in b.encoded(pa.array(some * 3)) if used.append(b.used) is None]
    assert len(parts) > 1 and any(y < x for x, y in zip(used, used[1:]))  # noqa: B905
    whole = [np.concatenate(x) for x in zip(*parts, strict=True)]
    at = np.concatenate(([0], np.cumsum(whole[1])))
    assert [whole[0][x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == [plain.encode_ordinary(t) for t in some] * 3
