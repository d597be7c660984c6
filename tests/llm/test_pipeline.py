import numpy as np
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from scriptorium.llm import bpe
from tests.llm.plain_mixing import mixed_plainly, parts

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, rows, labels):
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SHAPE).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def junk(seed):
    return "".join(np.random.default_rng(seed).choice(list("#$%@!| ABC0123456789"), 300))


def test_stages_against_brute_force(spark, prose, tmp_path):
    path = f"file://{tmp_path}/sf"
    good = [(i, prose(i, 120), "en", f"s{i % 4}") for i in range(200)]
    bad = [(1000 + i, junk(i), "en", "s0") for i in range(60)]
    same = [(2000 + i, good[i][1], "fr", "s1") for i in range(20)]
    near = [(3000 + i, good[i][1] + " extra tail", "en", "s2") for i in range(20, 40)]
    rows = good + bad + same + near + [(None, prose(999, 90), None, None), (4000, None, None, None), (4001, "", None, None)]
    write(spark, path, rows, [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad])
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, f in pipeline.STAGES:
        out = f(spark, docs, path)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        seen[name] = docs.collect()
    ids = {n: {r.doc_id for r in x} for n, x in seen.items()}
    assert ids["quality classifier"] >= {r[0] for r in good + same + near} and not ids["quality classifier"] & {r[0] for r in bad}
    assert ids["exact dedup"] & set(range(3000)) == set(range(200))
    assert len(ids["SimHash near-dedup"] & set(range(3000, 3040))) == 0 and ids["SimHash near-dedup"] >= set(range(200))
    texts = {r[0]: r[1] for r in rows}
    before = spark.read.parquet(f"{path}/SimHash near-dedup").select("doc_id", "text", "source", F.xxhash64("doc_id", "text", F.lit(17)).alias("h"))
    before = [tuple(r) for r in before.collect() if r.text]
    slots, blocks = mixed_plainly(before, 512, 4096, 17, 1)
    want = [(before[i][0], part) for _, _, s, _, b in slots for i, part in parts(blocks[s][b], before)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in seen["mixing sources"]))) == sorted(map(str, want)) and len(want) > 50
    assert all(r.text in texts[r.doc_id] for r in seen["mixing sources"])
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={})
    want = sorted((str(r.doc_id), enc.encode_ordinary(r.text)) for r in seen["mixing sources"])
    got = sorted((str(r.doc_id), r.token_ids) for r in pipeline.run(spark, path).collect())
    assert got == want
    assert all(r.round_trip for r in seen["BPE encoding"])


def test_empty_and_null_tables(spark, tmp_path):
    for i, rows in enumerate(([], [(None, None, None, None)] * 3)):
        path = f"file://{tmp_path}/e{i}"
        write(spark, path, rows, [])
        assert pipeline.run(spark, path).count() == 0


def test_clashing_columns_and_repeated_rows(spark, prose, tmp_path):
    path = f"file://{tmp_path}/c"
    rows = [(i % 30, prose(i % 30, 100), "en", "s", 1, "h", i, "r") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __hash string, n_tokens int, `row` string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    out = pipeline.run(spark, path)
    assert {"__hash", "row", "token_ids", "n_tokens"} <= set(out.columns)
    got = out.collect()
    assert {r.doc_id for r in got} <= set(range(30)) and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got)
