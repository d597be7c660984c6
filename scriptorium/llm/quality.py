"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel. Each task sums its own normal equations, the sums are added in 16
groups and solved on the driver: what travels is (features + 1)^2 numbers a task, whatever the number of rows.
Scores of held-back labelled rows are calibrated to probabilities by pool-adjacent-violators over score bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from scriptorium.llm.exact_dedup import content_hash
from scriptorium.llm.kernels import chunks, distinct, hashes, runs, sampled, summed, sums, words
from scriptorium.runtime import Cut, broadcast_if, free_name, without_keys

_CLASS = np.full(256, 9, dtype=np.int64)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:'\"?-()", b"!", b"|", b"#$%&*@^~<>{}[]\\/+=_`")):
    _CLASS[list(_bytes)] = _k
_CLASS[128:] = 10
NAMES = ("log_bytes", "lower", "upper", "digit", "blank", "line_end", "stop", "shout", "bar", "sign", "control", "high", "word_length", "word_spread", "long_words", "word_rate", "distinct_words", "log_line", "distinct_lines", "capital_words")


def statistics(texts: pa.Array) -> np.ndarray:
    """(n, len(NAMES)) statistics of the whole texts; nulls count as empty texts (all zero)."""
    out = np.zeros((len(texts), len(NAMES)))
    for a, n, data, off in chunks(texts):
        if not len(data):
            continue
        size = np.diff(off).astype(np.float64)
        some = np.maximum(size, 1)
        doc_of = np.repeat(np.arange(n), np.diff(off))
        cls = _CLASS[data]
        shares = sums(doc_of * 11 + cls, n * 11).reshape(n, 11) / some[:, None]
        doc, h, lens = words(data, off)
        count = np.maximum(sums(doc, n), 1)
        mean = sums(doc, n, lens) / count
        spread = np.sqrt(np.maximum(sums(doc, n, lens.astype(np.float64) ** 2) / count - mean**2, 0))
        inside = data != 10
        starts, ends = runs(data, off, inside)
        line_doc = np.searchsorted(off, starts, side="right") - 1
        lines = np.maximum(sums(line_doc, n), 1)
        own_words, own_lines = distinct(doc, h)[0], distinct(line_doc, hashes(data, starts, ends, inside))[0]
        upper = (cls == 1).astype(np.int64)
        pairs = upper[:-1] & upper[1:]
        shout = sums(doc_of[1:][pairs > 0], n) / some
        out[a : a + n] = np.column_stack((np.log1p(size), shares, mean, spread, sums(doc[lens > 15], n) / count, count / some, sums(own_words, n) / count, np.log1p(size / lines), sums(own_lines, n) / lines, shout)) * (size > 0)[:, None]
    return out


@dataclass
class Model:
    """Everything scoring needs: a few tens of kilobytes."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack((np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones(len(x))))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.round(self.features(x) @ self.weights, 9)  # so that a row's score doesn't depend on its batch

    def probabilities(self, s: np.ndarray) -> np.ndarray:
        return np.interp(s, self.knots, self.values)


def isotonic(x: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising probabilities at the bins' scores ``x`` (rising)."""
    pools: list[list[float]] = []
    for lo, c, g in zip(x, n, good, strict=True):
        pools.append([lo, lo, c, g])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    knots = [k for p in pools for k in ((p[0], p[1]) if p[1] > p[0] else (p[0],))]
    values = [p[3] / p[2] for p in pools for _ in ((0, 1) if p[1] > p[0] else (0,))]
    return np.array(knots), np.array(values)


def _stats_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, x): id, content hash and statistics of every text that isn't null. Texts are read here alone."""
    text = F.col(text_col).cast("string")
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), content_hash(text).alias("h"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(2)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float32()))], ["id", "h", "x"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:2], StructField("x", ArrayType(FloatType()))]))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)).astype(np.float64)


def fit(stats: DataFrame, labels: DataFrame, features: int = 256, width: float = 4.0, ridge: float = 1e-3, train_rows: int = 200_000, seed: int = 7) -> Model | None:
    """Model from ``stats`` (id, h, x) and ``labels`` (doc_id, quality); None where the labels don't show both classes.

    Means and scales are those of all documents. Of the labelled documents about ``train_rows`` are used, chosen by a hash of their
    id and content; a fifth of these calibrates. An id with several labels counts for each, and so does a document that occurs
    several times: equal ones are one row with a weight. Ids are compared as strings where the tables' types differ.
    """
    f = len(NAMES)
    whole = summed(stats.select("x"), lambda b: [np.concatenate(([len(x := _matrix(b.column(0)))], x.sum(0), (x * x).sum(0)))], 1)
    if whole is None:
        return None
    n, m = whole[0][0], whole[0][1 : f + 1] / whole[0][0]
    scale = np.sqrt(np.maximum(whole[0][f + 1 :] / n - m * m, 1e-8))
    same = stats.schema["id"].dataType == labels.schema["doc_id"].dataType
    key = F.col("doc_id") if same else F.col("doc_id").cast("string")
    known = Cut(labels.filter("doc_id is not null and quality is not null").groupBy(key.alias("key")).agg(F.count("*").alias("k"), F.sum((F.col("quality") > 0).cast("double")).alias("good")), "labels")
    size = known.df.agg(F.count("*"), F.avg(F.octet_length(F.col("key").cast("string")))).first()
    rows = stats.withColumn("key", F.col("id") if same else F.col("id").cast("string")).join(broadcast_if(known.df, size[0], 24 + (size[1] or 0)), "key")
    rows = rows.groupBy("key", "h").agg(F.any_value("x").alias("x"), F.sum("k").cast("double").alias("n"), F.sum("good").alias("good"))
    h = F.xxhash64("key", "h", F.lit(seed))
    every = Cut(rows.select("x", "n", "good", h.alias("hash"), (F.pmod(F.xxhash64("key", "h", F.lit(seed + 1)), F.lit(5)) == 0).alias("held")), "labelled")
    known.drop()
    rows = every.df.filter(sampled(F.col("hash"), train_rows, every.df.count()))
    rng = np.random.default_rng(seed)
    model = Model(m, scale, rng.normal(size=(f, features)) / width, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(1), np.ones(1))

    def equations(b):
        z, weight, good = model.features(_matrix(b.column(0))), b.column(1).to_numpy(), b.column(2).to_numpy()
        return [((z * weight[:, None]).T @ z).ravel(), z.T @ good, np.array([weight.sum(), good.sum()])]

    got = summed(rows.filter("not held").select("x", "n", "good"), equations, 3)
    if got is None or not 0 < got[2][1] < got[2][0]:
        every.drop()
        return None
    a = got[0].reshape(features + 1, -1) + np.diag([ridge * got[2][0] / features] * features + [0.0])
    model.weights = np.linalg.solve(a + 1e-9 * np.eye(len(a)), got[1])

    @F.arrow_udf("int")
    def bin_of(x: pa.Array) -> pa.Array:
        return pa.array(np.clip(np.round(model.scores(_matrix(x)) * 512), -2048, 2048).astype(np.int32))

    bins = rows.filter("held").select(bin_of("x").alias("bin"), "n", "good").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy("bin").collect()
    every.drop()
    if bins:
        model.knots, model.values = isotonic(*(np.array([r[i] for r in bins], dtype=np.float64) / (512 if i == 0 else 1) for i in range(3)))
    return model


def scored(stats: DataFrame, model: Model | None) -> DataFrame:
    """``stats`` with the columns score and probability, null without a model."""
    if model is None:
        return stats.withColumns({"score": F.lit(None).cast("double"), "probability": F.lit(None).cast("double")})

    @F.arrow_udf("struct<score:double,probability:double>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in parts:
            s = model.scores(_matrix(x)) if len(x) else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(s), pa.array(model.probabilities(s))], ["score", "probability"])

    return stats.withColumn("s", run("x")).select("id", "h", F.col("s.score").alias("score"), F.col("s.probability").alias("probability"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One row per document: its id, ``score``, calibrated ``probability`` of good quality and ``keep``.

    keep: the probability is at least ``threshold``. A null text has null score and probability and isn't kept. An empty
    text is scored like any other, a very long one by statistics of all of it. Without usable labels (none, or one class only) no
    document is rejected but null texts. Null ids are scored too but can't be labelled; ids are of any type; repeated rows give a row
    each; other columns are left alone under any name. An empty table gives an empty table. Texts are read once: what is scored is the
    written table of their statistics.
    """
    stats = Cut(_stats_table(docs, id_col, text_col), "stats").df
    out = scored(stats, fit(stats, labels, **params)).select(F.col("id").alias(id_col), "score", "probability", (F.coalesce("probability", F.lit(1.0)) >= threshold).alias("keep"))
    none = F.lit(None).cast("double")
    return out.unionByName(docs.filter(F.col(text_col).isNull()).select(id_col, none.alias("score"), none.alias("probability"), F.lit(False).alias("keep")))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` without the documents that :func:`quality_scores` doesn't keep; all columns stay, under any name. Cases as there.

    A score is a function of the text, so that what is rejected is a set of 128-bit content hashes: the texts are not scored again.
    """
    some = docs.filter(F.col(text_col).isNotNull())
    stats = Cut(_stats_table(docs, id_col, text_col), "stats")
    model = fit(stats.df, labels, **params)
    bad = Cut(scored(stats.df, model).filter(F.coalesce("probability", F.lit(1.0)) < threshold).select("h").distinct(), "rejected")
    stats.drop()
    name = free_name(docs, "hash")
    return without_keys(some.withColumn(name, content_hash(F.col(text_col).cast("string"))), name, bad.df, bad.df.count()).select(*docs.columns)
