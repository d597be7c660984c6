"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 3 characters of labelled documents in 2^16 hash buckets; tasks send their
non-zero counts, Spark sums them, and a log-probability matrix of (buckets x languages) is made on the driver:
a quarter of a megabyte a language, whatever the input. Scoring takes that matrix as a broadcast variable and adds
up each document's rows of it with numpy, one batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.kernels import chunks, mix, sampled
from scriptorium.runtime import free_name

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)


def grams(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of every n-gram of the chunk's lower-cased texts, one order at a time, documents rising."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    first = np.searchsorted(lead, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    h = np.zeros(len(cp), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(cp) < n:
            return
        with np.errstate(over="ignore"):
            h = (h[: len(cp) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ cp[n - 1 :]
        if n in ORDERS:
            inside = doc[n - 1 :] == doc[: len(doc) - n + 1]
            yield doc[: len(doc) - n + 1][inside], (mix(h[inside], n) >> np.uint64(48)).astype(np.int32)


@dataclass
class Model:
    """Languages, their log prior and the (languages, buckets) log probabilities."""

    langs: list[str]
    prior: np.ndarray
    logp: np.ndarray

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """((n, languages) log joint probabilities, n-grams of each text)."""
        out, count = np.tile(self.prior, (len(texts), 1)), np.zeros(len(texts))
        for a, n, data, off in chunks(texts, lower=True):
            if not len(data):
                continue
            for doc, bucket in grams(data, off):
                if not len(doc):
                    continue
                at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                rows = a + doc[at]
                count[rows] += np.diff(np.append(at, len(doc)))
                for j, col in enumerate(self.logp):
                    out[rows, j] += np.add.reduceat(col[bucket], at, dtype=np.float64)
        return out, count


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train_rows: int = 20_000, smoothing: float = 0.5, seed: int = 3, most_languages: int = 1024) -> Model | None:
    """Model from about ``train_rows`` labelled documents, chosen by a hash of their id and text (all, if fewer); their whole texts are
    counted. None where no document has both a label and a text: also for an empty table. Repeated rows count each; an empty text
    counts for its language's share alone. More than ``most_languages`` labels (a quarter of a megabyte each) are an error."""
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(sampled(F.xxhash64("id", "text", F.lit(seed)), train_rows, rows.count()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            lang = np.array(b.column(0).to_pylist(), dtype=object)
            for name in dict.fromkeys(lang.tolist()):
                own = b.column(1).filter(pa.array(lang == name))
                total = held.setdefault(name, np.zeros(BUCKETS + 1, dtype=np.int64))
                total[BUCKETS] += len(own)
                for _, _, data, off in chunks(own, lower=True):
                    if len(data):
                        for _, bucket in grams(data, off):
                            total[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
        for name, total in held.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])

    got = rows.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    if not got.num_rows:
        return None
    names = np.array(got.column("lang").to_pylist(), dtype=object)
    langs = sorted(set(names.tolist()))
    if len(langs) > most_languages:
        raise ValueError(f"{len(langs)} languages, {most_languages} at the most")
    counts = np.zeros((len(langs), BUCKETS + 1))
    counts[np.searchsorted(np.array(langs, dtype=object), names), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    some = counts[:, :BUCKETS] + smoothing
    return Model(langs, np.log(counts[:, BUCKETS] / counts[:, BUCKETS].sum()), np.log(some / some.sum(axis=1, keepdims=True)).astype(np.float32))


def identified(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "predicted_lang", sure_col: str = "confidence") -> DataFrame:
    """``docs`` with the likeliest language and its posterior probability (columns of these names are replaced).

    A text without any character, null or empty, gets null for both; so does every text where there is no model. Texts of any length are
    read whole. Of equally likely languages the first by name is taken. Repeated rows give a row each, an empty table an empty table;
    further columns pass through under any name.
    """
    x = free_name(docs, "language")
    if model is None:
        return docs.withColumns({lang_col: F.lit(None).cast("string"), sure_col: F.lit(None).cast("double")})
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,p:double>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for texts in parts:
            s, count = m.scores(texts)
            none = count == 0
            if not len(texts):
                best, p = np.zeros(0, dtype=np.int64), np.zeros(0)
            else:
                best = s.argmax(axis=1)
                p = 1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.StructArray.from_arrays([pa.array(np.array(m.langs, dtype=object)[best], pa.string(), mask=none), pa.array(p, mask=none)], ["lang", "p"])

    out = docs.withColumn(x, run(F.col(text_col).cast("string")))
    return out.withColumns({lang_col: F.col(x)["lang"], sure_col: F.col(x)["p"]}).drop(x)


def language_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **params) -> DataFrame:
    """One row per document: its id, its label, ``predicted_lang`` and ``confidence``.

    Trained on the table's own labels by :func:`fit`. Null ids, repeated rows, and null or empty texts give a row each, as
    :func:`identified` says; texts of any length are read whole; other columns are ignored under any name.
    """
    model = fit(docs, id_col, text_col, label_col, **params)
    return identified(docs.select(id_col, label_col, text_col), model, text_col).select(id_col, label_col, "predicted_lang", "confidence")
