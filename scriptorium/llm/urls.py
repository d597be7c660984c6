"""URL filter: gradient-boosted trees on lexical features, trained from labelled URLs.

Features are byte-class counts, shares and entropy of the URL, and statistics of its host's suffixes (the last two and three labels): how
many URLs have each, and how many of the labelled ones on *other* hosts are bad. So no score can be read off the labels of the URL's own host,
and a new host is scored as a known one is. Suffix statistics are made per host, from a groupBy over all URLs; they come back by one join,
broadcast only within the checked size. The labelled hosts are split by a hash: one half gives the bad shares, the other trains the
trees. Trees are grown on the driver from a bounded sample of features and sent as a few kilobytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.kernels import chunks, sampled, sums
from scriptorium.runtime import Cut, broadcast_if

#: Words that label a host bad when they stand alone between its dots and hyphens.
SEED_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")

NAMES = ("length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "dots", "hyphens", "host_hyphens", "host_digits", "labels", "upper", "escapes", "fragment", "secure", "longest_run", "log_count2", "bad2", "log_count3", "bad3")


def host_of(url: Column) -> Column:
    """Lower-cased host, without user and port; the empty string where there is none."""
    place = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":[0-9]*$", ""))


def seed_labels(pages: DataFrame, url_col: str = "url", words: tuple[str, ...] = SEED_WORDS) -> DataFrame:
    """(url, bad): bad is 1 where a word of the host is among ``words``. Null URLs are left out."""
    bad = F.arrays_overlap(F.split(host_of(F.col(url_col)), "[.-]"), F.array(*map(F.lit, words)))
    return pages.filter(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), bad.cast("int").alias("bad"))


def lexical(urls: pa.Array, hosts: pa.Array) -> np.ndarray:
    """(n, 16) features of the URLs and hosts themselves; nulls count as empty."""
    out = np.zeros((len(urls), 16))
    for a, n, data, off in chunks(urls):
        size, doc = np.diff(off).astype(np.float64), np.repeat(np.arange(n), np.diff(off))
        freq = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float64)
        some = np.maximum(size, 1)
        share = freq / some[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            entropy = -np.where(share > 0, share * np.log2(share), 0).sum(axis=1)
        word = np.zeros(256, dtype=bool)
        word[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
        edge = np.flatnonzero(np.concatenate(([True], (word[data][1:] != word[data][:-1]) | (doc[1:] != doc[:-1])))) if len(data) else np.zeros(0, dtype=np.int64)
        run = np.diff(np.append(edge, len(data))) * word[data[edge]]
        longest = np.zeros(n)
        np.maximum.at(longest, doc[edge], run)
        digits = freq[:, 48:58].sum(axis=1)
        query = freq[:, ord("=")]
        out[a : a + n] = np.column_stack((size, np.zeros(n), np.maximum(freq[:, ord("/")] - 2, 0), digits / some, entropy, query, freq[:, ord(".")], freq[:, ord("-")], np.zeros((n, 3)), freq[:, 65:91].sum(axis=1), freq[:, ord("%")], freq[:, ord("#")], np.zeros(n), longest))
        if len(data):
            at = np.minimum(off[:-1] + 4, len(data) - 1)
            out[a : a + n, 14] = (size > 4) & (data[at] == ord("s"))
    for a, n, data, off in chunks(hosts):
        size, doc = np.diff(off).astype(np.float64), np.repeat(np.arange(n), np.diff(off))
        out[a : a + n, 1] = size
        out[a : a + n, 8] = sums(doc[data == ord("-")], n)
        out[a : a + n, 9] = sums(doc[(data >= 48) & (data < 58)], n)
        out[a : a + n, 10] = sums(doc[data == ord(".")], n) + (size > 0)
    return out


@dataclass
class Trees:
    """Boosted trees over binned features; a node n has children 2n+1 and 2n+2."""

    edges: list[np.ndarray]
    start: float
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)]).astype(np.int16)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self.binned(x), np.full(len(x), self.start), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(len(f) + 1))):
                node = 2 * node + 1 + (b[rows, f[node]] > c[node])
            out += v[node - len(f)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, smooth: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss, with histograms of ``bins`` quantile bins; ``y`` are shares of bad ones of ``weight``."""
    weight = np.ones(len(x)) if weight is None else weight
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) for i in range(x.shape[1])]
    p = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
    model = Trees(edges, float(np.log(p / (1 - p))))
    b, f, margin, inner = model.binned(x).astype(np.int64), x.shape[1], np.full(len(x), model.start), (1 << depth) - 1
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = weight * (prob - y), weight * prob * (1 - prob)
        node, feature, cut = np.zeros(len(x), dtype=np.int64), np.zeros(inner, dtype=np.int64), np.full(inner, bins)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at = node - first
            gain = np.full((f, width, bins), -np.inf)
            for i in range(f):
                key = at * bins + b[:, i]
                gs = np.bincount(key, g, width * bins).reshape(width, bins)
                hs = np.bincount(key, h, width * bins).reshape(width, bins)
                gl, hl = gs.cumsum(axis=1), hs.cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                ok = (hl > 1e-3) & (ht - hl > 1e-3)
                gain[i] = np.where(ok, gl**2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth) - gt**2 / (ht + smooth), -np.inf)
            for j in range(width):
                i, c = np.unravel_index(gain[:, j].argmax(), (f, bins))
                if gain[i, j, c] > 1e-6:
                    feature[first + j], cut[first + j] = i, c
            node = 2 * node + 1 + (b[np.arange(len(x)), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + smooth)
        margin += value[leaf]
        model.feature.append(feature)
        model.cut.append(cut)
        model.value.append(value)
    return model


def host_statistics(urls: DataFrame, known: DataFrame, prior: float) -> DataFrame:
    """(host, log_s2, bad_s2, log_s3, bad_s3) of all hosts of ``urls`` (host) and ``known`` (host, n, bad, counted): for each suffix the log of its URLs,
    and the bad share of its counted labels on other hosts, drawn towards ``prior`` as by two more labels."""
    own = urls.groupBy("host").agg(F.count("*").alias("urls"))
    own = own.unionByName(known.groupBy("host").agg(F.sum(F.when(F.col("counted"), F.col("n")).otherwise(0)).alias("k"), F.sum(F.when(F.col("counted"), F.col("bad")).otherwise(0)).alias("b")), allowMissingColumns=True)
    own = own.groupBy("host").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("urls", "k", "b")))
    own = Cut(own, "own").df
    for s, depth in (("s2", -2), ("s3", -3)):
        part = F.substring_index("host", ".", depth).alias(s)
        whole = own.groupBy(part).agg(F.sum("urls").alias("wu"), F.sum("k").alias("wk"), F.sum("b").alias("wb"))
        own = own.withColumn(s, part).join(whole, s).withColumns({f"log_{s}": F.log1p("wu"), f"bad_{s}": (F.col("wb") - F.col("b") + 2 * prior) / (F.col("wk") - F.col("k") + 2)}).drop(s, "wu", "wk", "wb")
    return own.select("host", "log_s2", "bad_s2", "log_s3", "bad_s3")


def _matrix(cols: list[pa.Array]) -> np.ndarray:
    return np.column_stack((lexical(cols[0], cols[1]), *(c.to_numpy(zero_copy_only=False) for c in cols[2:])))


def url_scores(pages: DataFrame, labels: DataFrame, threshold: float = 0.5, train_rows: int = 10_000, seed: int = 5, id_col: str = "page_id", url_col: str = "url", **growth) -> DataFrame:
    """One row per page: its id, url, ``score`` (probability that it is bad) and ``keep`` (the score is under ``threshold``).

    ``labels`` has (url, bad). Trees are trained on about ``train_rows`` of its distinct URLs, chosen by a hash of the URL; a URL that is labelled
    several times has that weight, and its share of bad labels as its label. A null URL has a null score and isn't kept; an empty one
    is scored like any other, a very long one is read whole. Without labels of both classes, in all and among those that train, all
    scores are null and all URLs but null ones are kept. Repeated rows and null ids give a row each, ids are of any type, other columns are
    ignored under any name. An empty table gives an empty table.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url")).filter("url is not null").withColumn("host", host_of(F.col("url")))
    known = labels.filter("url is not null and bad is not null").groupBy(F.col("url").cast("string").alias("url")).agg(F.count("*").alias("n"), F.sum((F.col("bad") > 0).cast("double")).alias("bad")).withColumn("host", host_of(F.col("url")))
    known = Cut(known.withColumn("counted", F.pmod(F.xxhash64("host", F.lit(seed)), F.lit(2)) == 0), "known")
    n, bad, distinct = known.df.agg(F.sum("n"), F.sum("bad"), F.count_if(~F.col("counted"))).first()
    empty = pages.select(F.col(id_col), F.col(url_col), F.lit(None).cast("double").alias("score"), F.col(url_col).isNotNull().alias("keep"))
    if not n or not 0 < bad < n:
        known.drop()
        return empty
    table = Cut(host_statistics(rows, known.df, bad / n), "hosts").df
    size = table.agg(F.count("*"), F.avg(F.octet_length("host"))).first()
    table = broadcast_if(table, size[0], 64 + (size[1] or 0))
    names = ["log_s2", "bad_s2", "log_s3", "bad_s3"]

    @F.arrow_udf("array<float>")
    def features(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in parts:
            x = _matrix(list(batch)).astype(np.float32)
            yield pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float32()))

    sample = known.df.filter(~F.col("counted") & sampled(F.xxhash64("url", F.lit(seed + 1)), train_rows, distinct))
    train = sample.join(table, "host").select(features("url", "host", *names).alias("x"), F.col("n").cast("double").alias("n"), "bad", F.xxhash64("url").alias("o")).toArrow().sort_by("o").combine_chunks()
    known.drop()
    weight, share = train.column("n").to_numpy(), train.column("bad").to_numpy()
    if not len(weight) or not 0 < share.sum() < weight.sum():
        return empty
    x = train.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES)).astype(np.float64)
    model = boosted(x, share / weight, weight, **growth)

    @F.arrow_udf("double")
    def score(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in parts:
            yield pa.array(model.probability(_matrix(list(batch)).astype(np.float32).astype(np.float64)) if len(batch[0]) else np.zeros(0))

    done = rows.join(table, "host").select("id", "url", score("url", "host", *names).alias("score"))
    out = done.unionByName(pages.filter(F.col(url_col).isNull()).select(F.col(id_col).alias("id"), url.alias("url"), F.lit(None).cast("double").alias("score")))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "score", F.coalesce(F.col("score") < threshold, F.lit(False)).alias("keep"))
