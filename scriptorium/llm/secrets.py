"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger, a folder of Parquet files,
says which (blob, rule, rule version) have been scanned and what was found. A run writes its paths' blobs, scans only pairs that the
ledger lacks, each blob once however many paths hold it, then joins findings back to all paths. Of the ledger it keeps what concerns its own
blobs before anything is shuffled; contents are shuffled only where a blob occurs more than once.

Findings are written before the note that a pair was scanned: a run that dies in between is repeated, and repeated
findings count once. Rules are plain regular expressions that Java, RE2 and Python read alike (no look-around,
ASCII classes); a literal that every match must hold lets most texts skip the expression.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.runtime import Cut, broadcast_if, own_folder, split_by_keys


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """``pattern`` has one group, the secret. A match holds one of ``literals`` (in lower case where ``folded``)."""

    name: str
    version: int
    pattern: str
    literals: tuple[str, ...]
    folded: bool = False

    @property
    def tag(self) -> str:
        return f"{self.name}@{self.version}"


_START = r"(?:^|[^0-9A-Za-z_])"
_NAMES = ("password", "passwd", "secret", "token", "api_key", "api-key", "apikey")

#: Repeats have no upper bound: secrets of any length are found, and found whole.
RULES = (
    Rule("aws_access_key", 1, _START + r"((?:AKIA|ASIA)[0-9A-Z]{16})", ("AKIA", "ASIA")),
    Rule("github_token", 2, _START + r"(gh[pousr]_[0-9A-Za-z]{36,})", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack_token", 2, _START + r"(xox[abprs]-[0-9A-Za-z-]{10,})", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("google_api_key", 1, _START + r"(AIza[0-9A-Za-z_-]{35})", ("AIza",)),
    Rule("payment_key", 2, _START + r"([rs]k_(?:live|test)_[0-9A-Za-z]{10,})", ("k_live_", "k_test_")),
    Rule("private_key", 2, r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", ("PRIVATE KEY-----",)),
    Rule("json_web_token", 2, _START + r"(eyJ[0-9A-Za-z_-]{10,}[.]eyJ[0-9A-Za-z_-]{10,}[.][0-9A-Za-z_-]{10,})", (".eyJ",)),
    Rule("url_password", 2, r"[a-z]://([^ \t\n/:@]+:[^ \t\n/:@]+)@", ("://",)),
    Rule("assigned_secret", 2, "(?:" + "|".join(map(_any_case, _NAMES)) + r")[\"']?[ \t]*[:=][ \t]*[\"']?([0-9A-Za-z+/_-]{12,})", ("password", "passwd", "secret", "token", "api"), True),
)

FINDINGS = "blob binary, rule string, rule_version int, ordinal int, secret string"
SCANS = "blob binary, scanned array<string>"


def _has(text: Column, rule: Rule) -> Column:
    def any_of(t: Column) -> Column:
        out = F.lit(False)
        for x in rule.literals:
            out = out | F.contains(t, F.lit(x))
        return out

    return F.transform(F.array(F.lower(text)), any_of)[0] if rule.folded else any_of(text)  # lower-cased once, not for each literal


def _hits(text: Column, rule: Rule) -> Column:
    return F.when(_has(text, rule), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))


def _found(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of (blob, content, pending array<string>)."""
    each = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"), F.when(F.array_contains("pending", r.tag), _hits(F.col("content"), r)).alias("hits")) for r in rules))
    some = blobs.select("blob", F.explode(F.filter(each, lambda x: F.size(x["hits"]) > 0)).alias("x"))
    return some.select("blob", "x.rule", "x.rule_version", F.posexplode("x.hits").alias("ordinal", "secret")).withColumn("secret", F.sha2("secret", 256))


class Ledger:
    """Scans and findings under one folder; None takes a new one in the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{own_folder(spark)}/ledger-{uuid.uuid4().hex}"

    def _read(self, part: str, schema: str) -> DataFrame:
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        if not p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")

    def findings(self) -> DataFrame:
        return self._read("findings", FINDINGS).distinct()

    def scans(self) -> DataFrame:
        return self._read("scans", SCANS)

    def add(self, part: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{self.path}/{part}")


def _once(contents: DataFrame, blobs: DataFrame, rest: tuple[str, ...] = ()) -> DataFrame:
    """(blob, content, rest) once for each blob of ``blobs`` (blob, n). Blobs that occur once aren't shuffled; of the others the copies combine on the map side."""
    twice = blobs.filter("n > 1").select(F.col("blob").alias("key"))
    once, more = split_by_keys(contents, F.col("blob"), twice, F.col("key"), twice.count())
    return once.unionByName(more.groupBy("blob").agg(*(F.any_value(c).alias(c) for c in ("content", *rest))))


def secret_scan(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, path_cols: tuple[str, ...] = ("path", "version"), text_col: str = "content") -> DataFrame:
    """Findings for all paths: ``path_cols``, blob, rule, rule_version, ordinal (from 0, in text order), secret (SHA-256 of it).

    ``versions`` holds every historical version of every path. Null contents have no blob and no finding; an empty content
    is a blob without findings. Null paths are paths; a row that is repeated gives its findings again. Two rules may report
    one secret. Further columns are ignored under any name. An empty table gives no rows and leaves the ledger as it is.
    Contents of any length are scanned whole. With ``ledger`` (a folder) later runs scan only what is new to it;
    findings of rule versions that aren't among ``rules`` stay in the ledger and out of the result.
    """
    spark = versions.sparkSession
    books = Ledger(spark, ledger)
    text = F.col(text_col).cast("string")
    names = [f"p{i}" for i in range(len(path_cols))]
    rows = versions.filter(F.col(text_col).isNotNull())
    blob = F.unhex(F.sha2(text, 256)).alias("blob")
    tags = F.array(*(F.lit(r.tag) for r in rules)) if rules else F.array().cast("array<string>")
    refs = Cut(rows.select(*(F.col(c).alias(n) for c, n in zip(path_cols, names, strict=True)), blob), "refs").df
    blobs = Cut(refs.groupBy("blob").agg(F.count("*").alias("n")), "blobs")
    count, contents, seen = blobs.df.count(), rows.select(blob, text.alias("content")), books.scans()
    if seen.isEmpty():
        todo = blobs
        pending = _once(contents, blobs.df).withColumn("pending", tags)
        noted = blobs.df.select("blob", tags.alias("scanned"))
    else:
        _, near = split_by_keys(seen, F.col("blob"), blobs.df.select(F.col("blob").alias("key")), F.col("key"), count)
        done = near.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("scanned"))).alias("done"))
        left = F.array_except(tags, F.coalesce("done", F.array().cast("array<string>")))
        todo = Cut(blobs.df.join(done, "blob", "left").select("blob", "n", left.alias("pending")).filter(F.size("pending") > 0), "todo")
        rows_ = todo.df.count()
        _, new = split_by_keys(contents, F.col("blob"), todo.df.select(F.col("blob").alias("key")), F.col("key"), rows_)
        own = _once(new, todo.df)
        pending = own.join(broadcast_if(todo.df.select("blob", "pending"), rows_, 64 + 32 * len(rules)), "blob")
        noted = todo.df.select("blob", F.col("pending").alias("scanned"))
    books.add("findings", _found(pending, rules))
    books.add("scans", noted)
    known = F.array_contains(tags, F.concat_ws("@", "rule", F.col("rule_version").cast("string")))
    _, near = split_by_keys(books._read("findings", FINDINGS).filter(known), F.col("blob"), blobs.df.select(F.col("blob").alias("key")), F.col("key"), count)
    found = Cut(near.distinct(), "found").df
    for t in {blobs, todo}:
        t.drop()
    hit = refs.join(broadcast_if(found, found.count(), 200), "blob")
    return hit.select(*(F.col(n).alias(c) for c, n in zip(path_cols, names, strict=True)), F.lower(F.hex("blob")).alias("blob"), "rule", "rule_version", "ordinal", "secret")


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL of the scan of ``documents``."""
    each = " UNION ALL ".join("SELECT doc_id, text, '{}' AS rule, {} AS rule_version, regexp_extract_all(text, '{}', 1) AS hits FROM documents WHERE text IS NOT NULL".format(r.name, r.version, r.pattern.replace("'", "''")) for r in rules)
    return f"""
WITH each AS ({each}),
hit AS (SELECT doc_id, sha256(text) AS blob, rule, rule_version, hits, unnest(range(len(hits))) AS i FROM each WHERE len(hits) > 0)
SELECT doc_id, blob, rule, rule_version, CAST(i AS INTEGER) AS ordinal, sha256(hits[i + 1]) AS secret FROM hit
"""
