"""Exact dedup: group by 128-bit content hash, compare bytes inside groups, keep the smallest id.

Two passes. The first shuffles 16 bytes per document and finds the hashes that occur more than once. In the second a Bloom filter of these
lets documents pass without a shuffle whose hash is surely none of them; only members of repeated hashes, and the few others that the
filter holds back, travel, grouped by (hash, text), which compares the bytes themselves, so two texts that share a hash stay apart.
Copies combine on the map side: a text with a million copies is sent once by each task that holds it. The plan is the same at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.runtime import Cut, free_name, split_by_keys


def content_hash(text: Column) -> Column:
    """128-bit hash of the text's bytes, as 16 bytes."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """One row per distinct text: the one with the smallest id, with all its columns.

    Null texts are no content: such rows all stay. The empty text is a text like any other, a very long one is compared whole. A null id
    sorts after all others. Of repeated rows (same id and text) one stays; where they differ in further columns, the one whose JSON form is
    least. Ids are of any type that sorts. Further columns pass through under any name. An empty table gives an empty table. ``hash_of``
    can be replaced to test collisions.
    """
    h, cols = free_name(docs, "hash"), docs.columns
    hashed = docs.withColumn(h, hash_of(F.col(text_col)))
    repeated = Cut(hashed.filter(F.col(text_col).isNotNull()).groupBy(h).count().filter("count > 1").select(F.col(h).alias("key")), "repeated")
    rows = repeated.df.count()
    if not rows:
        repeated.drop()
        return docs
    once, members = split_by_keys(hashed, F.col(h), repeated.df, F.col("key"), rows)
    rest = [F.col(c) for c in cols if c != text_col and c != id_col]
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.to_json(F.struct(*rest)) if rest else F.lit(""))
    row, kept = free_name(docs, "row"), [c for c in cols if c != text_col]
    best = members.groupBy(h, text_col).agg(F.min_by(F.struct(*kept), order).alias(row))
    return once.select(*cols).unionByName(best.select(*[F.col(text_col) if c == text_col else F.col(row)[c].alias(c) for c in cols]))


ORACLE = """
SELECT doc_id, text, lang, source, n_chars FROM documents
QUALIFY text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1
"""
