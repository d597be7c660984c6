"""Mixing sources to target weights in blocks of fixed length.

1. Packing. Tokens are the ids of a byte-level BPE. Each source is one stream of the ids of its documents, ordered by a hash bucket of id and
   text, then by id; every ``length`` ids make a block. Texts are encoded once, into a written table of packed ids; a sum over it gives the
   tokens of each (source, bucket), and running sums in two levels give the place where a bucket begins, so that buckets are packed
   independently and a hot source is spread like any other. Only the last block of a source may be shorter.
2. Drawing. Each output shard draws its number of blocks per source from a multinomial of the target weights, by a
   generator seeded with the shard's number.
3. Mapping. The slots of a source, counted through all shards, go through a pseudorandom permutation of the source's block
   indices (a Feistel network, walked until it falls inside), another one each time the source has been used up: no block
   is repeated before all of its source have been used. A slot's place in its shard is permuted likewise.
4. Joining. Blocks and slots meet by (source, index); pieces are gathered into blocks by the same key, in the same shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from scriptorium.llm.bpe import VOCABULARY, Batcher, Decoder, _batcher, gather, read_ranks, sent_vocabulary
from scriptorium.llm.kernels import mix
from scriptorium.runtime import Cut, broadcast_if

#: Documents in a packing bucket, on average.
BUCKET = 2000
#: Tokens that are cut at once: some 30 MB of a worker's memory as text. What is cut doesn't depend on it.
CUT = 1 << 17


def permuted(j: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of j under the permutation ``key`` of 0..n-1, element by element."""
    j, n, key = (np.asarray(x).astype(np.uint64) for x in (j, n, key))
    bits = np.ceil(np.log2(np.maximum(n.astype(np.float64), 2)) / 2 + 1e-9).astype(np.uint64)
    low = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = j.copy(), np.arange(len(j))
    while len(todo):
        b, m, k = bits[todo], low[todo], key[todo]
        left, right = out[todo] >> b, out[todo] & m
        for r in range(4):
            left, right = right, left ^ (mix(right ^ mix(k, r), r + 9) & m)
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def source_key(source: Column) -> Column:
    """A string that tells null from all names."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _tokenized(docs: DataFrame, id_col: str, text_col: str, source_col: str, path: str, seed: int) -> DataFrame:
    """(skey, id, h, n, ids, rest): source, id, hash of id and text, and the packed token ids of every text that isn't null."""
    sent = sent_vocabulary(docs.sparkSession, path)

    @F.arrow_udf("struct<n:bigint,ids:binary>")
    def packed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        b = _batcher(sent)
        for texts in parts:
            counts, ids = encoded_packs(b, texts)
            yield pa.StructArray.from_arrays([counts, ids], ["n", "ids"])

    text = F.col(text_col).cast("string")
    rest = F.struct(*(F.col(c) for c in docs.columns if c != text_col))
    rows = docs.filter(F.col(text_col).isNotNull()).select(source_key(F.col(source_col)).alias("skey"), F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text, F.lit(seed)).alias("h"), packed(text).alias("t"), rest.alias("rest"))
    return rows.select("skey", "id", "h", F.col("t.n").alias("n"), F.col("t.ids").alias("ids"), "rest")


def id_type(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.int32


def packs(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each slice of the ids as compressed bytes: two thirds of their size, which is disk and shuffle saved."""
    pack, raw, at = zstandard.ZstdCompressor(level=1).compress, memoryview(ids.tobytes()), (bounds * ids.itemsize).tolist()
    return pa.array([pack(raw[a:b]) for a, b in zip(at, at[1:])], pa.binary())  # noqa: B905


def encoded_packs(b: Batcher, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(number of ids, packed ids) of each text; ids are packed part by part, so that those of a whole batch are never held at once."""
    counts, packed, kind = [pa.array([], pa.int64())], [pa.array([], pa.binary())], id_type(len(b.enc.token))
    for ids, n in b.encoded(texts):
        counts.append(pa.array(n, pa.int64()))
        packed.append(packs(ids.astype(kind), np.concatenate(([0], np.cumsum(n)))))
    return pa.concat_arrays(counts), pa.concat_arrays(packed)


def unpacks(packed: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, number of each)."""
    unpack = zstandard.ZstdDecompressor().decompress
    raw = [unpack(p) for p in packed]
    return np.frombuffer(b"".join(raw), dtype=kind), np.array([len(r) for r in raw], dtype=np.int64) // kind().itemsize


def _pieces(rows: DataFrame, length: int, sent: Broadcast, as_text: bool) -> DataFrame:
    """Cuts (skey, bucket, base, n, ids, rest), grouped by bucket and ordered, into (skey, block, seq, n_tokens, piece, rest). A piece is packed ids, or their
    text: a character whose bytes lie in two blocks goes with the block in which it begins."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Decoder(sent.value[1])
        lens, kind = np.diff(enc.offsets), id_type(len(enc.token))
        group, used = None, 0
        for whole in batches:
            upto = np.concatenate(([0], np.cumsum(whole.column(3).to_numpy())))
            lo = 0
            while lo < whole.num_rows:
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + CUT, side="right")) - 1)
                b = whole.slice(lo, min(hi, whole.num_rows) - lo)
                lo += b.num_rows
                n, base = b.column(3).to_numpy(), b.column(2).to_numpy()
                begin = np.zeros(len(n), dtype=np.int64)
                for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                    if key != group:
                        group, used = key, int(base[i])
                    begin[i] = used
                    used += int(n[i])
                many = (begin + n - 1) // length - begin // length + 1
                owner = np.repeat(np.arange(len(n)), many)
                block = begin[owner] // length + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
                start, end = np.maximum(begin[owner], block * length), np.minimum(begin[owner] + n[owner], (block + 1) * length)
                flat = unpacks(b.column(4).to_pylist(), kind)[0]
                bounds = np.append(start - begin[owner] + (np.cumsum(n) - n)[owner], len(flat))
                if as_text:
                    data = gather(enc.blob, enc.offsets[flat], lens[flat])
                    place = np.concatenate(([0], np.cumsum(lens[flat])))[bounds]
                    lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                    made = pa.StringArray.from_buffers(len(owner), pa.py_buffer(lead[np.searchsorted(lead, place)].astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
                else:
                    made = packs(flat, bounds)
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(block), pa.array(start % length), pa.array(end - start), made, b.column(5).take(take)], ["skey", "block", "seq", "n_tokens", "piece", "rest"])

    out = StructType([StructField("skey", StringType()), *(StructField(c, LongType()) for c in ("block", "seq", "n_tokens")), StructField("piece", StringType() if as_text else BinaryType()), rows.schema["rest"]])
    return rows.mapInArrow(cut, out)


def tempered(tokens: dict[str, int], power: float) -> dict[str, float]:
    return {s: n**power for s, n in tokens.items() if n > 0}


def drawn(shard: int, slots: int, weights: np.ndarray, seed: int) -> np.ndarray:
    """Blocks per source of one shard."""
    return np.random.default_rng((seed, shard)).multinomial(slots, weights)


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.7, length: int = 512, shard_slots: int = 4096, ratio: float = 1.0, seed: int = 17, buckets: int | None = None, as_text: bool = False, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per output slot: shard, slot, source, epoch, block, n_tokens, and ``pieces``, an array of (seq, piece, rest) in stream order: where in
    the block a document's part begins, its packed token ids (see :func:`unpacks`; 2 bytes each for vocabularies up to 65,536, else 4) or, ``as_text``, its text, and a struct of
    the document's other columns.

    ``weights`` are the targets by source (sources it lacks get none); without them a source's target is its number of tokens to
    the ``power``. As many blocks are drawn as there are, times ``ratio``; shards have ``shard_slots`` of them, the last the rest.
    epoch counts how often the source had been used up before.

    Texts that are null or empty hold no token and are in no block. A null source is a source of its own. Null ids come first in their
    bucket; rows with the same id follow by a hash of their text, and each counts; ids are of any type that sorts. A piece of a very long text is as
    long as a block, whatever its script. Further columns go along in ``rest`` under any name. An empty table gives an empty table. All sources' names
    and totals are on the driver; a weighted source without tokens is ignored, and where no weighted source has tokens there are no rows.
    ``buckets`` is the number of packing buckets; by default one for ``BUCKET`` documents, so that the order of the streams, not their content,
    changes with the number of documents: name it to keep the order. Rows equal in id and text share a bucket, which is streamed through one task.
    """
    if length < 1 or shard_slots < 1:
        raise ValueError("length and shard_slots must be at least 1")
    spark, sent = docs.sparkSession, sent_vocabulary(docs.sparkSession, path)
    packed = Cut(_tokenized(docs, id_col, text_col, source_col, path, seed), "tokens")
    buckets = buckets or max(1, -(-packed.df.count() // BUCKET))
    rows = packed.df.filter("n > 0").withColumn("bucket", F.pmod("h", F.lit(buckets)))
    counted = Cut(rows.groupBy("skey", "bucket").agg(F.sum("n").alias("n")), "counted")
    tokens = {r.skey: r.n for r in counted.df.groupBy("skey").agg(F.sum("n").alias("n")).collect()}
    wanted = tempered(tokens, power) if weights is None else {("null" if s is None else f"={s}"): w for s, w in weights.items()}
    names = sorted(s for s, w in wanted.items() if w > 0 and tokens.get(s, 0) > 0)
    share = np.array([wanted[s] for s in names], dtype=np.float64)
    sizes = np.array([-(-tokens[s] // length) for s in names], dtype=np.int64)
    total = int(round(ratio * sum(-(-n // length) for n in tokens.values()))) if names else 0
    shards = -(-total // shard_slots)
    share = share / share.sum() if len(share) else share

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                n = drawn(shard, min(shard_slots, total - shard * shard_slots), share, seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard)), pa.array(np.arange(len(n), dtype=np.int64)), pa.array(n), pa.array(np.cumsum(n) - n)], ["shard", "s", "n", "at"])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, s, n, at, start = (b.column(i).to_numpy() for i in range(5))
            for lo in range(0, len(n), 256):
                part = slice(lo, lo + 256)
                m = n[part]
                within = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                sh, src = np.repeat(shard[part], m), np.repeat(s[part], m)
                j = np.repeat(start[part], m) + within
                epoch, size = j // sizes[src], sizes[src]
                key = mix(src.astype(np.uint64), seed) ^ mix(epoch.astype(np.uint64), seed + 1)
                block = permuted(j - epoch * size, size, key)
                full = np.minimum(shard_slots, total - sh * shard_slots)
                slot = permuted(np.repeat(at[part], m) + within, full, mix(sh.astype(np.uint64), seed + 2))
                yield pa.RecordBatch.from_arrays([pa.array(sh), pa.array(slot), pa.array(np.array(names, dtype=object)[src], pa.string()), pa.array(epoch), pa.array(block)], ["shard", "slot", "skey", "epoch", "block"])

    draws = spark.range(shards).mapInArrow(draw, "shard long, s long, n long, at long")
    before = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    plan = draws.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).mapInArrow(slots, "shard long, slot long, skey string, epoch long, block long")

    high = F.floor(F.col("bucket") / 1024).alias("high")  # running sums in two levels, so that no task sees all buckets of a source
    groups = counted.df.groupBy("skey", high).agg(F.sum("n").alias("n"))
    groups = groups.select("skey", "high", F.coalesce(F.sum("n").over(Window.partitionBy("skey").orderBy("high").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    up = Window.partitionBy("skey", "high").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.df.withColumn("high", high).select("skey", "high", "bucket", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("within"))
    base = base.join(groups, ["skey", "high"]).select("skey", "bucket", (F.col("before") + F.col("within")).alias("base"))
    wide = max((len(s) for s in tokens), default=0)
    rows = rows.filter(F.col("skey").isin(names)) if len(names) < len(tokens) else rows
    rows = rows.join(broadcast_if(base, buckets * len(tokens), 32 + wide), ["skey", "bucket"]).repartition("skey", "bucket").sortWithinPartitions("skey", "bucket", "id", "h")
    used = _pieces(rows.select("skey", "bucket", "base", "n", "ids", "rest"), length, sent, as_text)
    blocks = used.groupBy("skey", "block").agg(F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("seq", "piece", "rest")), lambda p, q: (p["seq"] - q["seq"]).cast("int")).alias("pieces"))
    # the plan has a row for every block: it is hashed part by part, never broadcast on the strength of an estimate
    out = blocks.join(plan.hint("shuffle_hash"), ["skey", "block"])
    return out.select("shard", "slot", F.expr("CASE WHEN skey <> 'null' THEN substring(skey, 2) END").alias("source"), "epoch", "block", "n_tokens", "pieces")


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", path: str = VOCABULARY, **params) -> DataFrame:
    """:func:`mixed` with the blocks as ``token_ids`` (array, ``length`` of them but in a source's last block), ``doc_ids`` and ``doc_starts`` (arrays: the
    documents in the block, and where each one's part begins)."""
    size = max(read_ranks(path).values()) + 1
    kind = id_type(size)

    @F.arrow_udf("array<int>")
    def unpacked(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in parts:
            flat, sizes = unpacks(lists.flatten().to_pylist(), kind)
            upto = np.concatenate(([0], np.cumsum(sizes)))
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            yield pa.ListArray.from_arrays(pa.array(upto[ends].astype(np.int32)), pa.array(flat.astype(np.int32)))

    out = mixed(docs, id_col=id_col, path=path, **params)
    ids = unpacked(F.transform("pieces", lambda p: p["piece"]))
    return out.select("shard", "slot", "source", "epoch", "block", "n_tokens", F.transform("pieces", lambda p: p["rest"][id_col]).alias("doc_ids"), F.transform("pieces", lambda p: p["seq"]).alias("doc_starts"), ids.alias("token_ids"))


def mixed_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", **params) -> DataFrame:
    """:func:`mixed` as rows with the columns of ``docs``: each is the part of a document that lies in a drawn block, once for every
    time that block was drawn. A character goes with the block in which it begins; parts that hold no whole character's beginning
    have no row. ``length_col``, where the table has it, is the part's number of characters."""
    out = mixed(docs, text_col=text_col, as_text=True, **params).select(F.explode("pieces").alias("p")).filter(F.col("p.piece") != "")
    text = F.col("p.piece")
    return out.select(*(text.alias(c) if c == text_col else F.length(text).cast("long").alias(c) if c == length_col else F.col("p.rest")[c].alias(c) for c in docs.columns))
