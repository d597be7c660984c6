"""Session facts shared by all operators: cut lineage, size-checked broadcasts, distributed sums.

Everything that outlives a job is written to the folder that the cluster names in
``spark.checkpoint.dir``; only where that is unset (tests, laptops) does the engine choose one.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side is sent to every executor; beyond either the join shuffles.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20
#: Largest filter of keys that is sent to every executor (16 bits a key: 64 million keys); more keys only make it less choosy.
FILTER_BYTES = 128 << 20
#: Rows that a task of a join of wide rows takes, so that its sorts stay within some hundred megabytes.
TASK_ROWS = 250_000
_BLOCK = 512

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``. Where that is unset, a local master gets a folder of its own and a
    cluster an error, since executors don't see each other's disks."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(f"spark.checkpoint.dir is unset: on {master} it must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="scriptorium-")
    return f"file://{_own_dir}"


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; the file system deletes it when the driver's JVM ends."""
    sc = spark.sparkContext
    folder = f"{shared_dir(spark)}/scriptorium-{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if fs.mkdirs(path):
        fs.deleteOnExit(path)
    return folder


class Cut:
    """A table written once to the shared folder and read back: lineage ends there, and a lost
    executor takes nothing with it. ``drop()`` deletes its files; what isn't dropped goes with the application."""

    def __init__(self, df: DataFrame, name: str = "cut"):
        self.spark = df.sparkSession
        self.path = f"{own_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if(df: DataFrame, rows: int, width: float = 16.0) -> DataFrame:
    """Hint a broadcast only when the counted ``rows``, of ``width`` bytes each, are within both bounds; otherwise leave the
    join to shuffle (sort-merge with skew splitting)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and rows * width <= BROADCAST_BYTES else df


def _place(h: Column, words: int) -> tuple[Column, Column, Column]:
    """(block, word in the block, its three bits) of a 64-bit hash."""
    at = h.bitwiseAND(F.lit(words - 1))
    mask = None
    for shift in (40, 46, 52):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int"))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return F.shiftright(at, 9), at.bitwiseAND(F.lit(_BLOCK - 1)).cast("int"), mask


def split_by_keys(df: DataFrame, key: Column, keys: DataFrame, keys_key: Column, rows: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` is surely none of ``keys``, rows whose key may be one of them, which are all of those and a few others).

    Neither part is shuffled: a blocked Bloom filter of the keys' hashes, 16 bits a key and ``most`` bytes (``FILTER_BYTES``) at the
    most, goes to the rows. ``rows`` is the number of keys. A null key is none. The plan is the same at every size.
    """
    words = _BLOCK
    while words * 64 < rows * 16 and words * 16 <= (FILTER_BYTES if most is None else most):
        words *= 2

    def dense(t: pa.Table) -> pa.Table:
        out = np.zeros(_BLOCK, dtype=np.int64)
        out[t.column("slot").to_numpy()] = t.column("bits").to_numpy()
        return pa.table({"fblock": t.column("fblock").slice(0, 1), "fwords": pa.array([out], pa.list_(pa.int64()))})

    block, slot, mask = _place(F.xxhash64(keys_key), words)
    sparse = keys.filter(keys_key.isNotNull()).select(block.alias("fblock"), slot.alias("slot"), mask.alias("mask")).groupBy("fblock", "slot").agg(F.bit_or("mask").alias("bits"))
    table = sparse.groupBy("fblock").applyInArrow(dense, "fblock long, fwords array<long>")
    b, w, m = (free_name(df, x) for x in ("block", "words", "may"))
    block, slot, mask = _place(F.xxhash64(key), words)
    table = table.select(F.col("fblock").alias(b), F.col("fwords").alias(w))
    rows_ = df.withColumn(m, F.when(key.isNotNull(), block)).withColumnRenamed(m, b).join(F.broadcast(table), b, "left")
    may = F.coalesce(F.col(w)[slot].bitwiseAND(mask) == mask, F.lit(False))
    return rows_.filter(~may).select(*df.columns), rows_.filter(may).select(*df.columns)


def without_keys(df: DataFrame, col: str, keys: DataFrame, rows: int) -> DataFrame:
    """``df`` without the rows whose ``col`` is in ``keys`` (one column of the same type). Up to the broadcast bound the keys go to the
    rows; beyond it only rows that the filter doesn't clear are shuffled."""
    name = free_name(df, "key")
    keys = keys.toDF(name)
    if rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(keys), df[col] == keys[name], "left_anti")
    sure, may = split_by_keys(df, F.col(col), keys, F.col(name), rows)
    return sure.unionByName(may.join(keys, F.col(col) == F.col(name), "left_anti"))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` over all shuffle partitions by ``cols``: for heavy work on few bytes, which adaptive coalescing would put into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def task_parts(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows, ``TASK_ROWS`` each at the most; 0 where one task can take them all."""
    return 0 if rows <= TASK_ROWS else max(-(-rows // TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))


def parted(df: DataFrame, parts: int, *cols: str) -> DataFrame:
    """``df`` in ``parts`` partitions by ``cols``, which adaptive coalescing leaves alone; as it is where ``parts`` is 0."""
    return df.repartition(parts, *cols) if parts else df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet, ignoring case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder (a Parquet file, or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
