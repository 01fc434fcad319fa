"""What the operators of this subpackage share: words, row keys, checkpoints, batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters. bytes.split() splits at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of our own only where none is set and the session is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loam-checkpoint-")
    return found


#: Rows and bytes of a batch that goes to a task's Python process, at most.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's tasks get whole texts in batches of these sizes at most: what they hold is bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with files in the shared folder, so a lost executor costs no recomputation."""
    small_batches(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager)


def id_key(column: str = "doc_id") -> Column:
    """An id as text that is never null, for joins in which null ids meet null ids."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_digest(column: str = "text", key: bytes = b"") -> Column:
    """16 bytes of SHA-256 that name a text; null as the empty one. Under a key that a run keeps to itself, none can be made to meet."""
    return F.substring(F.unhex(F.sha2(F.concat(F.lit(key), F.coalesce(F.col(column).cast("binary"), F.lit(b""))), 256)), 1, 16)


def word_count(text: Column) -> Column:
    """Number of words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: later uses don't compute it anew."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{checkpoint_dir(spark)}/loam-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a bitmap, at least and at most (64 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29


@dataclass(frozen=True)
class Bits:
    """A bitmap of hashes: has() may be true because of another hash, but never false for one of its own."""

    table: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """For each hash (unsigned, 64 bits) whether its bit is set."""
        place = hashes & np.uint64(8 * len(self.table) - 1)
        return (self.table[(place >> np.uint64(3)).astype("i8")] >> (place & np.uint64(7)).astype("u1") & 1).astype(bool)


def bits_of(hashes: DataFrame, n: int) -> Bits:
    """A bitmap of the 64-bit hashes in the column hash, of which there are n: 16 bits for each, MOST_BITS at most.

    Fuller bitmaps only let more through, so what has() passes must be judged exactly afterwards.
    """
    size = LEAST_BITS
    while size < min(16 * n, MOST_BITS):
        size *= 2
    place = hashes.select(F.col("hash").bitwiseAND(F.lit(size - 1)).alias("place"))
    parts = place.groupBy(F.shiftright("place", 15).alias("part")).agg(F.bitmap_construct_agg(F.pmod("place", F.lit(1 << 15))).alias("bits")).collect()
    table = np.zeros(size // 8, "u1")
    for r in parts:
        table[r["part"] << 12 : (r["part"] + 1) << 12] = np.frombuffer(r["bits"], "u1")
    return Bits(table)


#: Rows of one key from which a join splits it, at least, and keys that are split, at most.
HOT_ROWS, HOT_KEYS = 2000, 10_000


def split_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join of left and right on a column, in which keys with many rows on the left are split over tasks.

    left is read twice, so it should be a written table. A key with HOT_ROWS rows or more, and at least one in HOT_KEYS
    of all, has its rows on the left dealt over salts and its rows on the right repeated for each; there are HOT_KEYS
    such keys at most, which is what is broadcast. Without any key of HOT_ROWS rows it is a plain join.
    """
    if left.groupBy(key).count().filter(F.col("count") >= HOT_ROWS).isEmpty():
        return left.join(right, key)
    bar = max(HOT_ROWS, left.count() // HOT_KEYS)
    hot = left.groupBy(key).count().filter(F.col("count") >= bar).select(F.col(key).alias("__hot"), F.ceil(F.col("count") / bar).cast("int").alias("__salts"))
    salts = lambda df: df.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    dealt = salts(left).withColumn("__salt", F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.col("__salts"))).cast("int"))
    repeated = salts(right).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)))
    return dealt.drop("__hot", "__salts").join(repeated.drop("__hot", "__salts"), [key, "__salt"]).drop("__salt")
