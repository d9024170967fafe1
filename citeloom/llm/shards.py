"""Two-pass shuffle into shards: scatter by seeded hashes into memory-sized buckets, permute each bucket, write it.

Pass one sends each record to (shard, bucket). The shard follows from the id and the number of shards alone: of the
numbers j below it, the last whose seeded hash of (id, j) is divisible by j + 1. One more shard adds one more j, so it
takes rows only into itself. Buckets divide a shard by a second hash, of id and text, as many as keep a bucket near
``bucket_bytes`` and ``bucket_rows``.
Pass two ranks the records of a bucket and maps ranks through a Fisher-Yates permutation: for i from the last place down, i is
exchanged with a place drawn from the hash of (seed, shard, bucket, i). The permutation of a bucket is one expression over a
string of four-byte numbers. Bucket offsets, one row per bucket, make the slots of a shard gapless. Data and seed decide every
slot; neither partitions nor their order do.

Edge cases: a null text counts 16 bytes and is written as null. Rows of one id share a shard, and are dealt out to its buckets by
their texts; rows that are equal in both share a bucket and are interchangeable there. A null id is hashed like an id of its own.
A very long text is a bucket's only large row at worst; texts are not copied in pass two. An empty table gives no rows. Other
columns are carried through; shard and slot columns replace columns of the same names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROW_BYTES = 16
BUCKET_BYTES = 16 * 1024 * 1024
BUCKET_ROWS = 4096


def record_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(ROW_BYTES)


def shard_of(id_col: str, shards: int, seed: int = 17) -> Column:
    takes = F.filter(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda j: F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), j), j.cast("long") + 1) == 0,
    )
    return F.array_max(takes).cast("int")


def fisher_yates(n: Column, seed: int, *names: Column) -> Column:
    """The permutation of 0 .. n - 1 that the seed and ``names`` decide, as an array."""
    long = lambda x: F.lit(x).cast("long")
    entry = lambda codes, i: F.substring(codes, (4 * i + 1).cast("int"), F.lit(4))
    put = lambda codes, value, i: F.overlay(codes, value, (4 * i + 1).cast("int"), F.lit(4))

    def exchange(codes: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed), *names, i), i + 1)
        return put(put(codes, entry(codes, j), i), entry(codes, i), j)

    places = F.sequence(long(0), n - 1)
    whole = F.unhex(F.array_join(F.transform(places, lambda x: F.lpad(F.hex(x), 8, "0")), ""))
    down = F.filter(F.reverse(places), lambda i: i > 0)
    digits = F.regexp_extract_all(F.hex(F.aggregate(down, whole, exchange)), F.lit("[0-9A-F]{8}"), F.lit(0))
    return F.transform(digits, lambda d: F.conv(d, 16, 10).cast("long"))


def place(
    records: DataFrame, shards: int, id_col: str = "doc_id", text: str = "text", seed: int = 17,
    bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The records with ``shard`` and ``slot``. Records move once; counts and permutations carry no texts."""
    size, n = records.select(F.sum(record_size(text)), F.count(F.lit(1))).first()
    buckets = max(1, math.ceil((size or 0) / (shards * bucket_bytes)), math.ceil(n / (shards * bucket_rows)))
    keyed = records.withColumns({
        "__shard": shard_of(id_col, shards, seed),
        "__bucket": F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col(text)), F.lit(buckets)).cast("int"),
    })
    before = W.partitionBy("__shard").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    permuted = (
        keyed.groupBy("__shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .withColumn("__order", fisher_yates(F.col("__n"), seed, F.col("__shard"), F.col("__bucket")))
        .drop("__n")
    )
    inside = W.partitionBy("__shard", "__bucket").orderBy(id_col, F.xxhash64(F.col(text)), text)
    ranked = keyed.withColumn("__rank", F.row_number().over(inside))
    slot = F.col("__offset") + F.get(F.col("__order"), F.col("__rank") - 1)
    out = ranked.join(permuted, ["__shard", "__bucket"])
    kept = [c for c in records.columns if c not in ("shard", "slot")]
    return out.select(*kept, F.col("__shard").alias("shard"), slot.alias("slot"))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, in slot order within each bucket's file."""
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
