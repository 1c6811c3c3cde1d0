"""Two-pass external shuffle into shards (DataFrame functions only).

Pass 1 scatters records uniformly into memory-sized buckets with seeded hashes, pass 2 shuffles each bucket (Spark's
``shuffle`` is a seeded Fisher-Yates over the bucket's array) and lays the buckets of a shard out one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import scratch_path, table


def rendezvous(key: Column, n: int, seed: int) -> Column:
    """Shard 0..n-1 with the highest seeded hash: with one more shard, rows move only into the new one."""
    scored = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("h"), F.lit(i).alias("shard")) for i in range(n)]
    return F.array_max(F.array(*scored))["shard"]


def external_shuffle(df: DataFrame, key: str, size: str, n_shards: int, seed: int = 17, bucket_bytes: int = 4 << 20) -> DataFrame:
    """All rows of ``df`` with ``shard``, ``slot`` (gapless from 0 in each shard) and ``grown_shard`` (with one more shard).

    Law ``key``: the key's value and the shard count alone decide the shard; a null key is a key of its own.  A bucket
    holds about ``bucket_bytes`` by the column ``size``; rows equal in every column are ties of one bucket and keep
    distinct slots.  An empty table gives an empty result; columns of ``df`` called shard, slot or grown_shard are
    refused.
    """
    if clash := {"shard", "slot", "grown_shard"} & set(df.columns):
        raise ValueError(f"columns already present: {sorted(clash)}")
    total = df.agg(F.sum(size)).first()[0] or 0
    per_shard = max(1, -(-int(total) // (n_shards * bucket_bytes)))
    key_value, record = F.coalesce(F.col(key).cast("string"), F.lit("\x00null")), F.struct(*[F.col(f"`{c}`") for c in df.columns])
    scattered = df.select(
        rendezvous(key_value, n_shards, seed).alias("shard"),
        rendezvous(key_value, n_shards + 1, seed).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), *[F.col(f"`{c}`") for c in df.columns]), F.lit(per_shard)).alias("bucket"),
        record.alias("record"),
    )
    counts = scattered.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    # a bucket's first slot travels with its records: nothing is joined or sent to all.  Dealt by range, buckets stay in the
    # order of shards for write_shards without a second exchange of the records
    dealt = scattered.unionByName(first, allowMissingColumns=True).repartitionByRange("shard", "bucket")
    rows = F.collect_list(F.when(F.col("record").isNotNull(), F.struct("record", "grown_shard")))
    buckets = dealt.groupBy("shard", "bucket").agg(F.max("first").alias("first"), F.sort_array(rows).alias("rows"))
    placed = buckets.sortWithinPartitions("shard", "bucket").select("shard", "first", F.posexplode(F.shuffle("rows", F.lit(seed + 2))).alias("at", "row"))
    return placed.select(
        *[F.col("row.record")[c].alias(c) for c in df.columns],
        F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("at")).cast("long").alias("slot"),
        F.col("row.grown_shard").cast("int").alias("grown_shard"),
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write a result of ``external_shuffle``, one folder per shard, each in slot order over its files."""
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0..15: whole records are shuffled and written, and the digests come from the written shards.
    Null text has size 1 and the checksum of no bytes."""
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    out = external_shuffle(table(spark, sf_dir, "documents").withColumn("_size", size), "doc_id", "_size", 16).drop("_size")
    path = scratch_path(spark, "shards")
    write_shards(out, path)
    written = spark.read.schema(out.schema).parquet(path)
    return written.select(
        "doc_id", size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
