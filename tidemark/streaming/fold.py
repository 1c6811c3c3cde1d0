"""Folding arriving quarters of facts into a stored chain with Structured Streaming.

A fact that lands in the middle of its chain is late data of the ordinary kind: its key's chain is rebuilt whole.

``data/version=N/bucket=B`` holds a hash bucket of the keys as batch N left it, ``manifest/version=N`` says which version
holds each bucket after batch N.  A batch reads and writes the buckets of its own keys only; the others keep their files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.temporal import FACT_KEY, fold_chain, vintage_chain


def _held(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The version that holds each bucket, as of the newest manifest (below version ``before``); a row a bucket."""
    manifests = spark.read.parquet(f"{path}/manifest")
    if before is not None:
        manifests = manifests.where(F.col("version") < before)
    newest = manifests.agg(F.max("version")).first()[0]
    return {r["bucket"]: r["at"] for r in manifests.where(F.col("version") == newest).collect()}


def _read(spark: SparkSession, path: str, held: dict[int, int]) -> DataFrame:
    folders = [f"{path}/data/version={at}/bucket={bucket}" for bucket, at in sorted(held.items())]
    return spark.read.option("basePath", f"{path}/data").parquet(*folders).drop("version")


def fold_stream(arriving: DataFrame, path: str, checkpoint: str, keys=FACT_KEY, source: str = "adsh", buckets: int = 16, year_of: str = "value_date", **chain) -> StreamingQuery:
    """Fold a stream of typed facts into chains below ``path``, in buckets of the key (how they are cut stays as first chosen).

    Where ``year_of`` is one of the keys, a bucket is a year of it and a hash of the key, for a quarter's facts are about the last
    two or three years and leave the buckets of all others alone; else it is a hash.  Only buckets that a batch touches are read and rewritten, below the batch's own version; the manifest follows the data, so
    a batch that is lost between the two, or replayed, gives the same tables.  Null keys are keys like others; a batch without
    rows changes nothing.  Old versions stay for readers until their folders (``superseded``) are removed from the storage.
    """
    keys = list(keys)
    year = F.coalesce(F.year(year_of), F.lit(0)) if year_of in keys else F.lit(0)
    bucket = (year * buckets + F.pmod(F.xxhash64(*keys), F.lit(buckets))).cast("int")

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", bucket).persist()
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}
        held = _held(spark, path, number) if number else {}
        known = {b: at for b, at in held.items() if b in touched}
        if touched:
            if known:
                old = _read(spark, path, known)
                out = fold_chain(old, new.select(*[c for c in old.columns if c in new.columns]), keys, source, **chain)
            else:
                out = vintage_chain(new, keys, **chain)
            out.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={number}")
        now = held | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "bucket int, at int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={number}")
        new.unpersist()

    return arriving.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_chain(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of the stored chains."""
    return _read(spark, path, _held(spark, path)).drop("bucket")


def superseded(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Bucket folders that none of the newest ``keep`` manifests names."""
    manifests = spark.read.parquet(f"{path}/manifest")
    versions = sorted(r[0] for r in manifests.select("version").distinct().collect())
    recent = F.col("version").isin(versions[-keep:])
    old = manifests.select("bucket", "at").distinct().exceptAll(manifests.where(recent).select("bucket", "at").distinct())
    return sorted(f"{path}/data/version={r['at']}/bucket={r['bucket']}" for r in old.collect())
