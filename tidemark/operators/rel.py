"""Relational primitives: first per group, upserts, checks, digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order`` (a total order, with explicit null placement, gives a stable result)."""
    return top_k_per_group(df, keys, order, 1)


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def parts_for(df: DataFrame, rows: int = 250_000) -> int:
    """Into how many tasks to deal ``df`` by key for about ``rows`` rows each, whatever its size; counts it."""
    return -(-df.count() // rows) or 1


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition where a null key equals a null key."""
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[k])
    return on


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_r_{k}") for k in keys])


def semi(df: DataFrame, keys_of: DataFrame, keys: Sequence[str], how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose keys (nulls equal) occur, or with ``left_anti`` do not occur, in ``keys_of``."""
    other = _renamed(keys_of, keys)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return df.join(other, on, how)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], overwrite: bool = True) -> DataFrame:
    """Insert ``new`` into ``old``; on a key conflict the new row wins (or with ``overwrite=False`` the old one)."""
    if overwrite:
        return semi(old, new, keys, "left_anti").unionByName(new)
    return old.unionByName(semi(new, old, keys, "left_anti"))


def replace_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete the rows of every key in ``new``, then insert ``new`` (several rows a key allowed)."""
    return upsert(old, new, keys)


def union_prefer(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Per key the row of the first part that has one; ``order`` ranks rows before the part's position does."""
    ranked = [p.withColumn("_pref", F.lit(i)) for i, p in enumerate(parts)]
    out = ranked[0]
    for p in ranked[1:]:
        out = out.unionByName(p)
    return first_per_group(out, keys, [*order, F.col("_pref").asc()]).drop("_pref")


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def changed_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """The first row per key and every row in which some value differs (nulls equal) from the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.row_number().over(w) == 1
    for v in values:
        change = change | ~F.col(v).eqNullSafe(F.lag(v).over(w))
    return df.withColumn("_changed", change).where("_changed").drop("_changed")


class CheckFailed(ValueError):
    """A table breaks one of its constraints."""


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    bad = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if bad:
        raise CheckFailed(f"{list(keys)} repeats: {bad[0].asDict()}")
    return df


def assert_check(df: DataFrame, condition: Column, what: str) -> DataFrame:
    """Every row meets the condition; null counts as met, as in SQL constraints."""
    bad = df.where(~F.coalesce(condition, F.lit(True))).limit(1).collect()
    if bad:
        raise CheckFailed(f"{what}: {bad[0].asDict()}")
    return df


def assert_non_overlapping(df: DataFrame, keys: Sequence[str], lo: str, hi: str) -> DataFrame:
    """Half-open intervals of a key never overlap; a null end is open."""
    w = Window.partitionBy(*keys).orderBy(F.col(lo).asc(), F.col(hi).asc_nulls_last())
    ahead = F.lead(lo).over(w)
    bad = df.withColumn("_next", ahead).where(F.col("_next").isNotNull() & (F.col(hi).isNull() | (F.col(hi) > F.col("_next")))).limit(1).collect()
    if bad:
        raise CheckFailed(f"intervals overlap: {bad[0].asDict()}")
    return df


def table_digest(df: DataFrame) -> DataFrame:
    """(rows, digest): a digest of the rows that does not depend on their order, added up without collecting them.

    A field goes in with its length before it and a null as a mark of its own, so no two rows look alike.
    """
    text = lambda c: F.col(f"`{c}`").cast("string")
    row = F.concat(F.lit(""), *[F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("~")) for c in sorted(df.columns)])
    part = lambda i: F.sum(F.conv(F.substring(F.md5(row), i, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count("*").alias("rows"), F.md5(F.concat_ws("-", *[F.coalesce(part(i), F.lit("0")) for i in (1, 9, 17, 25)])).alias("digest"))
