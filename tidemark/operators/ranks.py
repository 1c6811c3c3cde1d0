"""Ranks, percentiles and equal buckets over groups of any size.

A window over a group runs in one task.  Groups beyond a size are cut instead: a sample of their order keys, bounded by the
number of pieces, gives thresholds; rows go to the piece between two thresholds, are numbered inside it, and the sizes of the
pieces before it, added up, make that a number in the whole group.  Equal values that lie in several pieces get the rank of
the first of them, carried over the borders.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group that one task may sort; pieces are meant to have half of it.
LARGE = 2_000_000
#: Sampled keys for each piece; thresholds over all groups at most (beyond it, pieces grow).
SAMPLED, MOST = 20, 100_000
#: Thresholds in a run: a row is compared with the first of each run, then with one run.
RUN = 64


def _key(order: Sequence[tuple[str, bool]], names: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(n) for (c, _), n in zip(order, names)])


def _at_least(row: Column, bound: Column, order: Sequence[tuple[str, bool]], names: Sequence[str]) -> Column:
    """The row's key stands at ``bound`` or after it, column by column, each in its own direction."""
    out = F.lit(True)
    for (_, up), n in reversed(list(zip(order, names))):
        r, b = row[n], bound[n]
        after = F.coalesce(r > b, r.isNotNull() & b.isNull()) if up else F.coalesce(r < b, r.isNull() & b.isNotNull())
        out = after | (r.eqNullSafe(b) & out)
    return out


def _same(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return reduce(and_, [x.eqNullSafe(y) for x, y in zip(a, b)], F.lit(True))


def _thresholds(df: DataFrame, by: Sequence[str], order: Sequence[tuple[str, bool]], names: Sequence[str], large: int) -> DataFrame | None:
    """(_g.., _firsts, _runs): for each group beyond ``large`` rows its thresholds in runs; None where no group is.

    Sent to every task; their number is bounded by MOST.
    """
    sizes = [r for r in df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > large).collect()]
    if not sizes:
        return None
    half = max(large // 2, 1, sum(r["_n"] for r in sizes) // MOST)
    spark = df.sparkSession
    group = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    kinds = [df.schema[c].dataType.simpleString() for c in by]
    schema = ", ".join([f"_g{i} {k}" for i, k in enumerate(kinds)] + ["_of long"])
    # one key in so many is sampled, by a hash of the key, which does not depend on how the rows lie
    every = spark.createDataFrame([(*[r[c] for c in by], max(1, half // SAMPLED)) for r in sizes], schema)
    keyed = df.select(*group, _key(order, names).alias("_key"))
    sampled = keyed.join(F.broadcast(every), _same([keyed[f"_g{i}"] for i in range(len(by))], [every[f"_g{i}"] for i in range(len(by))]))
    taken = sampled.where(F.pmod(F.xxhash64("_key"), F.col("_of")) == 0).select(*[keyed[f"_g{i}"] for i in range(len(by))], "_key").collect()
    found: dict = {}
    for r in taken:
        if any(x != x for x in r["_key"]):  # not a number: no threshold
            continue
        found.setdefault(tuple(r[: len(by)]), []).append(r["_key"])
    rows = []
    for g, keys in found.items():
        for i in reversed(range(len(order))):  # stable: the first column decides last
            keys.sort(key=lambda k, i=i: (k[i] is not None, k[i]) if k[i] is not None else (False, 0), reverse=not order[i][1])
        cuts = keys[SAMPLED - 1 :: SAMPLED]
        runs = [cuts[i : i + RUN] for i in range(0, len(cuts), RUN)]
        if runs:
            rows.append((*g, [r[0] for r in runs], runs))
    key_type = keyed.schema["_key"].dataType.simpleString()
    return spark.createDataFrame(rows, ", ".join([f"_g{i} {k}" for i, k in enumerate(kinds)] + [f"_firsts array<{key_type}>, _runs array<array<{key_type}>>"]))


def has_large(df: DataFrame, by: Sequence[str], large: int | None = None) -> bool:
    """Whether some group has more rows than one task may sort; finer groups then have not either."""
    return bool(df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > (LARGE if large is None else large)).limit(1).collect())


def numbered(
    df: DataFrame, by: Sequence[str], order: Sequence[tuple[str, bool]], values: int = 1, row: str | None = None, rank: str | None = None, percent: str | None = None,
    tile: tuple[str, int] | None = None, large: int | None = None, check: bool = True,
) -> DataFrame:
    """``df`` with any of ``row`` (row_number), ``rank``, ``percent`` (percent_rank) and ``tile`` (name, n: ntile) in each
    group of ``by`` (nulls are a group).

    ``order``: (column, ascending) pairs; the first ``values`` of them are what equal rows share, the others only break ties
    of ``row`` and ``tile``.  Nulls come first ascending and last descending, as in Spark.  Groups of at most ``large`` rows
    are numbered by a window, larger ones in pieces with the same result; without ``check`` (the caller knows that no group
    is large) by a window all.
    """
    by, order, large = list(by), list(order), LARGE if large is None else large
    names = [f"k{i}" for i in range(len(order))]
    added = [c for c in (row, rank, percent, tile and tile[0]) if c]
    if clash := set(added) & set(df.columns):
        raise ValueError(f"columns already present: {sorted(clash)}")
    sort = lambda n: [F.col(c).asc() if up else F.col(c).desc() for c, up in order[:n]]
    cuts = _thresholds(df, by, order, names, large) if check else None
    if cuts is None:
        whole, equal = Window.partitionBy(*by).orderBy(*sort(len(order))), Window.partitionBy(*by).orderBy(*sort(values))
        columns = {row: lambda: F.row_number().over(whole), rank: lambda: F.rank().over(equal), percent: lambda: F.percent_rank().over(equal), tile and tile[0]: lambda: F.ntile(tile[1]).over(whole)}
        return df.withColumns({c: columns[c]().cast("double" if c == percent else "long") for c in added})

    g = [f"_g{i}" for i in range(len(by))]
    placed = df.join(F.broadcast(cuts), _same([df[c] for c in by], [cuts[x] for x in g]), "left").withColumn("_key", _key(order, names))
    reached = lambda bounds: F.size(F.filter(bounds, lambda b: _at_least(F.col("_key"), b, order, names)))
    run = F.greatest(reached(F.col("_firsts")) - 1, F.lit(0))
    piece = F.when(F.col("_firsts").isNull(), 0).otherwise(run * RUN + reached(F.get("_runs", run))).cast("long")
    placed = placed.withColumn("_piece", piece).drop("_firsts", "_runs", *g)

    value = F.struct(*[F.col("_key")[n].alias(n) for n in names[:values]])
    inside = Window.partitionBy(*by, "_piece").orderBy(*sort(len(order)))
    equal = Window.partitionBy(*by, "_piece").orderBy(*sort(values))
    local = placed.withColumns({"_value": value, "_row": F.row_number().over(inside), "_rank": F.rank().over(equal)})
    # a row a piece: its size, its first and last value and how often the last occurs
    told = local.groupBy(*by, "_piece").agg(
        F.count("*").alias("_n"), F.min_by("_value", "_row").alias("_first"), F.max_by("_value", "_row").alias("_last"), (F.count("*") - F.max("_rank") + 1).alias("_ties")
    )
    w = Window.partitionBy(*by).orderBy("_piece")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumns({"_off": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_total": F.sum("_n").over(Window.partitionBy(*by)), "_goes_on": F.coalesce(F.lag("_last").over(w).eqNullSafe(F.col("_first")) & (F.lag("_n").over(w) > 0), F.lit(False))})
    # where the piece's last value begins; unknown to a piece that only goes on with the value before it
    begins = F.when(~F.col("_first").eqNullSafe(F.col("_last")), F.col("_off") + F.col("_n") - F.col("_ties") + 1).when(~F.col("_goes_on"), F.col("_off") + 1)
    told = told.withColumn("_begins", F.last(begins, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    told = told.withColumn("_start", F.when(F.col("_goes_on"), F.lag("_begins").over(w)).otherwise(F.col("_off") + 1))
    there = told.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(by)], F.col("_piece").alias("_tp"), "_first", "_off", "_total", "_start")
    on = _same([local[c] for c in by], [there[f"_t{i}"] for i in range(len(by))]) & (local["_piece"] == there["_tp"])
    joined = local.join(there, on)
    number = F.col("_off") + F.col("_row")
    ranked = F.when(F.col("_value").eqNullSafe(F.col("_first")), F.col("_start")).otherwise(F.col("_off") + F.col("_rank"))
    share = F.when(F.col("_total") > 1, (ranked - 1) / (F.col("_total") - 1)).otherwise(F.lit(0.0))
    columns = {row: number, rank: ranked, percent: share}
    if tile:
        n = tile[1]
        base, extra = F.floor(F.col("_total") / n), F.col("_total") % n
        small = number - 1 - extra * (base + 1)  # rows past the buckets that have one more
        columns[tile[0]] = F.when(small < 0, F.floor((number - 1) / (base + 1)) + 1).otherwise(extra + F.floor(small / F.greatest(base, F.lit(1))) + 1)
    return joined.select(*[local[c] for c in df.columns], *[columns[c].cast("double" if c == percent else "long").alias(c) for c in added])
