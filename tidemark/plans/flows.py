"""Quarterly and trailing-year flows, earnings surprise and quarterly profitability, for all companies at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import month_end_back
from tidemark.operators.ranks import has_large, numbered
from tidemark.operators.rel import first_per_group
from tidemark.operators.temporal import days_between

SERIES = ["cik", "concept"]



def fiscal_grid(period: DataFrame) -> DataFrame:
    """The fiscal quarter of a date: the longest period that the company reported ending there, over all concepts."""
    return period.groupBy("cik", "value_date").agg(F.max("qtrs").alias("fiscal_quarter"))


def quarters(period: DataFrame) -> DataFrame:
    """One value per quarter: the filed three months, else year-to-date less the year-to-date a quarter shorter."""
    filed = period.where("qtrs = 1").select(*SERIES, F.col("value_date").alias("quarter_end"), F.col("value").alias("q_value"), F.lit("reported").alias("q_source"), "tradable_from", F.lit(0).alias("pref"), F.lit(0).alias("gap"), F.lit(1).alias("length"))
    longer = period.where("qtrs BETWEEN 2 AND 4")
    shorter = period.select(*SERIES, (F.col("qtrs") + 1).alias("qtrs"), F.col("value_date").alias("_d"), F.col("value").alias("_v"), F.col("tradable_from").alias("_t"))
    pairs = longer.join(shorter, [*SERIES, "qtrs"]).where(days_between("value_date", "_d", 70, 110))
    less = pairs.select(*SERIES, F.col("value_date").alias("quarter_end"), (F.col("value") - F.col("_v")).alias("q_value"), F.lit("ytd_difference").alias("q_source"), F.greatest("tradable_from", "_t").alias("tradable_from"), F.lit(1).alias("pref"), F.abs(F.datediff("value_date", "_d") - 91).alias("gap"), F.col("qtrs").alias("length"))
    order = [F.col("pref").asc(), F.col("gap").asc(), F.col("length").asc(), F.col("tradable_from").desc(), F.col("q_value").desc()]
    return first_per_group(filed.unionByName(less), [*SERIES, "quarter_end"], order).drop("pref", "gap", "length")


def trailing_years(period: DataFrame, quarter: DataFrame) -> DataFrame:
    """Twelve months to each date: the annual figure; else last year plus year-to-date less last year's; else four quarters."""
    columns = [*SERIES, F.col("value_date").alias("quarter_end")]
    year = period.where("qtrs = 4").select(*columns, F.col("value").alias("ttm_value"), F.lit("annual").alias("ttm_source"), F.col("tradable_from").alias("ttm_tradable_from"), F.lit(0).alias("pref"))
    onto = period.join(fiscal_grid(period).withColumnRenamed("fiscal_quarter", "qtrs"), ["cik", "value_date", "qtrs"])
    same = Window.partitionBy(*SERIES, "qtrs").orderBy("value_date")
    before = Window.partitionBy(*SERIES).orderBy("value_date").rowsBetween(Window.unboundedPreceding, -1)
    ytd = onto.select("*", F.lag("value_date").over(same).alias("_pd"), F.lag("value").over(same).alias("_pv"), F.lag("tradable_from").over(same).alias("_pt"), F.max(F.when(F.col("qtrs") == 4, F.col("value_date"))).over(before).alias("_fy"))
    back = F.datediff("value_date", "_fy") - F.col("qtrs") * 91
    ytd = ytd.where(F.col("qtrs").between(1, 3) & days_between("value_date", "_pd", 345, 385) & back.between(-25, 25))
    fy = period.where("qtrs = 4").select(*SERIES, F.col("value_date").alias("_fy"), F.col("value").alias("_fv"), F.col("tradable_from").alias("_ft"))
    rolled = ytd.join(fy, [*SERIES, "_fy"]).select(*columns, (F.col("_fv") + F.col("value") - F.col("_pv")).alias("ttm_value"), F.lit("annual_plus_ytd").alias("ttm_source"), F.greatest("_ft", "tradable_from", "_pt").alias("ttm_tradable_from"), F.lit(1).alias("pref"))
    w = Window.partitionBy(*SERIES).orderBy("quarter_end")
    lags = quarter
    for i in (1, 2, 3):
        lags = lags.withColumns({f"_e{i}": F.lag("quarter_end", i).over(w), f"_v{i}": F.lag("q_value", i).over(w), f"_t{i}": F.lag("tradable_from", i).over(w)})
    close = days_between("quarter_end", "_e1", 70, 110) & days_between("_e1", "_e2", 70, 110) & days_between("_e2", "_e3", 70, 110)
    four = lags.where(close).select(*SERIES, "quarter_end", (F.col("q_value") + F.col("_v1") + F.col("_v2") + F.col("_v3")).alias("ttm_value"), F.lit("four_quarters").alias("ttm_source"), F.greatest("tradable_from", "_t1", "_t2", "_t3").alias("ttm_tradable_from"), F.lit(2).alias("pref"))
    order = [F.col("pref").asc(), F.col("ttm_tradable_from").desc(), F.col("ttm_value").desc()]
    return first_per_group(year.unionByName(rolled).unionByName(four), [*SERIES, "quarter_end"], order).drop("pref")


def _growth(now: str, base: str):
    return F.when(F.col(base) > 0, (F.col(now) - F.col(base)) / F.col(base))


def quarterly(period: DataFrame) -> DataFrame:
    """Quarterly series with quarter and year comparisons and trailing years; gaps leave the comparison null.

    ``period``: (cik, concept, value_date, qtrs 1..4, value, tradable_from), one row per key.
    """
    period = period.where("qtrs BETWEEN 1 AND 4").select(*SERIES, "value_date", "qtrs", "value", "tradable_from")
    quarter = quarters(period)
    joined = quarter.join(trailing_years(period, quarter), [*SERIES, "quarter_end"], "left")
    w = Window.partitionBy(*SERIES).orderBy("quarter_end")
    lagged = joined.select("*", *[F.lag(c, n).over(w).alias(a) for c, n, a in (("quarter_end", 1, "_e1"), ("q_value", 1, "_v1"), ("quarter_end", 4, "_e4"), ("q_value", 4, "_v4"), ("ttm_value", 4, "_tv4"), ("ttm_source", 4, "_ts4"))])
    near, year = days_between("quarter_end", "_e1", 70, 110), days_between("quarter_end", "_e4", 345, 385)
    out = lagged.withColumns({
        "q_prior_end": F.when(near, F.col("_e1")), "q_prior_value": F.when(near, F.col("_v1")),
        "q_yoy_end": F.when(year, F.col("_e4")), "q_yoy_value": F.when(year, F.col("_v4")),
        "ttm_prior_value": F.when(year & F.col("_ts4").isNotNull(), F.col("_tv4")),
    })
    out = out.withColumns({"qoq_growth": _growth("q_value", "q_prior_value"), "yoy_growth": _growth("q_value", "q_yoy_value"), "ttm_growth": _growth("ttm_value", "ttm_prior_value")})
    grid = fiscal_grid(period).withColumnRenamed("value_date", "quarter_end")
    return out.drop("_e1", "_v1", "_e4", "_v4", "_tv4", "_ts4").join(grid, ["cik", "quarter_end"])


def newest_quarter(series: DataFrame) -> DataFrame:
    return first_per_group(series, SERIES, [F.col("quarter_end").desc()])


def surprise(series: DataFrame, lag_quarters: int = 4, window: int = 8) -> DataFrame:
    """Standardised unexpected earnings: the change on the year over the deviation of the eight changes before.

    All eight must exist and span 700 to 760 days; otherwise null.
    """
    rows = series.where("q_value IS NOT NULL").withColumn("yoy_change", F.col("q_value") - F.col("q_yoy_value"))
    w = Window.partitionBy(*SERIES).orderBy("quarter_end")
    eight = w.rowsBetween(-window, -1)
    rows = rows.select("*", F.count("yoy_change").over(eight).cast("int").alias("prior_changes"), F.stddev_samp("yoy_change").over(eight).alias("_sd"), F.datediff("quarter_end", F.lag("quarter_end", window).over(w)).alias("_span"))
    whole = (F.col("prior_changes") == window) & F.col("_span").between(700, 760)
    rows = rows.withColumn("sigma", F.when(whole, F.col("_sd")))
    return rows.withColumn("sue", F.when(F.col("sigma") > 0, F.col("yoy_change") / F.col("sigma"))).drop("_sd", "_span")


def profitability(series: DataFrame, balances: DataFrame, flow: str = "net_income") -> DataFrame:
    """Quarterly flow over the balance at the month end a quarter earlier; only positive balances count.

    ``balances``: (cik, concept, value_date, value, tradable_from), of total_equity and total_assets.
    """
    q = series.where((F.col("concept") == flow) & F.col("q_value").isNotNull()).withColumn("_at", month_end_back(F.col("quarter_end"), 3))
    for concept, name in (("total_equity", "roe_q"), ("total_assets", "roa_q")):
        b = balances.where((F.col("concept") == concept) & (F.col("value") > 0)).select("cik", F.last_day("value_date").alias("_at"), F.col("value").alias("_b"), F.col("tradable_from").alias("_bt"))
        b = first_per_group(b, ["cik", "_at"], [F.col("_bt").desc(), F.col("_b").desc()])
        q = q.join(b, ["cik", "_at"], "left").withColumns({name: F.col("q_value") / F.col("_b"), "tradable_from": F.greatest("tradable_from", "_bt")}).drop("_b", "_bt")
    return q.drop("_at")


def ranked(rows: DataFrame, value: str, by=(), rank: str = "rank", percentile: str = "percentile") -> DataFrame:
    """Rank (1 = highest) and percentile among rows with a value."""
    has = rows.where(F.col(value).isNotNull())
    large = has_large(has, by)
    best = numbered(has, by, [(value, False)], rank=rank, check=large)
    scored = numbered(best, by, [(value, True)], percent=percentile, check=large).withColumn(percentile, F.round(percentile, 4))
    return scored.unionByName(rows.where(F.col(value).isNull()), allowMissingColumns=True)
