"""Cross-sections: peer moments and percentiles, factor sheets, stored panels, unions of indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import fiscal_year_of, industry_in, industry_scope
from tidemark.operators.ranks import has_large, numbered
from tidemark.operators.rel import assert_check, first_per_group, union_prefer, unpivot
from tidemark.operators.temporal import interval_join
from tidemark.plans.concept_config import ConceptConfig
from tidemark.plans.concepts import annual, canonical, growths, guarded_periods, latest, length_of, ratios

#: Groups with fewer values have no moments and are left out.
MIN_GROUP = 5


def peer_moments(rows: DataFrame, levels: dict[str, str], by: list[str], value: str = "value") -> DataFrame:
    """Each row once per peer level (name -> label column; null labels skipped) with its group's moments, z and percentile."""
    base = [c for c in rows.columns if c not in levels.values()]
    labels = F.array(*[F.struct(F.lit(n).alias("peer_level"), F.col(c).alias("peer_group")) for n, c in levels.items()])
    levelled = rows.select(*rows.columns, F.explode(labels).alias("_l")).select(*base, *levels.values(), "_l.peer_level", "_l.peer_group").where("peer_group IS NOT NULL")
    group = [*by, "peer_level", "peer_group"]
    moments = levelled.groupBy(*group).agg(
        F.count(value).alias("peer_count"), F.avg(value).alias("peer_mean"), F.stddev_samp(value).alias("peer_stddev"),
        F.min(value).alias("peer_min"), F.max(value).alias("peer_max"),
    ).where(F.col("peer_count") >= MIN_GROUP)
    joined = levelled.join(moments, group)
    z = F.when(F.col("peer_stddev") != 0, F.round((F.col(value) - F.col("peer_mean")) / F.col("peer_stddev"), 4))
    rank = F.round(F.percent_rank().over(Window.partitionBy(*group).orderBy(value)), 4)
    return joined.withColumns({"zscore": z, "peer_percentile": rank})


def peer_stats(facts: DataFrame, members: DataFrame, config: ConceptConfig, asof, max_age_days: int = 450, **sources) -> DataFrame:
    """Peer cross-section of an index's members as knowable on ``asof``; ``facts`` are those in force that day.

    ``members``: cik, ticker, index_name, gics_sector, gics_sub_industry.
    """
    day = F.lit(asof).cast("date")
    recent = (F.datediff(day, F.col("value_date")) < max_age_days + 430) & (F.col("value_date") <= day)
    mine = facts.join(members.select("cik"), "cik", "left_semi").where(recent)
    history = annual(canonical(mine, config, **sources), config).where(recent)
    newest = latest(history)
    resolved = newest.select("cik", "concept", "value_date", "value", "tradable_from").unionByName(ratios(newest, history, config)).unionByName(growths(newest, history, config))
    scored = F.broadcast(config.frame(facts.sparkSession, "concepts").where("scored").select("concept", "fact_type"))
    fresh = resolved.withColumn("days_stale", F.datediff(day, F.col("value_date"))).where(F.col("days_stale") <= max_age_days)
    return peer_moments(fresh.join(members, "cik").join(scored, "concept"), {"sector": "gics_sector", "sub_industry": "gics_sub_industry"}, ["concept"])


YEAR = ["cik", "concept", "fiscal_year"]
LABELS = ["ticker", "index_name", "gics_sector", "gics_sub_industry"]
#: Forms whose balance sheet may say that a year ended without debt.
ANNUAL_FORMS = ("10-K", "10-K/A", "10-KT")


def fiscal_values(facts: DataFrame, members: DataFrame, config: ConceptConfig, standard_tags: DataFrame | None = None, faces: DataFrame | None = None, since="2008-01-01", until=None) -> DataFrame:
    """A value per company, concept and fiscal year, with the index and labels of the company on the period's own end.

    Filed tags first, then formulas, then the zero debt of a balance sheet's face.  A balance counts only on a day that ends
    one of the company's annual periods, so a first-quarter balance never stands for the year before.  ``facts``:
    consolidated rows with ticker and sic; ``members``: a disjoint timeline (cik, index_name, gics_sector,
    gics_sub_industry, valid_from, valid_to); a period that ends outside of it is left out.  ``faces``: (cik, period_date,
    form, filed_date, zero_by_face, tradable_from).
    """
    spark = facts.sparkSession
    kinds = F.broadcast(config.frame(spark, "concepts").select("concept", "fact_type"))
    inside = F.col("value_date") >= F.lit(since).cast("date")
    if until is not None:
        inside = inside & (F.col("value_date") <= F.lit(until).cast("date"))
    usable = facts.where(F.col("value").isNotNull() & (F.col("uom") == "USD") & inside)
    mapped = usable.join(F.broadcast(config.frame(spark, "tags")), "tag").where(industry_scope(F.col("sic"), F.col("sic_prefix"))).join(kinds, "concept")
    mapped = mapped.where(F.col("qtrs") == length_of(F.col("fact_type")))
    ends = facts.where("qtrs = 4").select("cik", "value_date").distinct().withColumn("_ends_year", F.lit(True))
    rows = mapped.join(ends, ["cik", "value_date"], "left").where("fact_type <> 'balance' OR _ends_year").withColumn("fiscal_year", fiscal_year_of(F.col("value_date")))
    order = [(F.col("sic_prefix") != "").desc(), F.col("priority").asc(), F.col("value_date").desc(), F.col("tradable_from").desc(), F.col("tag").asc(), F.col("value").desc()]
    picked = first_per_group(rows, YEAR, order).select(*YEAR, "ticker", "sic", "value_date", "tradable_from", (F.col("value") * F.col("sign")).alias("value"))
    timeline = members.select("cik", "index_name", "gics_sector", "gics_sub_industry", "valid_from", "valid_to")
    direct = interval_join(picked, timeline, ["cik"], "value_date", "valid_from", "valid_to").drop("valid_from", "valid_to")

    terms = config.frame(spark, "terms").join(config.frame(spark, "variants").drop("guard_match", "guard_except"), ["concept", "variant"])
    operands = direct.withColumnRenamed("concept", "operand").join(F.broadcast(terms), "operand").where(industry_in(F.col("sic"), F.col("sic_prefixes")))
    if standard_tags is not None:
        lengths = guarded_periods(facts, config, standard_tags).join(kinds, "concept").where(F.col("qtrs") == length_of(F.col("fact_type")))
        operands = operands.join(lengths.select("cik", "value_date", "concept", "variant"), ["cik", "value_date", "concept", "variant"], "left_anti")
    sums = operands.groupBy(*YEAR, "variant", "n_required").agg(
        *[F.max(c).alias(c) for c in (*LABELS, "value_date", "tradable_from")], F.sum(F.col("coefficient") * F.col("value")).alias("value"), F.count_if("required").alias("_have")
    )
    columns = [*YEAR, *LABELS, "value_date", "tradable_from", "value"]
    derived = first_per_group(sums.where("_have = n_required"), YEAR, [F.col("variant").asc()]).select(*columns)
    parts = [direct.select(*columns), derived]
    if faces is not None:
        zero = faces.where(F.col("zero_by_face") & F.col("form").isin(*ANNUAL_FORMS)).select("cik", F.col("period_date").alias("value_date"), "filed_date", "tradable_from")
        sheets = direct.where("concept = 'total_assets'").select("cik", "value_date", *LABELS)
        placed = zero.join(sheets, ["cik", "value_date"]).withColumns({"fiscal_year": fiscal_year_of(F.col("value_date")), "concept": F.lit("total_debt"), "value": F.lit(0.0)})
        parts.append(first_per_group(placed, YEAR, [F.col("filed_date").desc_nulls_last(), F.col("tradable_from").desc()]).select(*columns))
    return union_prefer(parts, YEAR)


def fiscal_derived(values: DataFrame, config: ConceptConfig, low: int = 300, high: int = 430) -> DataFrame:
    """``values`` with the ratios and growths of each company and fiscal year, from one map of concepts a year.

    A denominator that is not positive gives no row.  Growth asks for the concept in the fiscal year before, positive and
    ended 300 to 430 days earlier.  One grouping and one window by company; nothing is joined with itself.
    """
    cell = F.struct("value", "value_date", "tradable_from", *LABELS)
    years = values.groupBy("cik", "fiscal_year").agg(*[F.max(c).alias(c) for c in LABELS], F.map_from_entries(F.collect_list(F.struct("concept", cell.alias("cell")))).alias("now"))
    w = Window.partitionBy("cik").orderBy("fiscal_year")
    rows = years.withColumn("before", F.when(F.lag("fiscal_year").over(w) == F.col("fiscal_year") - 1, F.lag("now").over(w)))
    at = lambda m, concept: F.try_element_at(F.col(m), F.lit(concept))

    def entry(concept, of, value, known, labels):
        return F.struct(concept.alias("concept"), value.alias("value"), of["value_date"].alias("value_date"), known.alias("tradable_from"), *[labels[c].alias(c) for c in LABELS])

    year = {c: F.col(c) for c in LABELS}
    derived = []
    for name, numerator, denominator in config.ratios:
        n, d = at("now", numerator), at("now", denominator)
        derived.append(F.when(n["value"].isNotNull() & (d["value"] > 0), entry(F.lit(name), n, n["value"] / d["value"], F.greatest(n["tradable_from"], d["tradable_from"]), year)))
    for name, base in config.growths:
        n, b = at("now", base), at("before", base)
        fits = (b["value"] > 0) & F.datediff(n["value_date"], b["value_date"]).between(low, high)
        derived.append(F.when(fits, entry(F.lit(name), n, (n["value"] - b["value"]) / b["value"], n["tradable_from"], n)))
    own = F.transform(F.map_entries("now"), lambda e: entry(e["key"], e["value"], e["value"]["value"], e["value"]["tradable_from"], e["value"]))
    every = F.concat(own, F.array_compact(F.array(*derived))) if derived else own
    return rows.select("cik", "fiscal_year", F.explode(every).alias("e")).select("cik", "fiscal_year", "e.*").select(*YEAR, *LABELS, "value_date", "tradable_from", "value")


def peer_panel(facts: DataFrame, members: DataFrame, config: ConceptConfig, **sources) -> DataFrame:
    """Peer statistics by fiscal year: each scored value, ratio and growth against its sector and its sub-industry.

    Cross-sections hold the companies that were in an index when their own period ended.  Arguments as ``fiscal_values``.
    """
    scored = F.broadcast(config.frame(facts.sparkSession, "concepts").where("scored").select("concept", "fact_type"))
    values = fiscal_values(facts, members, config, **sources)
    every = fiscal_derived(values.join(scored, "concept", "left_semi"), config)
    return peer_moments(every.join(scored, "concept"), {"sector": "gics_sector", "sub_industry": "gics_sub_industry"}, ["concept", "fiscal_year"])


# Factors of the sheet; higher means the higher expected return, hence growth counts the other way.
FACTORS = {"gp_at": 1, "ocf_at": 1, "roa": 1, "roe": 1, "operating_margin": 1, "revenue_growth": -1, "roe_q": 1, "roa_q": 1, "sue": 1}
MIN_FACTORS = 4


def factor_percentiles(values: DataFrame, ids: list[str], sector: str, signs: dict[str, int] = FACTORS, within: tuple = ()) -> DataFrame:
    """Wide sheet: per factor value, percentile and sector percentile; count and composite of at least four.

    ``values``: ids, sector and a column per factor; every row stays, with 0 factors where it has none.  A null sector is a
    sector of its own.  ``within`` names columns that part separate cross-sections (dates).
    """
    names = list(signs)
    long = unpivot(values.select(*ids, sector, *within, *[F.col(n).cast("double") for n in names]), [*ids, sector, *within], names, "factor", "value").where("value IS NOT NULL")
    sign = F.create_map(*[F.lit(x) for p in signs.items() for x in p])
    signed = long.withColumn("_s", F.col("value") * F.try_element_at(sign, F.col("factor")))
    order, large = [("_s", True), *[(c, True) for c in ids]], has_large(signed, ["factor", *within])
    ranked = numbered(signed, ["factor", *within], order, percent="pct", check=large)
    ranked = numbered(ranked, ["factor", sector, *within], order, percent="sector_pct", check=large)
    ranked = ranked.withColumns({c: F.round(c, 4) for c in ("pct", "sector_pct")})
    picks = []
    for n in names:
        pick = lambda c, n=n: F.max(F.when(F.col("factor") == n, F.col(c)))
        picks += [pick("value").alias(n), pick("pct").alias(f"{n}_pct"), pick("sector_pct").alias(f"{n}_sector_pct")]
    wide = ranked.groupBy(*ids, *within).agg(*picks, F.count("*").cast("int").alias("n_factors"), F.round(F.avg("pct"), 4).alias("composite"))
    frame = values.select(*ids, sector, *within)
    out = frame.join(wide, [*ids, *within], "left").withColumn("n_factors", F.coalesce("n_factors", F.lit(0)))
    return out.withColumn("composite", F.when(F.col("n_factors") >= MIN_FACTORS, F.col("composite")))


def factor_sheet(members: DataFrame, peers: DataFrame, profit: DataFrame, surprises: DataFrame) -> DataFrame:
    """One row per member from the peer cross-section, newest quarterly profitability and newest surprise."""
    names = {"gross_profit_to_assets": "gp_at", "ocf_to_assets": "ocf_at", "roa": "roa", "roe": "roe", "operating_margin": "operating_margin", "revenue_growth": "revenue_growth"}
    rows = peers.where("peer_level = 'sector'").where(F.col("concept").isin(list(names)))
    wide = rows.groupBy("cik").agg(*[F.max(F.when(F.col("concept") == c, F.col("value"))).alias(a) for c, a in names.items()], F.max("value_date").alias("annual_period"), F.max("tradable_from").alias("annual_tradable_from"))
    joined = members.join(wide, "cik", "left").join(profit.select("cik", "quarter_end", F.col("tradable_from").alias("quarter_tradable_from"), "roe_q", "roa_q"), "cik", "left").join(surprises.select("cik", "sue"), "cik", "left")
    extra = ["ticker", "index_name", "annual_period", "annual_tradable_from", "quarter_end", "quarter_tradable_from"]
    return factor_percentiles(joined, ["cik"], "gics_sector").join(joined.select("cik", *extra), "cik")


def store_panel(panel: DataFrame, path: str) -> None:
    """Replace the stored cross-sections (index_name, asof) that ``panel`` has; no figure may be newer than its date."""
    for c in ("annual_period", "annual_tradable_from", "quarter_end", "quarter_tradable_from"):
        if c in panel.columns:
            assert_check(panel, F.col(c) <= F.col("asof"), f"{c} is after the knowledge date")
    panel.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("index_name", "asof").parquet(path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def union_panel(panel: DataFrame, components: list[str], name: str, signs: dict[str, int] = FACTORS) -> DataFrame:
    """Panel of several indices as one: a company in more than one counts by the first; stored values are ranked anew.

    Dates that lack a component are left out.
    """
    order = F.array_position(F.array(*map(F.lit, components)), F.col("index_name"))
    rows = panel.where(F.col("index_name").isin(components))
    whole = rows.groupBy("asof").agg(F.countDistinct("index_name").alias("_n")).where(F.col("_n") == len(components)).drop("_n")
    one = first_per_group(rows.join(whole, "asof"), ["asof", "cik"], [order.asc(), F.col("ticker").asc_nulls_last()])
    return factor_percentiles(one, ["cik"], "gics_sector", signs, ("asof",)).withColumn("index_name", F.lit(name))


def rebalance_order(days: list, since=None, until=None) -> list:
    """Month ends to build panels for: quarter ends first, then the others, both in order."""
    inside = [d for d in sorted(days) if (since is None or d >= since) and (until is None or d <= until)]
    return [d for d in inside if d.month % 3 == 0] + [d for d in inside if d.month % 3]
