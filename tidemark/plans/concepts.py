"""Concept values, set-based: every company, concept and period at once; a lookup is a filter on the result.

Facts are consolidated rows (cik, tag, version, value_date, qtrs, uom, value, tradable_from, sic); what is in force on a
day is selected before (``in_force``).  Preference at a period: filed tag, formula, zero read from the balance sheet's face.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import industry_in, industry_scope, norm_ticker
from tidemark.operators.rel import first_per_group, top_k_per_group, union_prefer
from tidemark.operators.temporal import asof_pred, shift_sessions
from tidemark.plans.concept_config import ConceptConfig

PERIOD = ["cik", "concept", "value_date", "qtrs"]


def in_force(facts: DataFrame, asof, calendar: DataFrame | None = None, buffer_sessions: int = 0) -> DataFrame:
    """Facts believed on a knowledge date, optionally some sessions earlier; without a date it raises."""
    if asof is None:
        raise ValueError("no knowledge date given")
    day = shift_sessions(calendar, asof, buffer_sessions) if buffer_sessions > 0 else asof
    return facts.where(asof_pred(F.col("tradable_from"), F.col("superseded_tradable"), F.lit(day).cast("date")))


def resolve_direct(facts: DataFrame, config: ConceptConfig, suspects: DataFrame | None = None) -> DataFrame:
    """Per (cik, concept, value_date, qtrs) the best mapped tag: industry rules first, then priority, then the newest row."""
    spark = facts.sparkSession
    rows = facts.where(F.col("value").isNotNull() & (F.col("uom") == "USD"))
    if suspects is not None:
        rows = rows.join(suspects.select("adsh", "tag", "value_date", "qtrs").distinct(), ["adsh", "tag", "value_date", "qtrs"], "left_anti")
    mapped = rows.join(F.broadcast(config.frame(spark, "tags")), "tag").where(industry_scope(F.col("sic"), F.col("sic_prefix")))
    order = [(F.col("sic_prefix") != "").desc(), F.col("priority").asc(), F.col("tradable_from").desc(), F.col("tag").asc(), F.col("value").desc()]
    best = first_per_group(mapped, PERIOD, order)
    return best.select(*PERIOD, (F.col("value") * F.col("sign")).alias("value"), "tradable_from", "sic")


def guarded_periods(facts: DataFrame, config: ConceptConfig, standard_tags: DataFrame) -> DataFrame:
    """(cik, value_date, qtrs, concept, variant) where a positive line under a non-standard tag blocks a formula."""
    variants = config.frame(facts.sparkSession, "variants").where("guard_match IS NOT NULL")
    custom = facts.where("value > 0").join(standard_tags.select("tag").distinct(), "tag", "left_anti")
    names = custom.select("tag").distinct()  # expressions run once a tag, not once a fact
    match = F.expr("tag rlike guard_match AND (guard_except IS NULL OR NOT tag rlike guard_except)")
    blocked = names.join(F.broadcast(variants), match).select("tag", "concept", "variant")
    return custom.join(blocked, "tag").select("cik", "value_date", "qtrs", "concept", "variant").distinct()


def formula_values(direct: DataFrame, config: ConceptConfig, guarded: DataFrame | None = None) -> DataFrame:
    """Per period every variant of every formula that is in scope, unguarded, with every required operand and at least one."""
    spark = direct.sparkSession
    terms = config.frame(spark, "terms").join(config.frame(spark, "variants").drop("guard_match", "guard_except"), ["concept", "variant"])
    operands = direct.withColumnRenamed("concept", "operand").join(F.broadcast(terms), "operand").where(industry_in(F.col("sic"), F.col("sic_prefixes")))
    if guarded is not None:
        operands = operands.join(guarded, ["cik", "value_date", "qtrs", "concept", "variant"], "left_anti")
    sums = operands.groupBy(*PERIOD, "variant", "n_required").agg(
        F.sum(F.col("coefficient") * F.col("value")).alias("value"), F.max("tradable_from").alias("tradable_from"),
        F.count_if("required").alias("_have"), F.max_by("sic", "tradable_from").alias("sic"),
    )
    return sums.where("_have = n_required").select(*PERIOD, "variant", "value", "tradable_from", "sic")


def resolve_formulas(direct: DataFrame, config: ConceptConfig, guarded: DataFrame | None = None) -> DataFrame:
    """Per period the first variant that ``formula_values`` has."""
    return first_per_group(formula_values(direct, config, guarded), PERIOD, [F.col("variant").asc()]).drop("variant")


def formula_audit(direct: DataFrame, config: ConceptConfig, concept: str, size: str, guarded: DataFrame | None = None, tolerance: float = 0.01) -> DataFrame:
    """(variant, guarded, n, share_within, mean_miss) of a concept that is filed outright where a formula has a value too.

    A period counts for each variant that resolves; it is within where the formula misses the filed value by at most
    ``tolerance`` of the positive value of ``size`` at the period.  ``guarded``: as ``guarded_periods``, whose periods are told
    apart instead of left out, so that the figures say what the guard is worth.
    """
    at = ["cik", "value_date", "qtrs"]
    filed = direct.where(F.col("concept") == concept).select(*at, F.col("value").alias("_filed"))
    scale = direct.where((F.col("concept") == size) & (F.col("value") > 0)).select(*at, F.col("value").alias("_size"))
    formulas = formula_values(direct, config).where(F.col("concept") == concept).select(*at, "variant", "value")
    both = formulas.join(filed, at).join(scale, at)
    flag = F.lit(False)
    if guarded is not None:
        mine = guarded.where(F.col("concept") == concept).select(*at, "variant").distinct().withColumn("_g", F.lit(True))
        both, flag = both.join(mine, [*at, "variant"], "left"), F.coalesce("_g", F.lit(False))
    miss = F.abs(F.col("value") - F.col("_filed")) / F.col("_size")
    return both.groupBy("variant", flag.alias("guarded")).agg(F.count("*").alias("n"), F.round(F.avg((miss <= tolerance).cast("double")), 4).alias("share_within"), F.avg(miss).alias("mean_miss"))


def face_zero_debt(faces: DataFrame, mode: str = "pit") -> DataFrame:
    """total_debt of 0 where the filing that governs a period (the first filed, or in mode latest the last) shows a face
    without borrowings."""
    if mode not in ("pit", "latest"):
        raise ValueError(f"unknown mode {mode!r}")
    order = [F.col("filed_date").asc_nulls_last(), F.col("adsh").asc()] if mode == "pit" else [F.col("filed_date").desc_nulls_last(), F.col("adsh").desc()]
    zero = first_per_group(faces, ["cik", "period_date"], order).where("zero_by_face")
    return zero.select("cik", F.lit("total_debt").alias("concept"), F.col("period_date").alias("value_date"), F.lit(0).alias("qtrs"), F.lit(0.0).alias("value"), "tradable_from", "sic")


def canonical(facts: DataFrame, config: ConceptConfig, standard_tags: DataFrame | None = None, faces: DataFrame | None = None, suspects: DataFrame | None = None, mode: str = "pit") -> DataFrame:
    """Every concept's value at every period, by preference; ``mode`` says which filing's face governs a period."""
    direct = resolve_direct(facts, config, suspects)
    guarded = guarded_periods(facts, config, standard_tags) if standard_tags is not None else None
    parts = [direct, resolve_formulas(direct, config, guarded)]
    if faces is not None:
        parts.append(face_zero_debt(faces, mode))
    return union_prefer(parts, PERIOD)


def canonical_available(values: DataFrame, facts: DataFrame, config: ConceptConfig) -> DataFrame:
    """``values`` with ``available_from``: the latest first-known day of any tag that is mapped to the concept or to an
    operand of one of its formulas at the period, used or not."""
    spark = values.sparkSession
    tags, terms = config.frame(spark, "tags").select("concept", "tag", "sic_prefix"), config.frame(spark, "terms").select("concept", "operand")
    own = tags.withColumnRenamed("concept", "operand")
    mapped = tags.union(terms.join(own, "operand").select("concept", "tag", "sic_prefix")).distinct()
    rows = facts.where(F.col("value").isNotNull() & (F.col("uom") == "USD")).join(F.broadcast(mapped), "tag").where(industry_scope(F.col("sic"), F.col("sic_prefix")))
    known = rows.groupBy(*PERIOD).agg(F.max("tradable_from").alias("available_from"))
    return values.join(known, PERIOD, "left").withColumn("available_from", F.coalesce("available_from", "tradable_from"))


def length_of(fact_type: Column) -> Column:
    """Quarters in an annual reading of a concept."""
    return F.when(fact_type == "balance", 0).otherwise(4)


def annual(values: DataFrame, config: ConceptConfig) -> DataFrame:
    """Year-long flows and balances among the values."""
    kinds = F.broadcast(config.frame(values.sparkSession, "concepts").select("concept", "fact_type"))
    return values.join(kinds, "concept").where(F.col("qtrs") == length_of(F.col("fact_type"))).drop("fact_type")


def candidate_periods(values: DataFrame, k: int = 12) -> DataFrame:
    """The newest k periods of each company and concept."""
    return top_k_per_group(values, ["cik", "concept"], [F.col("value_date").desc()], k)


def latest(values: DataFrame) -> DataFrame:
    """Each concept's newest period; at one period the value is already by preference."""
    return first_per_group(values, ["cik", "concept"], [F.col("value_date").desc()])


def ratios(numerators: DataFrame, history: DataFrame, config: ConceptConfig) -> DataFrame:
    """Ratios at the numerator's period; a denominator that is not positive gives no row."""
    spec = F.broadcast(config.frame(numerators.sparkSession, "ratios"))
    n = numerators.select("cik", F.col("concept").alias("numerator"), "value_date", F.col("value").alias("_n"), F.col("tradable_from").alias("_nt"))
    d = history.select("cik", F.col("concept").alias("denominator"), "value_date", F.col("value").alias("_d"), F.col("tradable_from").alias("_dt"))
    joined = n.join(spec, "numerator").join(d.where("_d > 0"), ["cik", "denominator", "value_date"])
    return joined.select("cik", "concept", "value_date", (F.col("_n") / F.col("_d")).alias("value"), F.greatest("_nt", "_dt").alias("tradable_from"))


def growths(numerators: DataFrame, history: DataFrame, config: ConceptConfig, low: int = 300, high: int = 430) -> DataFrame:
    """Change over the newest base 300 to 430 days earlier; a base that is not positive gives no row."""
    spec = F.broadcast(config.frame(numerators.sparkSession, "growths"))
    n = numerators.select("cik", F.col("concept").alias("numerator"), "value_date", F.col("value").alias("_n"), F.col("tradable_from").alias("_nt")).join(spec, "numerator")
    b = history.select("cik", F.col("concept").alias("numerator"), F.col("value_date").alias("_base"), F.col("value").alias("_b"), F.col("tradable_from").alias("_bt"))
    near = n.join(b.where("_b > 0"), ["cik", "numerator"]).where(F.datediff("value_date", "_base").between(low, high))
    best = first_per_group(near, ["cik", "concept", "value_date"], [F.col("_base").desc()])
    return best.select("cik", "concept", "value_date", ((F.col("_n") - F.col("_b")) / F.col("_b")).alias("value"), F.greatest("_nt", "_bt").alias("tradable_from"))


def latest_annual(facts: DataFrame, config: ConceptConfig, **sources) -> DataFrame:
    """Newest annual value of every concept, ratio and growth: (cik, concept, value_date, value, tradable_from)."""
    history = annual(canonical(facts, config, **sources), config)
    newest = latest(history)
    plain = newest.select("cik", "concept", "value_date", "value", "tradable_from")
    return plain.unionByName(ratios(newest, history, config)).unionByName(growths(newest, history, config))


def snapshot(facts: DataFrame, config: ConceptConfig, ciks: DataFrame, **sources) -> DataFrame:
    """A row per company and scored concept; value null where nothing resolves."""
    scored = config.frame(facts.sparkSession, "concepts").where("scored").select("concept", "fact_type")
    frame = ciks.select("cik").distinct().crossJoin(F.broadcast(scored))
    return frame.join(latest_annual(facts, config, **sources), ["cik", "concept"], "left")


def aliased_billions(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Annual facts under their reporting aliases (metric_alias, tag), in billions."""
    rows = facts.where((F.col("qtrs").isin(0, 4)) & (F.col("uom") == "USD")).join(F.broadcast(aliases), "tag")
    return rows.select("cik", "metric_alias", "value_date", (F.col("value") / 1e9).alias("value_billions"), "tradable_from")


def aliased_by_ticker(facts: DataFrame, aliases: DataFrame, holders: DataFrame, wanted: list[str], metrics: list[str] | None = None) -> DataFrame:
    """``aliased_billions`` of the companies that hold the ``wanted`` tickers, newest first; a ticker that none holds raises
    LookupError, and so does one of ``metrics`` that is no alias."""
    if metrics is not None:
        known = {r["metric_alias"] for r in aliases.select("metric_alias").distinct().collect()}  # configuration
        if unknown := sorted(set(metrics) - known):
            raise LookupError(f"no alias {', '.join(unknown)}")
        aliases = aliases.where(F.col("metric_alias").isin(list(metrics)))
    return by_ticker(aliased_billions(facts, aliases), holders, wanted).orderBy("ticker", F.col("value_date").desc_nulls_last(), "metric_alias")


def by_ticker(values: DataFrame, holders: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Values with the ticker of their company; ``holders`` has (ticker, cik), a company a ticker, today's or a past day's.

    With ``wanted`` only those tickers' rows; a wanted ticker that no company holds raises LookupError.
    """
    held = holders.select(norm_ticker(F.col("ticker")).alias("ticker"), "cik")
    if wanted is not None:
        names = values.sparkSession.createDataFrame([(w,) for w in wanted], "ticker string").select(norm_ticker(F.col("ticker")).alias("ticker")).distinct()
        unknown = sorted(r["ticker"] for r in names.join(held, "ticker", "left_anti").collect())
        if unknown:
            raise LookupError(f"no company holds {', '.join(unknown)}")
        held = held.join(names, "ticker", "left_semi")
    return values.join(held, "cik")


def top_screen(values: DataFrame, concept: str, n: int = 10, ties: tuple[str, ...] = ("cik",)) -> DataFrame:
    """The ``n`` largest values of a concept; equal values in order of ``ties``, null values never."""
    rows = values.where((F.col("concept") == concept) & F.col("value").isNotNull())
    return rows.orderBy(F.col("value").desc(), *[F.col(c).asc_nulls_last() for c in ties]).limit(n)
