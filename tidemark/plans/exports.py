"""Export panels: annual states and quarterly items, footnote items, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.footnotes import aoci_component, by_one_rule, customer_type, pension_rules, pension_scope, sin_codes
from tidemark.functions.scalars import camel_words, fiscal_year_of, parse_segments
from tidemark.operators.rel import changed_rows, first_per_group
from tidemark.operators.temporal import asof_join, flatten_intervals
from tidemark.plans.items import Item, exported, resolve_items


def resupersede(facts: DataFrame, forms=("10-K", "10-K/A", "10-KT", "10-Q", "10-Q/A", "10-QT")) -> DataFrame:
    """Vintages of some forms only, nulls excluded, each closed by the next among them."""
    mine = facts.where(F.col("form").isin(list(forms)) & F.col("value").isNotNull())
    w = Window.partitionBy("cik", "tag", "value_date", "qtrs").orderBy("known_at", "adsh")
    return mine.withColumn("superseded_tradable", F.lead("tradable_from").over(w))


def filled_states(facts: DataFrame, tags: list[str], keys=("cik", "value_date"), parts: int | None = None) -> DataFrame:
    """(keys, state_from, _t0, _t1, ...): every key at every day on which one of its facts became known, with a struct
    (on, value) for each of ``tags``, null or with ``on`` 0 where the tag has no fact in force.

    Facts of a tag become a disjoint timeline (the latest start holds, then adsh, then value); its starts and ends are events,
    pivoted once, and what a day does not mention is carried forward from the day before.  With ``parts`` (``rel.parts_for``)
    events are dealt by the first key into that many tasks; facts that are dealt so already stay where they are.
    """
    keys = list(keys)
    mine = facts.where(F.col("tag").isin(tags) & F.col("tradable_from").isNotNull())
    timeline = flatten_intervals(mine, [*keys, "tag"], "tradable_from", "superseded_tradable", ["value"], [F.col("tradable_from").desc(), F.col("adsh").desc(), F.col("value").desc()])
    event = lambda at, on, value: F.struct(F.col(at).alias("state_from"), F.struct(F.lit(on).alias("on"), value.alias("value")).alias("_e"))
    ends = event("superseded_tradable", 0, F.lit(None).cast(timeline.schema["value"].dataType))
    edges = F.array_compact(F.array(event("tradable_from", 1, F.col("value")), F.when(F.col("superseded_tradable").isNotNull(), ends)))
    turns = timeline.select(*keys, "tag", F.inline(edges))
    days = mine.select(*keys, F.col("tradable_from").alias("state_from")).distinct().withColumn("_known", F.lit(True))
    events = turns.unionByName(days, allowMissingColumns=True)
    if parts:
        events = events.repartition(parts, keys[0])
    wide = events.groupBy(*keys, "state_from").agg(F.bool_or("_known").alias("_known"), *[F.max(F.when(F.col("tag") == t, F.col("_e"))).alias(f"_t{i}") for i, t in enumerate(tags)])
    w = Window.partitionBy(*keys).orderBy("state_from").rowsBetween(Window.unboundedPreceding, 0)
    held = wide.withColumns({f"_t{i}": F.last(f"_t{i}", ignorenulls=True).over(w) for i in range(len(tags))})
    live = F.exists(F.array(*[F.col(f"_t{i}.on") for i in range(len(tags))]), lambda x: x == 1) if tags else F.lit(False)
    return held.where(F.col("_known") & F.coalesce(live, F.lit(False))).drop("_known")


def states(facts: DataFrame, keys=("cik", "value_date"), tags: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """(keys, state_from, tag, value): what was in force of each key at every day on which one of its facts became known.

    ``tags`` are the columns of a wide row on the way; without it, those of the facts (few kinds of facts, not many).
    """
    if tags is None:
        tags = sorted(r["tag"] for r in facts.select("tag").where("tag IS NOT NULL").distinct().collect())
    wide = filled_states(facts, tags, keys, parts)
    cells = F.array(*[F.struct(F.lit(t).alias("tag"), F.col(f"_t{i}").alias("e")) for i, t in enumerate(tags)])
    return wide.select(*keys, "state_from", F.explode(cells).alias("c")).where("c.e.on = 1").select(*keys, "state_from", F.col("c.tag").alias("tag"), F.col("c.e.value").alias("value"))


def annual_panel(facts: DataFrame, items: dict[str, Item], scale: float = 1e6, absolute=(), keys=("cik", "value_date"), parts: int | None = None) -> DataFrame:
    """States by items: a row per company, period and change of any item; the last period of a fiscal year only."""
    keys = list(keys)
    tags = sorted(set().union(*[i.tags() for i in items.values()]))
    held = filled_states(facts, tags, keys, parts)
    wide = held.select(*keys, "state_from", *[F.col(f"_t{i}.value").alias(t) for i, t in enumerate(tags)])
    out = resolve_items(wide, items, prefix="i_").select(*keys, "state_from", *[F.col(f"i_{n}").alias(n) for n in exported(items)])
    out = out.withColumns({n: (F.abs(F.col(n)) if n in absolute else F.col(n)) / scale for n in exported(items)}).withColumn("fyear", fiscal_year_of(F.col("value_date")))
    newest = F.max("value_date").over(Window.partitionBy("cik", "fyear"))
    kept = out.withColumn("_newest", newest).where("value_date = _newest").drop("_newest")
    return changed_rows(kept, ["cik", "value_date"], [F.col("state_from").asc()], exported(items))


def cogs_rules(panel: DataFrame, sic: str = "sic", sale: str = "sale", gp: str = "gp", cogs: str = "cogs") -> DataFrame:
    """Banks have no cost of goods; elsewhere a missing cost is sales less gross profit, and gross profit sales less cost."""
    bank = F.col(sic).between(6000, 6299)
    cost = F.when(bank, F.lit(None).cast("double")).otherwise(F.coalesce(F.col(cogs), F.col(sale) - F.col(gp)))
    return panel.withColumn(cogs, cost).withColumn(gp, F.when(bank, F.col(gp)).otherwise(F.coalesce(F.col(gp), F.col(sale) - F.col(cogs))))


def quarterly_panel(flows: DataFrame, year_ends: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Fiscal quarters of items (cik, item, value_date, qtrs, value, tradable_from).

    kind ``flow``: the fourth quarter is the year less nine months (80 to 100 days before its end); ``ytd`` keeps the
    year-to-date figure; ``stock`` and ``shares`` are never differenced.  fqtr counts from the fiscal year end that is the
    next within 370 days; rdq is the first day a figure was known.
    """
    kind = F.create_map(*[F.lit(x) for p in kinds.items() for x in p])
    rows = flows.withColumn("kind", F.try_element_at(kind, F.col("item"))).where("kind IS NOT NULL")
    key = ["cik", "item"]
    quarter = rows.where("kind = 'flow' AND qtrs = 1").select(*key, "kind", "value_date", "value", "tradable_from", F.lit(0).alias("_p"))
    y = rows.where("kind = 'flow' AND qtrs = 4").select(*key, "kind", "value_date", "value", "tradable_from")
    n = rows.where("kind = 'flow' AND qtrs = 3").select(*key, F.col("value_date").alias("_d"), F.col("value").alias("_v"), F.col("tradable_from").alias("_t"))
    fourth = y.join(n, key).where(F.datediff("value_date", "_d").between(80, 100)).select(*key, "kind", "value_date", (F.col("value") - F.col("_v")).alias("value"), F.greatest("tradable_from", "_t").alias("tradable_from"), F.lit(1).alias("_p"))
    plain = rows.where("kind IN ('stock', 'shares') AND qtrs IN (0, 1)").select(*key, "kind", "value_date", "value", "tradable_from", F.lit(0).alias("_p"))
    longest = first_per_group(rows.where("kind = 'ytd' AND qtrs BETWEEN 1 AND 4"), [*key, "value_date"], [F.col("qtrs").desc(), F.col("tradable_from").desc(), F.col("value").desc()])
    ytd = longest.select(*key, "kind", "value_date", "value", "tradable_from", F.lit(0).alias("_p"))
    best = first_per_group(quarter.unionByName(fourth).unionByName(plain).unionByName(ytd), [*key, "value_date"], [F.col("_p").asc(), F.col("tradable_from").desc(), F.col("value").desc()]).drop("_p")
    dated = asof_join(best, year_ends.select("cik", F.col("value_date").alias("fiscal_end")), "value_date", "fiscal_end", ["fiscal_end"], by=["cik"], direction="forward", strict=False, tolerance_days=370)
    out = dated.where("fiscal_end IS NOT NULL").withColumn("fqtr", (4 - F.round(F.datediff("fiscal_end", "value_date") / 91.3)).cast("int"))
    first = F.min("tradable_from").over(Window.partitionBy("cik", "value_date"))
    return out.withColumns({"fyear": fiscal_year_of(F.col("fiscal_end")), "rdq": first})


# --- footnotes -------------------------------------------------------------------------------------------------------


def pensions(facts: DataFrame, assets_tag: str, obligation_tag: str) -> DataFrame:
    """(adsh, value_date, assets, obligation, rule): one rule for both elements, else each by its own first rule."""
    scopes = ["total", "domestic", "foreign", "none"]
    scoped = facts.where(F.col("tag").isin(assets_tag, obligation_tag)).withColumn("scope", pension_scope(F.col("segments")))
    cells = [F.max(F.when((F.col("tag") == t) & (F.col("scope") == s), F.col("value"))).alias(f"_{n}_{s}") for n, t in (("a", assets_tag), ("o", obligation_tag)) for s in scopes]
    others = [F.bool_or((F.col("tag") == t) & F.col("scope").isin("opeb", "plan_other")).alias(f"_{n}_other") for n, t in (("a", assets_tag), ("o", obligation_tag))]
    wide = scoped.groupBy("adsh", "value_date").agg(*cells, *others)
    rules = [pension_rules({s: F.col(f"_{n}_{s}") for s in scopes}, F.col(f"_{n}_other")) for n in "ao"]
    assets, obligation, rule = by_one_rule(*rules)
    return wide.select("adsh", "value_date", assets.alias("assets"), obligation.alias("obligation"), rule.alias("rule"))


def segments(facts: DataFrame, axis: str, tag: str) -> DataFrame:
    """One row per filing, period and member of an axis alone, with readable name, number and industry codes."""
    d = parse_segments(F.col("segments"))
    rows = facts.where(F.col("tag") == tag).withColumn("member", F.when(F.size(d) == 1, F.try_element_at(d, F.lit(axis)))).where("member IS NOT NULL")
    best = first_per_group(rows, ["adsh", "value_date", "member"], [F.col("qtrs").desc(), F.col("value").desc()])
    named = best.withColumn("name", camel_words(F.col("member")))
    sic, naics = sin_codes(F.col("name"))
    number = F.dense_rank().over(Window.partitionBy("cik").orderBy("member")).cast("long")
    return named.select("adsh", "cik", "value_date", "member", "name", "value", number.alias("sid"), sic.alias("sics1"), naics.alias("naicsh"))


def customers(facts: DataFrame, axis: str, tag: str) -> DataFrame:
    rows = segments(facts, axis, tag)
    return rows.select("adsh", "cik", "value_date", F.col("name").alias("customer"), "value", customer_type(F.col("name")).alias("ctype"))


def aoci_items(facts: DataFrame) -> DataFrame:
    """(adsh, value_date, recta, msa): the component's own element first, then the component axis."""
    item, rule = aoci_component(F.col("tag"), F.col("segments"))
    rows = facts.select("adsh", "value_date", "value", item.alias("item"), rule.alias("rule")).where("item IS NOT NULL")
    best = first_per_group(rows, ["adsh", "value_date", "item"], [(F.col("rule") == "element").desc(), F.col("value").desc()])
    return best.groupBy("adsh", "value_date").pivot("item", ["recta", "msa"]).agg(F.max("value"))


def join_footnotes(left: DataFrame, right: DataFrame, keys=("adsh", "value_date")) -> DataFrame:
    """Full outer join on the keys, each key once."""
    return left.join(right, list(keys), "full")


def annual_only(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """Facts of annual reports at the report's own period."""
    yearly = filings.where(F.col("form").isin("10-K", "10-K/A", "10-KT")).select("adsh", F.col("period_date").alias("value_date"))
    return facts.join(yearly, ["adsh", "value_date"], "left_semi")


# Advertising elements in order of preference, gross plant, and what a cover counts shares in.
ADVERTISING_TAGS = ["AdvertisingExpense", "MarketingAndAdvertisingExpense"]
PLANT_TAG = "PropertyPlantAndEquipmentGross"
COVER_FORMS = r"^(10-K|10-Q|20-F|40-F)"


def footnote_items(facts: DataFrame, scale: float = 1e6) -> DataFrame:
    """(cik, value_date, adsh, xad, ppegt) of each filing's undimensioned facts: a year's advertising by the first element
    that is filed, and gross plant at the period's end; a filing with neither has no row.

    ``facts``: cik, adsh, tag, value_date, qtrs, value.  Repeated facts count once, the larger first.
    """
    place = F.array_position(F.array(*map(F.lit, ADVERTISING_TAGS)), F.col("tag"))
    best = F.struct((-place).alias("p"), F.col("value").alias("v"))  # the largest: the first element, then its larger value
    year = (place > 0) & (F.col("qtrs") == 4) & F.col("value").isNotNull()
    plant = (F.col("tag") == PLANT_TAG) & (F.col("qtrs") == 0)
    wide = facts.groupBy("cik", "adsh").agg(
        F.max("value_date").alias("value_date"), (F.max(F.when(year, best))["v"] / scale).alias("xad"), (F.max(F.when(plant, F.col("value"))) / scale).alias("ppegt")
    )
    return wide.where("xad IS NOT NULL OR ppegt IS NOT NULL").select("cik", "value_date", "adsh", "xad", "ppegt")


def cover_shares(facts: DataFrame) -> DataFrame:
    """(cik, adsh, form, known_at, value_date, segments, shares): positive share counts on the covers of periodic reports, one
    for each class (segments, null for the whole) and date that the cover states."""
    rows = facts.where((F.col("tag") == "EntityCommonStockSharesOutstanding") & F.col("form").rlike(COVER_FORMS) & (F.col("value") > 0))
    best = first_per_group(rows, ["adsh", "value_date", "segments"], [F.col("value").desc()])
    return best.select("cik", "adsh", "form", "known_at", "value_date", "segments", F.col("value").alias("shares"))


# --- audits ----------------------------------------------------------------------------------------------------------


def identity_audit(panel: DataFrame, identities: dict[str, tuple[Column, Column, Column]], tolerance: float = 0.01) -> DataFrame:
    """Per identity (left, right, size): rows with both sides, share within ``tolerance`` of the size."""
    out = None
    for name, (left, right, size) in identities.items():
        both = panel.where(left.isNotNull() & right.isNotNull() & (F.abs(size) > 0))
        row = both.agg(F.lit(name).alias("identity"), F.count("*").alias("n"), F.round(F.avg((F.abs(left - right) <= tolerance * F.abs(size)).cast("double")), 4).alias("share"))
        out = row if out is None else out.unionByName(row)
    return out


def coverage(panel: DataFrame, items: list[str], by=()) -> DataFrame:
    """Share of rows with each item, in each group of ``by``."""
    wide = panel.groupBy(*by).agg(*[F.round(F.avg(F.col(i).isNotNull().cast("double")), 4).alias(i) for i in items])
    return wide.unpivot(list(by), items, "item", "share")
