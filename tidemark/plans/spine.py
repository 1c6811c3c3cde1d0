"""Identity spine: dated company-ticker intervals, successions, index membership, timelines, accessors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import norm_company_name, norm_ticker, sector_canonical
from tidemark.operators.rel import first_per_group, union_prefer
from tidemark.operators.temporal import FOREVER, asof_pred, bridge_islands, flatten_intervals, interval_join, islands, nearest_join, numbered_captures

BRIDGE_DAYS = 200


def captures(sightings: DataFrame, keys=(), around: int = 6, share: float = 0.85, size_between: tuple[int, int] | None = None) -> DataFrame:
    """(keys, observed_on, n_rows, is_partial): a capture is partial below 0.85 of the largest of the six either side.

    With ``size_between`` a capture outside is partial and no measure for others.
    """
    counts = sightings.groupBy(*keys, "observed_on").agg(F.count("*").alias("n_rows"))
    odd = ~F.col("n_rows").between(*size_between) if size_between else F.lit(False)
    w = Window.partitionBy(*keys).orderBy("observed_on").rowsBetween(-around, around)
    bar = F.max(F.when(~odd, F.col("n_rows"))).over(w)
    return counts.withColumn("is_partial", odd | F.coalesce(F.col("n_rows") < share * bar, F.lit(False)))


def company_tickers(sightings: DataFrame, universe: DataFrame, today) -> DataFrame:
    """Dated (cik, ticker) intervals, one primary per overlapping run: current, in the universe, longest, alphabetical."""
    spans = bridge_islands(sightings, captures(sightings), ["cik", "ticker"], max_gap_days=BRIDGE_DAYS).drop("last_seen")
    w = Window.partitionBy("cik").orderBy("valid_from", "ticker")
    before = F.max(F.coalesce("valid_to", F.lit(FOREVER).cast("date"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("_new", (before.isNull() | (F.col("valid_from") >= before)).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    listed = F.broadcast(universe.select("ticker").distinct().withColumn("_in", F.lit(True)))
    length = F.datediff(F.coalesce(F.col("valid_to"), F.lit(today).cast("date")), F.col("valid_from"))
    order = [F.col("valid_to").isNull().desc(), F.col("_in").desc_nulls_last(), length.desc(), F.col("ticker").asc()]
    rank = F.row_number().over(Window.partitionBy("cik", "_run").orderBy(*order))
    return runs.join(listed, "ticker", "left").withColumn("is_primary", rank == 1).select("cik", "ticker", "valid_from", "valid_to", "is_primary", F.lit("observed").alias("source"))


def extend_back(tickers: DataFrame, companies: DataFrame, floor) -> DataFrame:
    """Intervals back to the first filing for companies with one primary ticker ever, seen by the archive's floor."""
    lone = tickers.where("is_primary").groupBy("cik").agg(F.countDistinct("ticker").alias("_n"), F.min("ticker").alias("ticker"), F.min("valid_from").alias("first_seen"))
    lone = lone.where((F.col("_n") == 1) & (F.col("first_seen") <= F.lit(floor).cast("date"))).drop("_n")
    early = lone.join(companies.select("cik", "first_filed"), "cik").where(F.col("first_filed") < F.col("first_seen"))
    others = tickers.select(F.col("cik").alias("_o"), "ticker", F.col("valid_from").alias("_of"), F.coalesce("valid_to", F.lit(FOREVER).cast("date")).alias("_ot"))
    held = early.join(others, "ticker").where((F.col("_o") != F.col("cik")) & (F.col("_of") < F.col("first_seen"))).groupBy("cik").agg(F.max("_ot").alias("_held"))
    start = F.greatest("first_filed", "_held")
    out = early.join(held, "cik", "left").withColumn("valid_from", start).where(F.col("valid_from") < F.col("first_seen"))
    return tickers.unionByName(out.select("cik", "ticker", "valid_from", F.col("first_seen").alias("valid_to"), F.lit(True).alias("is_primary"), F.lit("extended").alias("source")))


#: Days from the end of one holder's interval to the start of the next one's, and of a slice of the calendar they meet in.
HANDOFF, SLICE = (-45, 120), 14


def successions(tickers: DataFrame, companies: DataFrame) -> DataFrame:
    """(old_cik, new_cik, ticker, handoff_date): a primary ticker passes on within -45 to +120 days to a later registrant.

    Intervals meet by ticker and slice of the calendar: a start lies in one slice, an end asks those of its 166 days, so hardly
    a pair outside them is made.  Only holders with several intervals of a ticker can repeat a pair; only theirs are ranked.
    """
    p = tickers.where("is_primary")
    slice_of = lambda c, n=0: F.floor((F.datediff(c, F.lit("1970-01-01").cast("date")) + n) / SLICE)
    alone = lambda c: (F.count("*").over(Window.partitionBy(c, "ticker")) == 1).alias("_alone")
    old = companies.select(F.col("cik").alias("old_cik"), F.col("first_filed").alias("_of"), F.col("last_filed").alias("old_last_filed"))
    new = companies.select(F.col("cik").alias("new_cik"), F.col("first_filed").alias("new_first_filed"))
    a = p.where("valid_to IS NOT NULL").select(F.col("cik").alias("old_cik"), "ticker", F.col("valid_to").alias("_end")).join(old, "old_cik")
    b = p.select(F.col("cik").alias("new_cik"), "ticker", F.col("valid_from").alias("handoff_date")).join(new, "new_cik", "left")
    a = a.select("*", alone("old_cik")).withColumn("_slice", F.explode(F.sequence(slice_of("_end", HANDOFF[0]), slice_of("_end", HANDOFF[1]))))
    b = b.select("*", alone("new_cik")).withColumn("_slice", slice_of("handoff_date"))
    later = (F.datediff("new_first_filed", "_of") > 30) | (F.col("new_first_filed").isNull() & (F.datediff("_end", "old_last_filed") <= 400))

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        met = a.drop("_alone").join(b.drop("_alone"), ["ticker", "_slice"])
        held = (F.col("old_cik") != F.col("new_cik")) & F.datediff("handoff_date", "_end").between(*HANDOFF) & later
        return met.where(held).select("old_cik", "new_cik", "ticker", "handoff_date", "old_last_filed", "new_first_filed")

    again = pairs(a.where("NOT _alone"), b).unionByName(pairs(a.where("_alone"), b.where("NOT _alone")))
    best = first_per_group(again, ["old_cik", "new_cik", "ticker"], [F.col("handoff_date").asc()])
    return pairs(a.where("_alone"), b.where("_alone")).unionByName(best)


def ticker_at(tickers: DataFrame, day) -> DataFrame:
    """The ticker of every company on a day: primary first, then the newest interval."""
    held = tickers.where(asof_pred(F.col("valid_from"), F.col("valid_to"), F.lit(day).cast("date")))
    return first_per_group(held, ["cik"], [F.col("is_primary").desc(), F.col("valid_from").desc(), F.col("ticker").asc()])


def cik_at(tickers: DataFrame, day) -> DataFrame:
    held = tickers.where(asof_pred(F.col("valid_from"), F.col("valid_to"), F.lit(day).cast("date")))
    return first_per_group(held, ["ticker"], [F.col("is_primary").desc(), F.col("valid_from").desc(), F.col("cik").asc()])


def cik_at_strict(tickers: DataFrame, ticker: str, day) -> int:
    """The company of one ticker on a day; raises LookupError where none held it."""
    rows = cik_at(tickers.where(F.col("ticker") == norm_ticker(F.lit(ticker))), day).select("cik").collect()
    if not rows:
        raise LookupError(f"no company held {ticker} on {day}")
    return rows[0]["cik"]


def company_labels(companies: DataFrame, tickers: DataFrame) -> DataFrame:
    newest = first_per_group(tickers, ["cik"], [F.col("is_primary").desc(), F.col("valid_to").isNull().desc(), F.col("valid_from").desc(), F.col("ticker").asc()])
    current = tickers.groupBy("cik").agg(F.bool_or(F.col("valid_to").isNull()).alias("ticker_is_current"))
    return companies.join(newest.select("cik", F.col("ticker").alias("ticker_latest")), "cik", "left").join(current, "cik", "left").withColumn("ticker_is_current", F.coalesce("ticker_is_current", F.lit(False)))


def subtract_sightings(sightings: DataFrame, oversized: DataFrame, sibling: DataFrame, within_days: int = 45) -> DataFrame:
    """Rows of oversized captures that the sibling index's nearest capture also lists go.

    ``oversized``: observed_on of the captures too large to be one index.
    """
    days = sibling.select("observed_on").distinct().select(F.lit(1).alias("k"), F.col("observed_on").alias("sib_on"))
    near = nearest_join(oversized.select("observed_on").withColumn("k", F.lit(1)), days, "k", "observed_on", "sib_on", ["sib_on"], ["observed_on"], within_days).drop("k")
    listed = near.where("sib_on IS NOT NULL").join(sibling.select(F.col("observed_on").alias("sib_on"), "ticker"), "sib_on").select("observed_on", "ticker").distinct()
    return sightings.join(listed, ["observed_on", "ticker"], "left_anti")


#: Days by which a name may outlive its window, and a company's filings a run, on either side.
NAME_GRACE = 200


def filing_spans(companies: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """(cik, first_filed, last_filed) of each company, by its events where they are known, else by its own filings."""
    known = companies.select("cik", *[F.col(c) if c in companies.columns else F.lit(None).cast("date").alias(c) for c in ("first_filed", "last_filed")])
    if events is None:
        return known
    seen = events.groupBy("cik").agg(F.min("event_date").alias("_first"), F.max("event_date").alias("_last"))
    return known.join(seen, "cik", "left").select("cik", F.coalesce("_first", "first_filed").alias("first_filed"), F.coalesce("_last", "last_filed").alias("last_filed"))


def dated_names(names: DataFrame, companies: DataFrame, events: DataFrame | None = None, filings: DataFrame | None = None) -> DataFrame:
    """(cik, name, valid_from, valid_to): normalised names that are not empty, each with the days on which it was borne.

    Former names have their own dates.  A current name (null start) begins where the last former one ended, else with the
    company's first filing, and is open.  A name on filings runs from its first use to its last.
    """
    former = names.where("valid_from IS NOT NULL").groupBy("cik").agg(F.max("valid_to").alias("_former"))
    start = filing_spans(companies, events).select("cik", F.col("first_filed").alias("_first"))
    parts = [names.select("cik", "name", "valid_from", "valid_to")]
    if "name_latest" in companies.columns:
        parts.append(companies.select("cik", F.col("name_latest").alias("name"), F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    begun = F.coalesce("valid_from", "_former", "_first", F.lit("1900-01-01").cast("date"))
    rows = rows.join(former, "cik", "left").join(start, "cik", "left").select("cik", "name", begun.alias("valid_from"), "valid_to")
    if filings is not None:
        used = filings.where("cik IS NOT NULL").groupBy("cik", "name").agg(F.min("filed_date").alias("valid_from"), F.max("filed_date").alias("valid_to"))
        rows = rows.unionByName(used)
    return rows.select("cik", norm_company_name(F.col("name")).alias("name"), "valid_from", "valid_to").where("name <> ''").distinct()


def named_companies(runs: DataFrame, printed: DataFrame, names: DataFrame, spans: DataFrame | None, key: list[str]) -> DataFrame:
    """(key, cik): the one company that a run's printed names can mean.

    ``runs``: key, first_seen, last_seen; ``printed``: key, name (normalised); ``names`` as ``dated_names``; ``spans`` as
    ``filing_spans``, or None for no bound.  A company must have borne the name and have filed within the grace of the run.
    One that bore it when the run began goes before those that took it on later; two of a kind decide nothing.
    """
    bore = runs.join(printed, key).join(names.select("cik", "name", F.col("valid_from").alias("_nf"), F.date_add("valid_to", NAME_GRACE).alias("_nt")), "name")
    bore = bore.withColumn("_nf", F.date_sub("_nf", NAME_GRACE)).where((F.col("_nf") <= F.col("last_seen")) & (F.col("_nt").isNull() | (F.col("_nt") >= F.col("first_seen"))))
    if spans is not None:
        filed = (F.date_sub("first_filed", NAME_GRACE) <= F.col("last_seen")) & (F.date_add("last_filed", NAME_GRACE) >= F.col("first_seen"))
        bore = bore.join(spans, "cik").where(filed)
    at_start = F.bool_or((F.col("_nf") <= F.col("first_seen")) & (F.col("_nt").isNull() | (F.col("_nt") >= F.col("first_seen"))))
    mine = bore.groupBy(*key, "cik").agg(at_start.alias("_start"))
    counts = mine.groupBy(*key).agg(F.count("*").alias("_n"), F.count_if("_start").alias("_ns"), F.min("cik").alias("_any"), F.min(F.when(F.col("_start"), F.col("cik"))).alias("_early"))
    cik = F.when(F.col("_ns") == 1, F.col("_early")).when((F.col("_ns") == 0) & (F.col("_n") == 1), F.col("_any"))
    return counts.select(*key, cik.alias("cik")).where("cik IS NOT NULL")


def resolve_runs(
    sightings: DataFrame, tickers: DataFrame, companies: DataFrame, names: DataFrame, overrides: DataFrame, captures: DataFrame | None = None, events: DataFrame | None = None, filings: DataFrame | None = None
) -> DataFrame:
    """The company of each run of sightings of a ticker, and how it is known.

    In order: the page's own number where the crosswalk agrees or is silent; the crosswalk at the last sighting; a name
    that one company alone bore then (``named_companies``); an audited override whose company has filed; the runs before
    and after, where only partial captures lie between and they agree.  Unresolved runs keep a null cik.  ``captures``
    (index_name, observed_on, is_partial) are numbered for each index by itself; without it, they are the days with
    sightings, all whole.  ``companies``: cik and, where known, name_latest, first_filed, last_filed; ``events`` (cik,
    event_date) and ``filings`` (cik, name, filed_date) widen what is known of filing spans and names.
    """
    if captures is None:
        captures = sightings.select("index_name", "observed_on", F.lit(False).alias("is_partial")).distinct()
    days = Window.partitionBy("index_name").orderBy("observed_on")  # a row per capture of one index
    known = captures.withColumn("sn", F.row_number().over(days).cast("long")).withColumn("whole", F.sum(F.when(F.col("is_partial"), 0).otherwise(1)).over(days))
    obs = sightings.join(known.select("index_name", "observed_on", "sn"), ["index_name", "observed_on"])
    runs = islands(obs, ["index_name", "ticker"], "sn").withColumnRenamed("first", "first_sn").withColumnRenamed("last", "last_sn").drop("n")
    inside = obs.join(runs, ["index_name", "ticker"]).where(F.col("sn").between(F.col("first_sn"), F.col("last_sn")))
    key = ["index_name", "ticker", "first_sn"]
    spans = inside.groupBy(*key).agg(F.min("observed_on").alias("first_seen"), F.max("observed_on").alias("last_seen"))
    held = interval_join(spans.select(*key, "last_seen"), tickers.select("cik", "ticker", "is_primary", "valid_from", "valid_to"), ["ticker"], "last_seen", "valid_from", "valid_to")
    crosswalk = first_per_group(held, key, [F.col("is_primary").desc(), F.col("valid_from").desc(), F.col("cik").asc()]).select(*key, F.col("cik").alias("xw_cik"))
    paged = inside.where("cik IS NOT NULL").join(companies.select("cik"), "cik", "left_semi").groupBy(*key, "cik").agg(F.count("*").alias("_n")).join(crosswalk, key, "left")
    page = first_per_group(paged, key, [(F.col("cik") == F.col("xw_cik")).desc_nulls_last(), F.col("_n").desc(), F.col("cik").asc()])
    page = page.where(F.col("xw_cik").isNull() | (F.col("cik") == F.col("xw_cik"))).select(*key, "cik", F.lit("page").alias("cik_source"))
    xw = crosswalk.select(*key, F.col("xw_cik").alias("cik"), F.lit("crosswalk").alias("cik_source"))
    found = page.unionByName(xw).select(*key).distinct()
    open_runs = spans.join(found, key, "left_anti")
    printed = inside.where("name IS NOT NULL AND name <> ''").select(*key, norm_company_name(F.col("name")).alias("name")).where("name <> ''").distinct()
    bounded = events is not None or {"first_filed", "last_filed"} <= set(companies.columns)
    by_name = named_companies(open_runs, printed, dated_names(names, companies, events, filings), filing_spans(companies, events) if bounded else None, key)
    by_name = by_name.join(companies.select("cik"), "cik", "left_semi").select(*key, "cik", F.lit("name").alias("cik_source"))
    by_hand = spans.join(overrides.select("index_name", "ticker", "first_seen", "cik"), ["index_name", "ticker", "first_seen"]).join(companies.select("cik"), "cik", "left_semi").select(*key, "cik", F.lit("override").alias("cik_source"))
    best = union_prefer([page, xw, by_name, by_hand], key)
    resolved = runs.join(spans, key).join(best, key, "left")
    at = known.select("index_name", "sn", "whole", F.when(F.col("is_partial"), 0).otherwise(1).alias("self"))
    first, last = (at.select("index_name", F.col("sn").alias(f"{e}_sn"), F.col("whole").alias(f"_{e}"), F.col("self").alias(f"_{e}_self")) for e in ("first", "last"))
    placed = resolved.join(first, ["index_name", "first_sn"]).join(last, ["index_name", "last_sn"])
    w = Window.partitionBy("index_name", "ticker").orderBy("first_sn")
    # whole captures strictly between two neighbouring runs
    before = F.when(F.col("_first") - F.col("_first_self") - F.lag("_last").over(w) == 0, F.lag("cik").over(w))
    after = F.when(F.lead("_first").over(w) - F.lead("_first_self").over(w) - F.col("_last") == 0, F.lead("cik").over(w))
    bridged = placed.withColumns({"_before": before, "_after": after})
    near = F.when(~F.coalesce(F.col("_before") != F.col("_after"), F.lit(False)), F.coalesce("_before", "_after"))
    source = F.when(F.col("cik").isNotNull(), F.col("cik_source")).when(near.isNotNull(), "bridged")
    return bridged.select(*[c for c in resolved.columns if c not in ("cik", "cik_source")], F.coalesce("cik", near).alias("cik"), source.alias("cik_source"))


def fill_sectors(observations: DataFrame) -> DataFrame:
    """Canonical sector labels; a missing one comes from the nearest-dated sighting of the sub-industry (the label with more
    carriers, then alphabetically, when equally near), else from the company's own nearest."""
    rows = observations.withColumn("gics_sector_raw", F.col("gics_sector")).withColumn("gics_sector", sector_canonical(F.col("gics_sector")))
    ids = ["index_name", "cik", "observed_on", "ticker"]
    missing = rows.where("gics_sector IS NULL")
    carriers = rows.where("gics_sector IS NOT NULL AND gics_sub_industry IS NOT NULL").groupBy("gics_sub_industry", F.col("observed_on").alias("_on"), F.col("gics_sector").alias("_label")).agg(F.count("*").alias("_n"))
    by_sub = nearest_join(missing, carriers, "gics_sub_industry", "observed_on", "_on", ["_label", "_n"], ids, ties=[F.col("_n").desc(), F.col("_label").asc()]).drop("_n", "_on").withColumnRenamed("_label", "_sub")
    own = rows.where("gics_sector IS NOT NULL").select("cik", F.col("observed_on").alias("_on"), F.col("gics_sector").alias("_own")).distinct()
    by_own = nearest_join(by_sub, own, "cik", "observed_on", "_on", ["_own"], ids, ties=[F.col("_own").asc()]).drop("_on")
    filled = by_own.withColumn("gics_sector", F.coalesce("_sub", "_own")).drop("_sub", "_own")
    return rows.where("gics_sector IS NOT NULL").unionByName(filled)


def membership(observations: DataFrame, captures_: DataFrame) -> DataFrame:
    """Membership intervals per (index_name, cik), split where the printed labels change.

    ``observations``: index_name, cik, ticker, observed_on, gics_sector (filled), gics_sector_raw, gics_sub_industry.  A
    segment ends where the next begins, the last one with its span; its sector is the most frequent filled label.
    """
    parts = []
    for (index,) in observations.select("index_name").distinct().collect():  # a handful of indices
        mine = observations.where(F.col("index_name") == index)
        caps = captures_.where(F.col("index_name") == index).select("observed_on", "is_partial")
        parts.append(bridge_islands(mine, caps, ["cik"], max_gap_days=BRIDGE_DAYS).withColumn("index_name", F.lit(index)))
    if not parts:
        raise ValueError("no observations")
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionByName(p)
    spans = spans.select("index_name", "cik", F.col("valid_from").alias("span_from"), "last_seen", F.col("valid_to").alias("span_to"))
    inside = observations.join(spans, ["index_name", "cik"]).where(F.col("observed_on").between(F.col("span_from"), F.col("last_seen")))
    span = ["index_name", "cik", "span_from"]
    w = Window.partitionBy(*span).orderBy("observed_on", "ticker")
    label = F.concat_ws("|", F.coalesce("gics_sector_raw", F.lit("")), F.coalesce("gics_sub_industry", F.lit("")))
    change = (F.lag(label).over(w).isNotNull() & (F.lag(label).over(w) != label)).cast("int")
    seg = inside.withColumn("_change", change).withColumn("_seg", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = seg.groupBy(*span, "span_to", "_seg").agg(
        F.expr("mode() WITHIN GROUP (ORDER BY gics_sector)").alias("gics_sector"), F.first("gics_sub_industry").alias("gics_sub_industry"),
        F.min("observed_on").alias("valid_from"), F.max_by("ticker", F.struct("observed_on", "ticker")).alias("ticker"),
    )
    ahead = F.lead("valid_from").over(Window.partitionBy(*span).orderBy("_seg"))
    return out.withColumn("valid_to", F.coalesce(ahead, F.col("span_to"))).select("index_name", "cik", "ticker", "gics_sector", "gics_sub_industry", "valid_from", "valid_to")


def split_successions(intervals: DataFrame, handoffs: DataFrame) -> DataFrame:
    """Membership of a successor before the handoff belongs to its predecessor: intervals across the cut become two."""
    cuts = first_per_group(handoffs.select(F.col("new_cik").alias("cik"), "old_cik", F.coalesce("handoff_date", "new_first_filed").alias("_cut")), ["cik"], [F.col("_cut").asc(), F.col("old_cik").asc()])
    joined = intervals.join(F.broadcast(cuts), "cik", "left")
    whole = F.col("_cut").isNull() | (F.col("valid_from") >= F.col("_cut"))
    after = joined.where(whole | F.col("valid_to").isNull() | (F.col("valid_to") > F.col("_cut"))).withColumn("valid_from", F.when(whole, F.col("valid_from")).otherwise(F.greatest("valid_from", "_cut")))
    before = joined.where(~whole).withColumns({"cik": F.col("old_cik"), "valid_to": F.least("_cut", F.coalesce("valid_to", F.lit(FOREVER).cast("date")))})
    return after.select(*intervals.columns).unionByName(before.select(*intervals.columns))


def membership_timeline(intervals: DataFrame, preferred: list[str]) -> DataFrame:
    """Disjoint label timeline of each company over all indices: the preferred index first, then the latest start."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, preferred)), F.col("index_name")), F.lit(0)), F.lit(len(preferred) + 1))
    return flatten_intervals(intervals, ["cik"], "valid_from", "valid_to", ["index_name", "gics_sector", "gics_sub_industry"], [order.asc()])


def index_members(intervals: DataFrame, index: str, day) -> DataFrame:
    return intervals.where((F.col("index_name") == index) & asof_pred(F.col("valid_from"), F.col("valid_to"), F.lit(day).cast("date")))
