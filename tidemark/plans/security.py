"""Security lifecycle: first trade, delisting, listings, eligibility in two universes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rel import first_per_group
from tidemark.operators.temporal import asof_pred, clip_intervals, merge_intervals


def first_trades(events: DataFrame) -> DataFrame:
    """(cik, first_trade_date, basis, first_pricing_date) from (cik, event_type, event_date).

    A listing registration counts up to the pricing; evidence later than the first periodic report does not.
    """
    first = lambda e: F.min(F.when(F.col("event_type") == e, F.col("event_date")))
    b = events.groupBy("cik").agg(first("LISTING_REGISTRATION").alias("first_8a"), first("IPO_PRICING").alias("first_ipo"), first("PERIODIC_REPORT").alias("first_periodic"), first("FIRST_EDGAR_FILING").alias("first_filing"))
    listed = events.where("event_type = 'LISTING_REGISTRATION'").select("cik", F.col("event_date").alias("_l"))
    anchor = b.where("first_ipo IS NOT NULL").join(listed, "cik").where(F.col("_l") <= F.col("first_ipo")).groupBy("cik").agg(F.max("_l").alias("_anchor"))
    b = b.join(anchor, "cik", "left").withColumn("_evidence", F.coalesce("_anchor", "first_ipo", "first_8a"))
    holds = F.col("_evidence").isNotNull() & (F.col("first_periodic").isNull() | (F.col("first_periodic") >= F.col("_evidence")))
    basis = F.when(holds, F.when(F.col("_evidence") == F.col("first_ipo"), "424B").otherwise("8-A")).when(F.col("first_periodic").isNotNull(), "already_reporting").otherwise("first_edgar_filing")
    return b.select("cik", F.when(holds, F.col("_evidence")).otherwise(F.least("first_filing", "first_periodic")).alias("first_trade_date"), basis.alias("first_trade_basis"), F.col("first_ipo").alias("first_pricing_date"))


def delistings(events: DataFrame, today) -> DataFrame:
    """(cik, delisting_date, reason, form, adsh, is_provisional).

    No notice counts while the company reports, before a later listing, or with a periodic report more than 180 days after
    it; an exchange's notice beats a deregistration, then the earliest.
    """
    day = F.lit(today).cast("date")
    of = lambda e, name: events.where(F.col("event_type") == e).groupBy("cik").agg(F.max("event_date").alias(name))
    notices = events.where("event_type IN ('DELISTING_NOTICE', 'DEREGISTRATION')").join(of("PERIODIC_REPORT", "_report"), "cik", "left").join(of("LISTING_REGISTRATION", "_listed"), "cik", "left")
    alive = F.col("_report") > F.add_months(day, -15)
    relisted, reports_on = F.col("_listed") >= F.col("event_date"), F.datediff("_report", "event_date") > 180
    gone = notices.where(~F.coalesce(alive, F.lit(False)) & ~F.coalesce(relisted, F.lit(False)) & ~F.coalesce(reports_on, F.lit(False)))
    best = first_per_group(gone, ["cik"], [(F.col("event_type") == "DELISTING_NOTICE").desc(), F.col("event_date").asc(), F.col("adsh").asc_nulls_last()])
    reason = F.when(F.col("event_type") == "DELISTING_NOTICE", "exchange_notice").otherwise("deregistration")
    return best.select("cik", F.col("event_date").alias("delisting_date"), reason.alias("reason"), "form", "adsh", (F.datediff(day, F.col("event_date")) < 180).alias("is_provisional"))


def securities(events: DataFrame, share_class: DataFrame, today) -> DataFrame:
    """One row per (cik, class), numbered by a hash of both; companies without mapped classes have ``(common)``."""
    classes = share_class.where("NOT is_excluded AND ticker IS NOT NULL").select("cik", "class_label").distinct()
    rows = first_trades(events).join(classes, "cik", "left").withColumn("class_label", F.coalesce("class_label", F.lit("(common)")))
    rows = rows.join(delistings(events, today).select("cik", "delisting_date", "reason", "is_provisional", F.concat_ws(" ", F.lit("delisting"), "form", "adsh").alias("source_detail")), "cik", "left")
    return rows.withColumn("is_provisional", F.coalesce("is_provisional", F.lit(False))).withColumn("security_id", F.xxhash64(F.col("cik").cast("long"), F.col("class_label")))


def listings(security: DataFrame, share_class: DataFrame, tickers: DataFrame) -> DataFrame:
    """Ticker intervals of each security, cut to its life; classes by the audited map, common stock by the crosswalk."""
    s = security.select("security_id", "cik", "class_label", "first_trade_date", "delisting_date")
    mapped = share_class.where("ticker IS NOT NULL").select("cik", "class_label", "ticker", F.col("effective_from").alias("valid_from"), F.col("effective_to").alias("valid_to"), F.lit("share_class_map").alias("source"))
    own = s.join(mapped, ["cik", "class_label"])
    label = F.when(F.col("source") == "extended", "company_ticker_extended").otherwise("company_ticker").alias("source")
    common = s.where("class_label = '(common)'").join(tickers.select("cik", "ticker", "valid_from", "valid_to", label), "cik")
    both = own.select("security_id", "ticker", "valid_from", "valid_to", "source", "first_trade_date", "delisting_date").unionByName(common.select("security_id", "ticker", "valid_from", "valid_to", "source", "first_trade_date", "delisting_date"))
    return clip_intervals(both, "valid_from", "valid_to", F.col("first_trade_date"), F.col("delisting_date")).drop("first_trade_date", "delisting_date")


def eligibility(security: DataFrame, annual_reports: DataFrame) -> DataFrame:
    """Intervals in which a security's last annual report was actionable within 15 months, in a plain and a strict universe.

    ``annual_reports``: cik, tradable_from.  Strict entry waits for the pricing where a company reported before it traded.
    """
    windows = security.select("security_id", "cik").join(annual_reports.where("tradable_from IS NOT NULL").select("cik", F.col("tradable_from").alias("lo")), "cik").withColumn("hi", F.add_months("lo", 15))
    merged = merge_intervals(windows, ["security_id"], "lo", "hi").join(security.where("first_trade_date IS NOT NULL"), "security_id")
    strict = F.when(F.col("first_trade_basis") == "already_reporting", F.greatest("first_trade_date", "first_pricing_date")).otherwise(F.col("first_trade_date"))
    universes = F.array(F.struct(F.lit("filers_10k_15m").alias("n"), F.col("first_trade_date").alias("e")), F.struct(F.lit("filers_10k_15m_strict").alias("n"), strict.alias("e")))
    rows = merged.select("*", F.explode(universes).alias("_u")).select("security_id", F.col("_u.n").alias("universe_name"), F.col("_u.e").alias("_entry"), "lo", "hi", "first_trade_date", "delisting_date")
    priced = F.when(F.col("_entry") > F.col("first_trade_date"), "annual_report_actionable_within_15m_and_priced").otherwise("annual_report_actionable_within_15m")
    ended = F.when(F.col("delisting_date") < F.col("hi"), "delisted").otherwise("no_annual_report_within_15m")
    out = rows.withColumns({"valid_from": F.greatest("lo", "_entry"), "valid_to": F.least("hi", "delisting_date"), "reason_in": priced, "reason_out": ended})
    return out.where(F.col("valid_from") <= F.col("valid_to")).select("security_id", "universe_name", "valid_from", "valid_to", "reason_in", "reason_out")


def index_universe(security: DataFrame, members: DataFrame, index: str, universe: str) -> DataFrame:
    """Eligibility by membership: spans of one index merged, cut to each security's life."""
    spans = merge_intervals(members.where(F.col("index_name") == index), ["cik"], "valid_from", "valid_to")
    joined = spans.join(security.select("security_id", "cik", "first_trade_date", "delisting_date"), "cik")
    return clip_intervals(joined, "valid_from", "valid_to", F.col("first_trade_date"), F.col("delisting_date")).select("security_id", F.lit(universe).alias("universe_name"), "valid_from", "valid_to")


def universe_at(eligible: DataFrame, security: DataFrame, listing: DataFrame, universe: str, day) -> DataFrame:
    """Members of a universe on a day with the ticker of that day, else the first one known (then flagged)."""
    d = F.lit(day).cast("date")
    members = eligible.where((F.col("universe_name") == universe) & asof_pred(F.col("valid_from"), F.col("valid_to"), d)).select("security_id", "reason_in")
    held = first_per_group(listing.where(asof_pred(F.col("valid_from"), F.col("valid_to"), d)), ["security_id"], [F.col("valid_from").desc(), F.col("ticker").asc()]).select("security_id", F.col("ticker").alias("_now"), "source")
    earliest = first_per_group(listing, ["security_id"], [F.col("valid_from").asc(), F.col("ticker").asc()]).select("security_id", F.col("ticker").alias("_ever"))
    out = members.join(security.select("security_id", "cik", "class_label"), "security_id").join(held, "security_id", "left").join(earliest, "security_id", "left")
    return out.select("security_id", "cik", "class_label", F.coalesce("_now", "_ever").alias("ticker"), F.coalesce(F.col("source") != "company_ticker_extended", F.lit(False)).alias("ticker_is_asof"), "reason_in")


