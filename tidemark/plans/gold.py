"""Derived fact layers: suspect facts, tradable facts, as-of facts, debt on the balance sheet's face, share counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.rel import first_per_group
from tidemark.operators.temporal import interval_join
from tidemark.plans.silver import consolidated

SUSPECT_KEY = ["adsh", "tag", "value_date", "qtrs"]
ANCHORS = ["Assets", "LiabilitiesAndStockholdersEquity"]


def scale_suspects(facts: DataFrame, min_tags: int = 4, min_reference: float = 1e6) -> DataFrame:
    """Values a thousand or a million times below the filing's own comparative, in whole columns of a filing.

    ``facts``: consolidated USD balances with adsh, cik, tag, qtrs, value_date, value, tradable_from.  The comparative is
    the filing's newest value of the tag up to 400 days earlier, and must agree with its own first disclosure.
    """
    f = facts.where((F.col("value") != 0) & F.col("value").isNotNull())
    c = f.select("adsh", "tag", "qtrs", F.col("value_date").alias("cmp_date"), F.col("value").alias("cmp_value"))
    pairs = f.join(c, ["adsh", "tag", "qtrs"]).where((F.col("cmp_date") < F.col("value_date")) & (F.datediff("value_date", "cmp_date") <= 400))
    ratio = F.abs(F.col("cmp_value")) / F.abs(F.col("value"))
    factor = F.when(ratio.between(1e6 / 3, 3e6), 1e6).when(ratio.between(1e3 / 3, 3e3), 1e3)
    small = first_per_group(pairs, SUSPECT_KEY, [F.col("cmp_date").desc(), F.col("cmp_value").desc()]).withColumn("factor", factor).where("factor IS NOT NULL")
    o = f.select("cik", "tag", "qtrs", F.col("value_date").alias("cmp_date"), F.col("adsh").alias("_o_adsh"), F.col("value").alias("orig_value"), F.col("tradable_from").alias("_o_from"))
    on = ["cik", "tag", "qtrs", "cmp_date"]
    joined = small.join(o, on, "left").withColumn("orig_value", F.when((F.col("_o_adsh") != F.col("adsh")) & (F.col("_o_from") <= F.col("tradable_from")), F.col("orig_value")))
    trusted = first_per_group(joined, SUSPECT_KEY, [F.col("orig_value").isNull().asc(), F.col("_o_from").asc(), F.col("orig_value").asc()])
    agrees = F.col("orig_value").isNull() | F.abs("orig_value").between(F.abs(F.col("cmp_value")) / 3, F.abs(F.col("cmp_value")) * 3)
    held = trusted.where(agrees)
    column = ["adsh", "value_date", "factor"]
    sizes = held.groupBy(*column).agg(
        F.count("*").alias("tags_in_filing"), F.max(F.abs(F.col("cmp_value"))).alias("_ref"),
        F.bool_or(F.col("tag").isin(ANCHORS) & (F.abs(F.col("cmp_value")) >= min_reference)).alias("_anchored"),
    )
    whole = sizes.where((F.col("tags_in_filing") >= min_tags) & (F.col("_ref") >= min_reference) & (F.col("_anchored") | (F.col("factor") == 1e6)))
    return held.join(whole, column).select("adsh", "cik", "tag", "value_date", "qtrs", "value", F.lit("scale").alias("reason"), F.col("cmp_value").alias("reference_value"), "factor", "tags_in_filing")


def suspect_facts(facts: DataFrame) -> DataFrame:
    """Facts that no derived layer uses: periods after their filing, and columns in the wrong scale."""
    usd = facts.where(consolidated() & (F.col("uom") == "USD"))
    late = usd.where(F.col("value_date") > F.col("filed_date")).select("adsh", "cik", "tag", "value_date", "qtrs", "value", F.lit("period_after_filing").alias("reason"), F.lit(None).cast("double").alias("reference_value"), F.lit(None).cast("double").alias("factor"), F.lit(0).cast("long").alias("tags_in_filing"))
    standard = usd.where(F.col("qtrs").between(0, 4) & F.col("version").startswith("us-gaap"))
    return scale_suspects(standard).unionByName(late)


def without_suspects(facts: DataFrame, suspects: DataFrame) -> DataFrame:
    return facts.join(suspects.select(*SUSPECT_KEY).distinct(), SUSPECT_KEY, "left_anti")


def tradable_financials(facts: DataFrame, tickers: DataFrame, members: DataFrame, suspects: DataFrame, mode: str = "latest") -> DataFrame:
    """Latest (or with ``pit`` earliest) vintages under the ticker and the index labels of their first session.

    ``*_is_asof`` is true only where an observed interval holds that day.
    """
    rank = {"latest": "rank_latest", "pit": "rank_pit"}[mode]
    rows = without_suspects(facts.where(consolidated() & (F.col(rank) == 1)), suspects)
    primary = tickers.where("is_primary").select("cik", "ticker", F.col("source").alias("ticker_source"), F.col("valid_from").alias("_tf"), F.col("valid_to").alias("_tt"))
    named = interval_join(rows, primary, ["cik"], "tradable_from", "_tf", "_tt", "left").drop("_tf", "_tt")
    timeline = members.select("cik", "index_name", "gics_sector", "gics_sub_industry", F.col("valid_from").alias("_mf"), F.col("valid_to").alias("_mt"))
    out = interval_join(named, timeline, ["cik"], "tradable_from", "_mf", "_mt", "left").drop("_mf", "_mt")
    return out.withColumns({"ticker_is_asof": F.coalesce(F.col("ticker_source") == "observed", F.lit(False)), "sector_is_asof": F.col("gics_sector").isNotNull()})


def fact_asof(facts: DataFrame, members: DataFrame, suspects: DataFrame, since: str, until: str) -> DataFrame:
    """Every vintage of every plausible fact with its interval and the labels of its day."""
    rows = facts.where(consolidated() & F.col("value_date").between(F.lit(since).cast("date"), F.lit(until).cast("date")))
    timeline = members.select("cik", "index_name", "gics_sector", F.col("valid_from").alias("_mf"), F.col("valid_to").alias("_mt"))
    return interval_join(without_suspects(rows, suspects), timeline, ["cik"], "tradable_from", "_mf", "_mt", "left").drop("_mf", "_mt")


# Tags that bound the liabilities of a balance sheet, labels of borrowings, and labels that are none.
ASSET_TAGS = ["Assets"]
EQUITY_TAGS = ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", "PartnersCapital", "MembersEquity", "CommonStockValue", "PreferredStockValue"]
END_TAGS = ["LiabilitiesAndStockholdersEquity", "LiabilitiesAndPartnersCapital"]
FACE_FORMS = ["10-K", "10-K/A", "10-KT", "10-Q", "10-Q/A", "10-QT"]
BORROWING_LABEL = (
    r"(debt|borrow|notes? payable|note payable|loans? payable|loan payable|line of credit|lines of credit|credit facilit|"
    r"credit agreement|term loan|revolv|debenture|bonds?( |,|$)|senior notes|convertible notes|convertible senior|subordinated|"
    r"mortgages? payable|mortgage notes|mortgage loans? payable|repurchase agreement|sold under agreement|"
    r"federal home loan bank|fhlb|financing obligation|financing|commercial paper|construction loan|securitiz|warehouse|"
    r"notes?, net|notes?,? due|junior subordinated|trust preferred|promissory|securities due within|"
    r"^(short-term|long-term|current maturities of long-term) obligations)"
)
NO_BORROWING_LABEL = (
    r"(receivable|held for|held-for|investment|available for sale|available-for-sale|deferred|accrued interest|interest payable|"
    r"deposits|customer|contract|unearned|reserve|allowance|equity|stock|shares|capital|performance bond|guaranty|guarantee|"
    r"warrant|derivative|pension|insurance|tax)"
)
LEASE_BORROWING = r"(debt|borrow|note|loan|financing obligation)"
INTEREST_TAGS = ["InterestExpense", "InterestExpenseNonoperating", "InterestExpenseDebt", "InterestExpenseBorrowings", "InterestExpenseLongTermDebt"]


def is_borrowing(label):
    text = F.lower(label)
    return F.coalesce(text.rlike(BORROWING_LABEL) & ~text.rlike(NO_BORROWING_LABEL) & ~(text.contains("lease") & ~text.rlike(LEASE_BORROWING)), F.lit(False))


def debt_face(filings: DataFrame, lines: DataFrame, facts: DataFrame) -> DataFrame:
    """The balance sheet's face of each filing read for borrowings; zero_by_face with a reason.

    ``filings``: adsh, cik, form, period_date, filed_date, tradable_from, sic; ``lines``: presentation; ``facts``: silver.
    """
    filings = filings.where(F.col("form").isin(FACE_FORMS) & F.col("cik").isNotNull() & F.col("period_date").isNotNull())
    face = lines.where("stmt = 'BS' AND NOT inpth").join(filings.select("adsh"), "adsh", "left_semi").select("adsh", "line", "tag", "version", "plabel")
    line_of = lambda tags, f: f(F.when(F.col("tag").isin(tags), F.col("line")))
    bounds = face.groupBy("adsh").agg(line_of(ASSET_TAGS, F.max).alias("assets_line"), line_of(END_TAGS, F.min).alias("end_line"), line_of(EQUITY_TAGS, F.min).alias("equity_line"))
    until = F.coalesce("equity_line", "end_line")
    liabilities = face.join(bounds, "adsh").where((F.col("line") > F.col("assets_line")) & (F.col("line") < F.coalesce(until, F.lit(2**31 - 1))))
    liabilities = liabilities.select("adsh", "line", "tag", "version", "plabel", is_borrowing(F.col("plabel")).alias("borrows"))
    usd = facts.where(consolidated() & (F.col("uom") == "USD")).join(filings.select("adsh", F.col("period_date").alias("value_date")), ["adsh", "value_date"])
    valued = liabilities.join(usd.where("qtrs = 0").select("adsh", "tag", "version", "value"), ["adsh", "tag", "version"], "left")
    shown = F.concat(F.col("plabel"), F.lit(" ["), F.col("tag"), F.when(~F.col("version").startswith("us-gaap"), ", custom").otherwise(""), F.lit("="), F.coalesce(F.col("value").cast("string"), F.lit("no undimensioned value")), F.lit("]"))
    counts = valued.groupBy("adsh").agg(
        F.count("*").alias("liability_lines"), F.count_if("borrows").alias("borrowing_lines"),
        F.count_if(F.col("borrows") & (F.col("value") > 0)).alias("borrowing_lines_positive"),
        F.count_if(F.col("borrows") & F.col("value").isNull()).alias("borrowing_lines_unvalued"),
        F.sum(F.when(F.col("borrows"), F.col("value"))).alias("borrowing_sum"),
        F.array_sort(F.collect_list(F.when(F.col("borrows"), F.struct("line", shown.alias("shown"))))).alias("_shown"),
    )
    counts = counts.withColumn("borrowing_labels", F.nullif(F.array_join(F.transform("_shown", lambda x: x["shown"]), " | "), F.lit(""))).drop("_shown")
    paid = first_per_group(usd.where(F.col("tag").isin(INTEREST_TAGS) & F.col("qtrs").between(1, 4)), ["adsh"], [F.col("qtrs").desc(), F.col("value").desc()])
    interest = paid.select("adsh", (F.col("value") * 4.0 / F.col("qtrs")).alias("interest_annualised"))
    assets = usd.where("tag = 'Assets' AND qtrs = 0").groupBy("adsh").agg(F.max("value").alias("assets"))
    out = filings.join(bounds, "adsh", "left").join(counts, "adsh", "left").join(interest, "adsh", "left").join(assets, "adsh", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    complete = F.col("assets_line").isNotNull() & until.isNotNull()
    rules = [
        (~complete, "face incomplete"),
        (F.col("sic").between(6000, 6299), "bank or broker: not judged"),
        (zero("borrowing_lines_positive") > 0, "borrowing line present"),
        (zero("borrowing_lines_unvalued") > 0, "borrowing line without an undimensioned value"),
        (F.col("assets").isNull() | (F.col("assets") <= 0), "no total assets"),
        (zero("interest_annualised") > 0.002 * F.col("assets"), "interest expense without a borrowing line"),
    ]
    reason = F.lit("no borrowing line, interest nil")
    for condition, text in reversed(rules):
        reason = F.when(F.coalesce(condition, F.lit(False)), text).otherwise(reason)
    out = out.withColumns({"face_complete": complete, "reason": reason, **{c: zero(c) for c in ("liability_lines", "borrowing_lines", "borrowing_lines_positive", "borrowing_lines_unvalued")}})
    return out.withColumn("zero_by_face", F.col("reason") == "no borrowing line, interest nil").drop("assets_line", "end_line", "equity_line")


# Rungs of the share ladder by tag, of consolidated counts and of sums over mapped classes.
SHARE_RUNGS = {"EntityCommonStockSharesOutstanding": 1, "CommonStockSharesOutstanding": 2, "CommonStockSharesIssued": 3, "WeightedAverageNumberOfDilutedSharesOutstanding": 8, "WeightedAverageNumberOfSharesOutstandingBasic": 9}
CLASS_RUNGS = {"CommonStockSharesOutstanding": 4, "CommonStockSharesIssued": 5}


def _rung(rungs: dict[str, int]):
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in rungs.items() for x in p]), F.col("tag")), F.lit(9))


def mapped_classes(facts: DataFrame, share_class: DataFrame) -> DataFrame:
    """Share facts of classes on the dated allowlist: an equi-join on the constructed dimension."""
    allowed = share_class.where("NOT is_excluded").select("cik", F.concat(F.lit("ClassOfStock="), F.col("class_label"), F.lit(";")).alias("segments"), "class_label", F.col("ticker"), "conversion_ratio", "effective_from", "effective_to")
    joined = facts.where("segments IS NOT NULL").join(allowed, ["cik", "segments"])
    return joined.where((F.col("value_date") >= F.col("effective_from")) & (F.col("effective_to").isNull() | (F.col("value_date") < F.col("effective_to"))))


def shares_outstanding(facts: DataFrame, share_class: DataFrame) -> DataFrame:
    """Share count of each company among facts in force: an instant count within 400 days of the newest period beats an
    average; then the newest date, the rung, the shortest period."""
    seen = facts.where(F.col("coreg").isNull() & F.col("value").isNotNull() & (F.col("uom") == "shares") & F.col("tag").isin(list(SHARE_RUNGS)))
    whole = seen.where("segments IS NULL").select("cik", F.col("value").alias("shares"), "value_date", "tradable_from", F.col("tag").alias("source_tag"), F.lit("consolidated").alias("method"), _rung(SHARE_RUNGS).alias("rung"), "qtrs")
    sums = mapped_classes(seen, share_class).groupBy("cik", "value_date", "tag", "qtrs").agg(F.sum("value").alias("shares"), F.max("tradable_from").alias("tradable_from"))
    by_class = sums.withColumn("rung", _rung(CLASS_RUNGS)).withColumnRenamed("tag", "source_tag").withColumn("method", F.lit("class_sum_mapped"))
    by_class = by_class.join(whole.select("cik", "source_tag", "value_date").distinct(), ["cik", "source_tag", "value_date"], "left_anti")
    ladder = whole.unionByName(by_class.select(*whole.columns)).where("shares > 0")
    newest = F.max("value_date").over(Window.partitionBy("cik"))
    ladder = ladder.withColumn("_instant", (F.col("rung") <= 5) & (F.datediff(newest, F.col("value_date")) <= 400))
    order = [F.col("_instant").desc(), F.col("value_date").desc(), F.col("rung").asc(), F.col("qtrs").asc(), F.col("shares").desc()]
    return first_per_group(ladder, ["cik"], order).drop("_instant", "rung", "qtrs")


def share_class_shares(facts: DataFrame, share_class: DataFrame) -> DataFrame:
    """Every vintage of every mapped class's count; a class that no filing dimensions is inferred where the company has at
    most one, from its consolidated count."""
    shares = facts.where(F.col("coreg").isNull() & (F.col("uom") == "shares") & F.col("tag").isin(list(SHARE_RUNGS)[:3]) & F.col("value").isNotNull())
    mapped = mapped_classes(shares, share_class).withColumn("is_inferred", F.lit(False))
    lone = share_class.where("NOT is_excluded").groupBy("cik").agg(F.count("*").alias("_n"), F.first("class_label").alias("class_label"), F.first("ticker").alias("ticker")).where("_n <= 1").drop("_n")
    inferred = shares.where("segments IS NULL").join(lone, "cik").withColumn("is_inferred", F.lit(True))
    keep = ["cik", "class_label", "ticker", "value_date", "value", "tradable_from", "superseded_tradable", "vintage_seq", "tag", "is_inferred"]
    both = mapped.select(*keep).unionByName(inferred.select(*keep)).withColumnRenamed("tag", "source_tag")
    order = [F.col("is_inferred").asc(), F.col("source_tag").asc(), F.col("value").desc()]
    return first_per_group(both, ["cik", "class_label", "value_date", "vintage_seq"], order)
