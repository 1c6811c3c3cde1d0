"""Loaders of reference tables: calendar, ticker and index history, overrides, share classes, events, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import classify_form, clean_ticker, norm_ticker, null_if_empty, only_digits
from tidemark.operators.rel import assert_check, assert_unique, first_per_group, semi

#: A calendar must reach this many days ahead.
HORIZON_DAYS = 365
INDICES = ("SP500", "SP400", "SP600")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all text; gzip is transparent."""
    return spark.read.csv(path, header=True, inferSchema=False)


def build_calendar(sessions: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Dense session numbers and absolute closing times from (session_date, close_time_et)."""
    close = F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.col("session_date").cast("string"), "close_time_et")), zone)
    return sessions.select(F.row_number().over(Window.orderBy("session_date")).alias("session_seq"), "session_date", "close_time_et", close.alias("close_at"))


def load_calendar(raw: DataFrame, today, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    calendar = build_calendar(raw.select(F.col("session_date").cast("date").alias("session_date"), "close_time_et"))
    last = calendar.agg(F.max("session_date").alias("d"), F.datediff(F.max("session_date"), F.lit(today).cast("date")).alias("ahead")).first()
    if last["d"] is None:
        raise ValueError("the calendar is empty")
    if last["ahead"] < horizon_days:
        raise ValueError(f"the calendar ends {last['d']}, less than {horizon_days} days ahead")
    return calendar


def load_ticker_history(raw: DataFrame) -> DataFrame:
    rows = raw.select(F.col("cik").cast("int").alias("cik"), F.upper(F.trim("ticker")).alias("ticker"), "title", F.col("observed_on").cast("date").alias("observed_on"), "source")
    out = first_per_group(rows, ["cik", "ticker", "observed_on"], [F.col("title").asc_nulls_last(), F.col("source").asc_nulls_last()])
    if not out.limit(1).count():
        raise ValueError("the ticker history is empty")
    return out


def load_index_history(raw: DataFrame, index: str) -> DataFrame:
    """Sightings of one index: tickers cleaned, 'nan' names, bad dates and non-digit numbers null, one row a day and ticker."""
    digits = F.trim(F.col("cik"))
    rows = raw.select(
        F.lit(index).alias("index_name"), F.col("observed_on").cast("date").alias("observed_on"), clean_ticker(F.col("ticker")).alias("ticker"),
        F.when(F.lower("name") != "nan", null_if_empty(F.col("name"))).alias("name"), F.when(only_digits(digits), digits).try_cast("int").alias("cik"),
        null_if_empty(F.col("gics_sector")).alias("gics_sector"), null_if_empty(F.col("gics_sub_industry")).alias("gics_sub_industry"),
        F.try_to_date(F.col("date_added"), "yyyy-MM-dd").alias("date_added"),
    ).where("ticker <> ''")
    return first_per_group(rows, ["observed_on", "ticker"], [F.col("cik").asc_nulls_last(), F.col("name").asc_nulls_last(), F.col("gics_sub_industry").asc_nulls_last()])


def load_overrides(raw: DataFrame, loaded: DataFrame | None = None) -> DataFrame:
    """Audited rows only: known index, ticker, positive number, a note; a run that is overridden twice raises."""
    rows = raw.select("index_name", norm_ticker(F.col("ticker")).alias("ticker"), F.col("first_seen").cast("date").alias("first_seen"), F.col("cik").try_cast("int").alias("cik"), F.trim("source_note").alias("source_note"))
    assert_check(rows, F.col("index_name").isin(list(INDICES)) & F.coalesce(F.col("ticker") != "", F.lit(False)) & F.coalesce(F.col("cik") > 0, F.lit(False)) & F.coalesce(F.col("source_note") != "", F.lit(False)) & F.col("first_seen").isNotNull(), "bad override")
    assert_unique(rows, ["index_name", "ticker", "first_seen"])
    return rows if loaded is None else loaded.unionByName(semi(rows, loaded, ["index_name", "ticker", "first_seen"], "left_anti"))


def load_share_classes(raw: DataFrame) -> DataFrame:
    text = lambda c: null_if_empty(F.col(c)).alias(c)
    rows = raw.select(
        F.col("cik").cast("int").alias("cik"), "class_label", text("ticker"), text("prices_with_ticker"), F.col("conversion_ratio").try_cast("double").alias("conversion_ratio"),
        (F.lower(F.trim(F.coalesce("is_excluded", F.lit("")))) == "true").alias("is_excluded"),
        F.coalesce(F.try_to_date(F.col("effective_from"), "yyyy-MM-dd"), F.lit("1900-01-01").cast("date")).alias("effective_from"), F.try_to_date(F.col("effective_to"), "yyyy-MM-dd").alias("effective_to"),
        F.coalesce(null_if_empty(F.col("source")), F.lit("manual")).alias("source"), text("source_note"),
    )
    one = F.col("ticker").isNotNull().cast("int") + F.col("prices_with_ticker").isNotNull().cast("int") + F.col("is_excluded").cast("int")
    assert_check(rows, one == 1, "a class is listed, priced by another, or excluded")
    return assert_check(rows, F.col("prices_with_ticker").isNull() | F.coalesce(F.col("conversion_ratio") > 0, F.lit(False)), "a class priced by another needs a ratio")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): the lines of small reference files in their order, which a split read would not keep."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", r"\r?\n").alias("lines"))
    return whole.select("path", F.posexplode("lines").alias("line", "value")).where("value <> ''")


def csv_in_order(lines: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(path, line, columns): fields of the lines as text; without ``columns`` each file's first line names them, and all
    files have the same.  Lines with fewer fields go."""
    if columns is None:
        head = lines.where("line = 0").select("value").distinct().collect()
        if len(head) != 1:
            raise ValueError(f"files with {len(head)} headers")
        columns, lines = [c.strip().strip('"') for c in head[0]["value"].split(",")], lines.where("line > 0")
    schema = ", ".join(f"`{c}` string" for c in columns) + ", _short string"
    rows = lines.select("path", "line", F.from_csv("value", schema, {"columnNameOfCorruptRecord": "_short"}).alias("x"))
    return rows.where("x._short IS NULL").select("path", "line", *[F.col(f"x.`{c}`").alias(c) for c in columns])


def load_universe(rows: DataFrame) -> DataFrame:
    """The first line of each ticker; ``rows`` as ``csv_in_order`` gives them (ticker, name and any labels)."""
    named = rows.withColumn("ticker", norm_ticker(F.col("ticker"))).where("ticker <> ''")
    return first_per_group(named, ["ticker"], [F.col("path").asc(), F.col("line").asc()]).drop("path", "line")


def load_ticker_map(lines: DataFrame) -> DataFrame:
    """(cik, ticker, name, exchange) of a file without a header: the first line of each ticker with a whole number as cik."""
    rows = csv_in_order(lines, ["cik", "ticker", "name", "exchange"])
    rows = rows.withColumns({"cik": F.trim("cik").try_cast("int"), "ticker": F.upper(F.trim("ticker"))}).where("cik IS NOT NULL AND ticker <> ''")
    return first_per_group(rows, ["ticker"], [F.col("path").asc(), F.col("line").asc()]).select("cik", "ticker", "name", "exchange")


SUBMISSION = """cik string, name string, formerNames array<struct<name:string,`from`:string,`to`:string>>,
filings struct<recent:struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>>>"""
PAGE = "cik string, form array<string>, filingDate array<string>, accessionNumber array<string>"


def submission_events(documents: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(cik, event_type, event_date, form, adsh) of submission documents (SUBMISSION) and overflow pages (PAGE), with the
    first filing of each company as an event of its own."""
    recent = documents.select(F.col("cik").cast("int").alias("cik"), "filings.recent.*")
    blocks = recent if pages is None else recent.unionByName(pages.select(F.col("cik").cast("int").alias("cik"), "form", "filingDate", "accessionNumber"))
    rows = blocks.select("cik", F.explode(F.arrays_zip("form", "filingDate", "accessionNumber")).alias("x")).select("cik", F.col("x.form").alias("form"), F.try_to_date(F.col("x.filingDate"), "yyyy-MM-dd").alias("event_date"), F.col("x.accessionNumber").alias("adsh")).where("event_date IS NOT NULL")
    known = rows.withColumn("event_type", classify_form(F.col("form"))).where("event_type IS NOT NULL")
    first = rows.groupBy("cik").agg(F.min("event_date").alias("event_date")).select("cik", F.lit("FIRST_EDGAR_FILING").alias("event_type"), "event_date", F.lit("").alias("form"), F.lit("").alias("adsh"))
    return known.select("cik", "event_type", "event_date", "form", "adsh").unionByName(first)


def submission_names(documents: DataFrame) -> DataFrame:
    """(cik, name, valid_from, valid_to): former names with their dates, the current one open."""
    former = documents.select(F.col("cik").cast("int").alias("cik"), F.explode("formerNames").alias("x")).select("cik", F.substring("x.name", 1, 200).alias("name"), F.try_to_date(F.substring("x.from", 1, 10)).alias("valid_from"), F.try_to_date(F.substring("x.to", 1, 10)).alias("valid_to"))
    now = documents.where("name <> ''").select(F.col("cik").cast("int").alias("cik"), F.substring("name", 1, 200).alias("name"), F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return former.unionByName(now)


def snapshot_pairs(snapshot: DataFrame) -> DataFrame:
    """(cik, ticker, title) of a snapshot document, a JSON object or list of records; malformed records go."""
    record = "struct<cik_str:string,ticker:string,title:string>"
    listed, keyed = F.from_json("value", f"array<{record}>"), F.map_values(F.from_json("value", f"map<string,{record}>"))
    records = F.when(F.ltrim("value").startswith("["), listed).otherwise(keyed)
    rows = snapshot.select(F.explode(records).alias("x")).select(F.col("x.cik_str").try_cast("int").alias("cik"), norm_ticker(F.col("x.ticker")).alias("ticker"), F.col("x.title").alias("title"))
    return rows.where("cik IS NOT NULL AND ticker <> ''").dropDuplicates(["cik", "ticker"])


def notes_facts(num: DataFrame, sub: DataFrame, dim: DataFrame, archive: str, kinds: list[tuple[str, str]]) -> DataFrame:
    """Footnote facts of one archive with their dimensions and the first kind whose SQL condition holds."""
    kind = F.lit(None).cast("string")
    for name, condition in reversed(kinds):
        kind = F.when(F.expr(condition), name).otherwise(kind)
    joined = num.join(dim.select(F.col("dimhash").alias("dimh"), "segments"), "dimh", "left").join(sub.select("adsh", "cik", "form", "period", "filed"), "adsh")
    return joined.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("archive", F.lit(archive))


def combine_archives(parts: DataFrame) -> DataFrame:
    """Facts of several archives, each once, from the latest archive."""
    return first_per_group(parts, ["adsh", "tag", "version", "ddate", "qtrs", "dimh", "uom"], [F.col("archive").desc()])


def public_floats(text_facts: DataFrame) -> DataFrame:
    """(adsh, float_value, float_date): positive floats with a parseable date, one a filing."""
    rows = text_facts.where("tag = 'EntityPublicFloat'").select("adsh", F.col("value").try_cast("double").alias("float_value"), F.try_to_date(F.col("ddate"), "yyyyMMdd").alias("float_date"))
    return first_per_group(rows.where("float_value > 0 AND float_date IS NOT NULL"), ["adsh"], [F.col("float_date").desc(), F.col("float_value").desc()])


def denormalise(sub: DataFrame, num: DataFrame, tag: DataFrame, pre: DataFrame) -> DataFrame:
    """Facts with filing, taxonomy and presentation columns; the last two may be missing."""
    joined = sub.join(num, "adsh").join(tag.select("tag", "version", "tlabel", "doc"), ["tag", "version"], "left")
    return joined.join(pre.select("adsh", "tag", "version", "stmt", "line", "plabel"), ["adsh", "tag", "version"], "left")
