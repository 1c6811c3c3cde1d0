"""Typed layer: filings with three clocks, taxonomy tags, facts with their vintages, presentation lines, quarterly fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import eastern_instant, null_if_empty, only_digits, strict_number
from tidemark.operators.rel import first_per_group, semi, upsert
from tidemark.operators.temporal import asof_pred, availability, fold_chain, vintage_chain

PLAIN = ["adsh", "name", "countryba", "stprba", "cityba", "zipba", "bas1", "form", "fp", "fye", "aciks"]


def _flag(text: str):
    return null_if_empty(F.col(text)).try_cast("boolean")


def _day(text: str):
    return F.coalesce(F.try_to_date(F.col(text), "yyyyMMdd"), F.try_to_date(F.col(text), "yyyy-MM-dd"))


def filings(sub_raw: DataFrame, calendar: DataFrame) -> DataFrame:
    """One typed row per filing with its instant of publication and first actionable session."""
    typed = sub_raw.where(F.col("adsh").isNotNull()).select(
        *PLAIN,
        F.col("cik").cast("int").alias("cik"),
        F.col("sic").try_cast("int").alias("sic"),
        _day("period").alias("period_date"),
        F.col("fy").try_cast("int").alias("fy"),
        _day("filed").alias("filed_date"),
        eastern_instant(F.col("accepted").try_cast("timestamp")).alias("known_at"),
        _flag("prevrpt").alias("was_amended_later"),
        _flag("detail").alias("is_detailed"),
        null_if_empty(F.col("nciks")).try_cast("int").alias("nciks"),
    )
    return availability(typed, calendar)


def tags(tag_raw: DataFrame) -> DataFrame:
    rows = tag_raw.select("tag", "version", "tlabel", "doc", (F.col("custom") == "1").alias("custom"), (F.col("abstract") == "1").alias("abstract"), "datatype", "iord", "crdr", "source_quarter")
    return first_per_group(rows, ["tag", "version"], [F.col("source_quarter").asc_nulls_last(), F.col("tlabel").asc_nulls_last(), F.col("doc").asc_nulls_last()]).drop("source_quarter")


def typed_facts(num_raw: DataFrame, filed: DataFrame, tag: DataFrame) -> DataFrame:
    clocks = filed.select("adsh", "cik", "filed_date", "known_at", "tradable_from", "period_date", "form")
    rows = num_raw.select(
        "adsh", "tag", "version", _day("ddate").alias("value_date"), F.col("qtrs").cast("int").alias("qtrs"), "uom", "coreg",
        F.nullif("segments", F.lit("")).alias("segments"), strict_number(F.col("value")).alias("value"), "footnote",
    )
    joined = rows.join(clocks, "adsh").join(tag.select("tag", "version", "tlabel"), ["tag", "version"], "left")
    return joined.withColumn("is_original_disclosure", F.datediff("period_date", "value_date") <= 100).drop("period_date")


def facts(num_raw: DataFrame, filed: DataFrame, tag: DataFrame) -> DataFrame:
    """Every version of every fact with its validity interval."""
    return vintage_chain(typed_facts(num_raw, filed, tag))


def presentation(pre_raw: DataFrame) -> DataFrame:
    rows = pre_raw.where(F.col("adsh").isNotNull() & only_digits(F.col("report")) & only_digits(F.col("line"))).select(
        "adsh", F.col("report").cast("int").alias("report"), F.col("line").cast("int").alias("line"), "stmt",
        (F.col("inpth") == "1").alias("inpth"), "rfile", "tag", "version", "plabel", (F.nullif("negating", F.lit("")) == "1").alias("negating"),
    )
    return first_per_group(rows, ["adsh", "report", "line"], [F.struct("stmt", "tag", "version", "plabel", "rfile").asc_nulls_last()])


def fold_quarter(silver: dict[str, DataFrame], raw: dict[str, DataFrame], calendar: DataFrame) -> dict[str, DataFrame]:
    """Fold one quarter's raw tables into the typed ones: filings are overwritten, new tags added, presentation of the
    quarter's filings replaced, and only the touched fact keys rebuilt.  Folding a quarter twice changes nothing."""
    filed = filings(raw["sub"], calendar)
    all_filed = upsert(silver["sub"], filed, ["adsh"])
    all_tags = upsert(silver["tag"], tags(raw["tag"]), ["tag", "version"], overwrite=False)
    lines = presentation(raw["pre"])
    all_lines = semi(silver["pre"], lines, ["adsh"], "left_anti").unionByName(lines)
    return {"sub": all_filed, "tag": all_tags, "pre": all_lines, "num": fold_chain(silver["num"], typed_facts(raw["num"], filed, all_tags))}


def consolidated() -> Column:
    return F.col("segments").isNull() & F.col("coreg").isNull()


MODES = ("asof", "pit", "latest")


def financials(facts_: DataFrame, mode: str, asof=None) -> DataFrame:
    """Consolidated facts by mode: ``pit`` as first disclosed, ``latest`` as last restated, ``asof`` as believed on a day.

    There is no default day: ``asof`` without one raises, and so does an unknown mode.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
    if mode == "asof" and asof is None:
        raise ValueError("mode 'asof' needs a knowledge date")
    rows = facts_.where(consolidated())
    if mode == "pit":
        return rows.where("rank_pit = 1")
    if mode == "latest":
        return rows.where("rank_latest = 1")
    return rows.where(asof_pred(F.col("tradable_from"), F.col("superseded_tradable"), F.lit(asof).cast("date")))
