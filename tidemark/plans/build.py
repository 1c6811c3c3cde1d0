"""From raw files to derived tables in one call, rebuilding what has changed and what depends on it.

A step names the tables and files that it is made of.  Its mark is a digest of its own version, of its files and of the
manifests of its tables; a step whose mark is that of the stored table is kept.  Every step's table changes at once, so a
build that dies goes on where it stopped.  Optional files and tables may lack: the step gets None for them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import parse_quarter
from tidemark.operators.rel import table_digest
from tidemark.plans import cross, gold, silver, spine
from tidemark.plans.concept_config import ConceptConfig
from tidemark.sources import bronze, reference
from tidemark.sources.tables import Tables

#: Files up to this size are compared by content, larger ones by size and time of change.
READ_BYTES = 256 << 20


@dataclass(frozen=True)
class Step:
    """``build`` gets ``tables`` (name -> DataFrame or None) and ``files`` (name -> path or None).

    ``by`` with ``parts`` makes a table of parts: ``parts`` lists (part, file) of the raw folder, ``build`` is called with
    ``files`` of one part, and only parts whose file changed are built anew.
    """

    name: str
    build: Callable
    needs: Sequence[str] = ()
    wants: Sequence[str] = ()
    files: Sequence[str] = ()
    wanted_files: Sequence[str] = ()
    by: str | None = None
    parts: Callable | None = None
    version: str = "1"


@dataclass(frozen=True)
class Done:
    name: str
    state: str  # built, kept or absent
    parts: tuple[str, ...] = ()


class Raw:
    """Files below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        at = self._path(name)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def mark(self, name: str) -> str:
        """A digest of a file, or of all files of a folder, read by Spark; ``-`` where there is none."""
        if not self.exists(name):
            return "-"
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.root}/{name}")
        small = found.where(F.col("length") <= READ_BYTES).select("path", F.sha2("content", 256).alias("is"))
        large = found.where(F.col("length") > READ_BYTES).select("path", F.concat_ws("@", F.col("length").cast("string"), F.col("modificationTime").cast("string")).alias("is"))
        return "/".join(str(x) for x in table_digest(small.union(large)).first())


def _mark(*what) -> str:
    return hashlib.sha256(repr(what).encode()).hexdigest()


def in_order(steps: Sequence[Step]) -> list[Step]:
    """Steps after those they need; a cycle, an unknown table and a table with two steps raise ValueError."""
    named = {s.name: s for s in steps}
    if len(named) < len(steps):
        raise ValueError("a table has two steps")
    if unknown := {n for s in steps for n in (*s.needs, *s.wants)} - set(named):
        raise ValueError(f"no step makes {sorted(unknown)}")
    return [named[n] for n in TopologicalSorter({s.name: (*s.needs, *s.wants) for s in steps}).static_order()]


def build(spark: SparkSession, steps: Sequence[Step], raw_root: str, table_root: str, only: Sequence[str] | None = None) -> list[Done]:
    """Bring every table up to date (with ``only``: those tables and what they are made of); what was done, in order.

    A step that lacks a needed file or table is absent: its stored table stays out of use by others but is not deleted.
    """
    raw, tables, present, done = Raw(spark, raw_root), Tables(spark, table_root), {}, []
    order = in_order(steps)
    if only is not None:
        wanted, named = set(only), {s.name: s for s in order}
        if unknown := wanted - set(named):
            raise ValueError(f"no step makes {sorted(unknown)}")
        for s in reversed(order):
            if s.name in wanted:
                wanted.update((*s.needs, *s.wants))
        order = [s for s in order if s.name in wanted]
    for step in order:
        marks = {f: raw.mark(f) for f in (*step.files, *step.wanted_files)}
        if any(marks[f] == "-" for f in step.files) or any(present.get(n) is None for n in step.needs):
            done.append(Done(step.name, "absent"))
            continue
        own = _mark(step.version, sorted(marks.items()), sorted((n, present.get(n)) for n in (*step.needs, *step.wants)))
        inputs = {n: tables.read(n) if present.get(n) else None for n in (*step.needs, *step.wants)}
        files = {f: f"{raw.root}/{f}" if m != "-" else None for f, m in marks.items()}
        stored = tables.manifest(step.name)
        note = stored["note"] if stored else {}
        if step.parts is None:
            if note.get("mark") != own:
                tables.write(step.name, step.build(inputs, files), note={"mark": own})
                done.append(Done(step.name, "built"))
            else:
                done.append(Done(step.name, "kept"))
        else:
            now = {part: _mark(own, raw.mark(f)) for part, f in step.parts(raw)}
            held = note.get("parts", {})
            stale = [p for p in now if held.get(p) != now[p]]
            gone = [p for p in held if p not in now]
            if not now:
                done.append(Done(step.name, "absent"))
                continue
            for part, f in step.parts(raw):
                if part in stale:  # each part is stored by itself: a build that dies keeps those before it
                    held = {**{p: m for p, m in held.items() if p not in gone}, part: now[part]}
                    tables.replace_parts(step.name, step.build(inputs, files | {"part": f"{raw.root}/{f}"}).withColumn(step.by, F.lit(part)), step.by, {"parts": held}, [part, *gone])
            if gone and not stale:
                held = {p: m for p, m in held.items() if p not in gone}
                tables.replace_parts(step.name, tables.read(step.name).limit(0), step.by, {"parts": held}, gone)
            done.append(Done(step.name, "built" if stale or gone else "kept", tuple(stale)))
        at = tables.manifest(step.name)
        present[step.name] = _mark(at["parts"])
    return done


# --- the steps of the engine -------------------------------------------------------------------------------------------


def quarters_of(table: str) -> Callable:
    """(quarter, file) for each folder ``quarters/<quarter>`` that has the table's file."""

    def parts(raw: Raw) -> list[tuple[str, str]]:
        found = [q for q in raw.names("quarters") if raw.exists(f"quarters/{q}/{table}.txt")]
        return [(q, f"quarters/{q}/{table}.txt") for q in sorted(found, key=parse_quarter)]

    return parts


def companies(filed: DataFrame) -> DataFrame:
    """(cik, name_latest, sic_latest, first_filed, last_filed) of the filings' companies."""
    newest = F.struct("filed_date", "adsh")
    return filed.where("cik IS NOT NULL").groupBy("cik").agg(
        F.max_by("name", newest).alias("name_latest"), F.max_by("sic", newest).alias("sic_latest"), F.min("filed_date").alias("first_filed"), F.max("filed_date").alias("last_filed")
    )


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


UNIVERSE = "ticker string, name string"
OVERRIDES = "index_name string, ticker string, first_seen date, cik int, source_note string"
NAMES = "cik int, name string, valid_from date, valid_to date"
CLASSES = "cik int, class_label string, ticker string, prices_with_ticker string, conversion_ratio double, is_excluded boolean, effective_from date, effective_to date, source string, source_note string"
MEMBERS = "index_name string, cik int, ticker string, gics_sector string, gics_sub_industry string, valid_from date, valid_to date"


def standard_steps(spark: SparkSession, today, config: ConceptConfig, indices: Sequence[str] = reference.INDICES, floor="2009-01-01", horizon_days: int = reference.HORIZON_DAYS) -> list[Step]:
    """Raw quarters and reference files to silver, spine and gold; ``today`` closes what is open and bounds periods.

    Needed: ``quarters/<YYYYqN>/{sub,tag,num,pre}.txt``, ``lookups/trading_calendar.csv`` and ``ticker_history.csv``.
    Optional below ``lookups``: an ``index_history_<index>.csv`` each, ``universe.csv``, ``tickers.csv``, ``overrides.csv``,
    ``share_classes.csv`` and ``submissions`` (JSON documents).
    """
    csv = lambda path: reference.read_csv(spark, path)
    or_empty = lambda df, schema: df if df is not None else _empty(spark, schema)
    ref = lambda name: f"lookups/{name}.csv"
    history = {i: ref(f"index_history_{i}") for i in indices}

    def bronze_step(table: str) -> Step:
        read = lambda t, f: bronze.read_delimited(spark, f["part"], bronze.COLUMNS[table])
        return Step(f"{table}_raw", read, by="source_quarter", parts=quarters_of(table))

    def index_history(t, f):
        parts = [reference.load_index_history(csv(f[path]), index) for index, path in history.items() if f[path]]
        out = parts[0] if parts else reference.load_index_history(_empty(spark, "observed_on string, ticker string, name string, cik string, gics_sector string, gics_sub_industry string, date_added string"), "none")
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def tickers(t, f):
        seen = spine.company_tickers(t["ticker_history"], or_empty(t["universe"], UNIVERSE), today)
        return spine.extend_back(seen, t["company"], floor)

    def captures(t, f):
        return spine.captures(t["index_history"], ["index_name"]).select("index_name", "observed_on", "is_partial")

    # runs, sightings and intervals are tables of their own: each plan stays as short as its step
    def runs(t, f):
        names, overrides = or_empty(t["company_name"], NAMES), or_empty(t["overrides"], OVERRIDES)
        return spine.resolve_runs(t["index_history"], t["company_ticker"], t["company"], names, overrides, t["index_capture"], t["security_event"], t["sub"])

    def sightings(t, f):
        at = t["index_capture"].withColumn("_sn", F.row_number().over(Window.partitionBy("index_name").orderBy("observed_on")).cast("long")).drop("is_partial")
        known = t["index_run"].where("cik IS NOT NULL").select("index_name", "ticker", "first_sn", "last_sn", F.col("cik").alias("_cik"))
        placed = t["index_history"].join(at, ["index_name", "observed_on"]).join(known, ["index_name", "ticker"]).where(F.col("_sn").between(F.col("first_sn"), F.col("last_sn")))
        return spine.fill_sectors(placed.withColumn("cik", F.col("_cik")).drop("_cik", "_sn", "first_sn", "last_sn"))

    def members(t, f):
        seen = t["index_sighting"]
        if not seen.limit(1).count():
            return _empty(spark, MEMBERS)
        return spine.split_successions(spine.membership(seen, t["index_capture"]), t["succession"])

    def panel(t, f):
        rows = t["tradable_financials"].drop("index_name", "gics_sector", "gics_sub_industry").join(t["company"].select("cik", F.col("sic_latest").alias("sic")), "cik", "left")
        return cross.peer_panel(rows, t["index_timeline"], config, standard_tags=t["tag"].where("NOT custom"), faces=t["debt_face"], until=today)

    preferred = list(indices)
    return [
        *[bronze_step(x) for x in bronze.COLUMNS],
        Step("trading_calendar", lambda t, f: reference.load_calendar(csv(f[ref("trading_calendar")]), today, horizon_days), files=[ref("trading_calendar")]),
        Step("ticker_history", lambda t, f: reference.load_ticker_history(csv(f[ref("ticker_history")])), files=[ref("ticker_history")]),
        Step("index_history", index_history, wanted_files=list(history.values())),
        Step("universe", lambda t, f: reference.load_universe(reference.csv_in_order(reference.read_lines(spark, f[ref("universe")]))), files=[ref("universe")]),
        Step("ticker_map", lambda t, f: reference.load_ticker_map(reference.read_lines(spark, f[ref("tickers")])), files=[ref("tickers")]),
        Step("overrides", lambda t, f: reference.load_overrides(csv(f[ref("overrides")])), files=[ref("overrides")]),
        Step("share_class", lambda t, f: reference.load_share_classes(csv(f[ref("share_classes")])), files=[ref("share_classes")]),
        Step("security_event", lambda t, f: reference.submission_events(spark.read.schema(reference.SUBMISSION).json(f["lookups/submissions"])), files=["lookups/submissions"]),
        Step("company_name", lambda t, f: reference.submission_names(spark.read.schema(reference.SUBMISSION).json(f["lookups/submissions"])), files=["lookups/submissions"]),
        Step("sub", lambda t, f: silver.filings(t["sub_raw"], t["trading_calendar"]), ["sub_raw", "trading_calendar"]),
        Step("tag", lambda t, f: silver.tags(t["tag_raw"]), ["tag_raw"]),
        Step("pre", lambda t, f: silver.presentation(t["pre_raw"]), ["pre_raw"]),
        Step("num", lambda t, f: silver.facts(t["num_raw"], t["sub"], t["tag"]), ["num_raw", "sub", "tag"]),
        Step("company", lambda t, f: companies(t["sub"]), ["sub"]),
        Step("company_ticker", tickers, ["ticker_history", "company"], ["universe"]),
        Step("succession", lambda t, f: spine.successions(t["company_ticker"], t["company"]), ["company_ticker", "company"]),
        Step("index_capture", captures, ["index_history"]),
        Step("index_run", runs, ["index_history", "index_capture", "company_ticker", "company", "sub"], ["company_name", "security_event", "overrides"]),
        Step("index_sighting", sightings, ["index_history", "index_capture", "index_run"]),
        Step("index_membership", members, ["index_sighting", "index_capture", "succession"]),
        Step("index_timeline", lambda t, f: spine.membership_timeline(t["index_membership"], preferred), ["index_membership"]),
        Step("suspect_fact", lambda t, f: gold.suspect_facts(t["num"]), ["num"]),
        Step("tradable_financials", lambda t, f: gold.tradable_financials(t["num"], t["company_ticker"], t["index_timeline"], t["suspect_fact"]), ["num", "company_ticker", "index_timeline", "suspect_fact"]),
        Step("debt_face", lambda t, f: gold.debt_face(t["sub"], t["pre"], t["num"]), ["sub", "pre", "num"]),
        Step("share_class_shares", lambda t, f: gold.share_class_shares(t["num"], or_empty(t["share_class"], CLASSES)), ["num"], ["share_class"]),
        Step("peer_stats", panel, ["tradable_financials", "index_timeline", "company", "tag", "debt_face"]),
    ]
