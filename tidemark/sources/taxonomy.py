"""Taxonomies as DataFrames: calculation arcs, labels by role, elements, the years in which each was in force.

``documents`` is (year, path, text), a row a file.  Spark's XML functions read each file on the executor that has it; locators
are resolved by joins.  Files that are not XML, or hold nothing of the kind asked for, give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.rel import first_per_group
from tidemark.operators.temporal import islands

FILE = ["year", "path"]
LOCATORS = "loc: array<struct<_href: string, _label: string>>"
CALCULATION = f"calculationLink array<struct<{LOCATORS}, calculationArc: array<struct<_from: string, _to: string, _weight: double>>>>"
LABELS = f"labelLink array<struct<{LOCATORS}, label: array<struct<_VALUE: string, _label: string, _role: string>>, labelArc: array<struct<_from: string, _to: string>>>>"
SCHEMA = "element array<struct<_name: string, _type: string, _abstract: string, _periodType: string, _balance: string>>"
# The standard roles of labels.
LABEL_ROLE = "http://www.xbrl.org/2003/role/label"
DOCUMENTATION_ROLE = "http://www.xbrl.org/2003/role/documentation"


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root/<year>/`` with their years; files elsewhere go."""
    found = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return found.select(F.regexp_extract("path", r"/(\d{4})/", 1).try_cast("int").alias("year"), "path", "text").where("year IS NOT NULL")


def _parsed(documents: DataFrame, schema: str, rows: str) -> DataFrame:
    """(year, path, no, x): the top-level parts ``rows`` of each document, numbered."""
    xml = F.from_xml("text", schema, {"ignoreNamespace": "true"})
    return documents.select(*FILE, xml.alias("x")).select(*FILE, F.posexplode(f"x.{rows}").alias("no", "x"))


def _element(href: Column, prefix: str) -> Column:
    """The element that a locator points at, null where it is not of the taxonomy."""
    return F.nullif(F.regexp_extract(href, rf"#{prefix}_(\w+)$", 1), F.lit(""))


def _located(links: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """(keys, label, element): what each locator's label stands for; of several the last in the file."""
    locs = links.select(*FILE, "no", F.posexplode("x.loc").alias("at", "l")).select(*FILE, "no", "at", F.col("l._label").alias("label"), _element(F.col("l._href"), prefix).alias("element"))
    named = locs.where("label IS NOT NULL AND element IS NOT NULL")
    return first_per_group(named, [*keys, "label"], [F.col("no").desc(), F.col("at").desc()]).select(*keys, "label", "element")


def calculation_arcs(documents: DataFrame, prefix: str = "us-gaap") -> DataFrame:
    """(year, parent, child, weight) of calculation linkbases, each once.

    Labels hold for a whole file; an arc with an end that no locator of the taxonomy has goes; a missing weight is 1.
    """
    links = _parsed(documents, CALCULATION, "calculationLink")
    arcs = links.select(*FILE, F.explode("x.calculationArc").alias("a")).select(*FILE, F.col("a._from").alias("from"), F.col("a._to").alias("to"), F.coalesce("a._weight", F.lit(1.0)).alias("weight"))
    ends = _located(links, FILE, prefix)
    end = lambda label, name: ends.select(*FILE, F.col("label").alias(label), F.col("element").alias(name))
    return arcs.join(end("from", "parent"), [*FILE, "from"]).join(end("to", "child"), [*FILE, "to"]).select("year", "parent", "child", "weight").distinct()


def element_labels(documents: DataFrame, role: str = LABEL_ROLE, prefix: str = "us-gaap") -> DataFrame:
    """(year, element, label): texts of one role, through locators and arcs inside each link; of several the last."""
    links = _parsed(documents, LABELS, "labelLink")
    link = [*FILE, "no"]
    texts = links.select(*link, F.explode("x.label").alias("t")).where(F.col("t._role") == role).select(*link, F.col("t._label").alias("to"), F.trim(F.coalesce("t._VALUE", F.lit(""))).alias("label"))
    arcs = links.select(*link, F.posexplode("x.labelArc").alias("at", "a")).select(*link, "at", F.col("a._from").alias("from"), F.col("a._to").alias("to"))
    ends = _located(links, link, prefix).withColumnRenamed("label", "from")
    named = arcs.join(ends, [*link, "from"]).join(texts, [*link, "to"])
    return first_per_group(named, ["year", "element"], [F.col("path").desc(), F.col("no").desc(), F.col("at").desc(), F.col("label").desc()]).select("year", "element", "label")


def elements(documents: DataFrame) -> DataFrame:
    """(year, name, period_type, balance, data_type, abstract) of the elements that schemas declare; of several the last."""
    text = lambda c, default="": F.coalesce(F.col(f"x.{c}"), F.lit(default))
    rows = _parsed(documents, SCHEMA, "element").where("x._name <> ''")
    declared = rows.select("year", "path", "no", F.col("x._name").alias("name"), text("_periodType").alias("period_type"), text("_balance").alias("balance"), text("_type").alias("data_type"), (text("_abstract", "false") == "true").alias("abstract"))
    return first_per_group(declared, ["year", "name"], [F.col("path").desc(), F.col("no").desc()]).drop("path", "no")


def year_spans(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, first_year, last_year, runs, years): when something was in force; ``runs`` unbroken runs, written 2009-2012 2015."""
    runs = islands(rows, keys, "year")
    text = F.concat(F.col("first").cast("string"), F.when(F.col("last") > F.col("first"), F.concat(F.lit("-"), F.col("last").cast("string"))).otherwise(""))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", text.alias("text")))), lambda x: x["text"]), " ")
    return runs.groupBy(*keys).agg(F.min("first").alias("first_year"), F.max("last").alias("last_year"), F.count("*").alias("runs"), listed.alias("years"))
