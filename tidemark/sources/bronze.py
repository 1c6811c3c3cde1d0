"""Raw layer: header-verified delimited text, quarters that load once, replacement and a load log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import parse_quarter
from tidemark.sources.tables import Tables

# Columns of the four published tables, in file order.
COLUMNS = {
    "sub": """adsh cik name sic countryba stprba cityba zipba bas1 bas2 baph countryma stprma cityma zipma mas1 mas2
        countryinc stprinc ein former changed afs wksi fye form period fy fp filed accepted prevrpt detail instance nciks
        aciks""".split(),
    "tag": "tag version custom abstract datatype iord crdr tlabel doc".split(),
    "num": "adsh tag version ddate qtrs uom segments coreg value footnote".split(),
    "pre": "adsh report line stmt inpth rfile tag version plabel negating".split(),
}


def text_schema(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_delimited(spark: SparkSession, path: str, columns, sep: str = "\t", encoding: str = "ISO-8859-1", quote: str = '"') -> DataFrame:
    """All columns as text; a header that is not exactly ``columns`` raises."""
    head = spark.read.option("encoding", encoding).csv(path, sep=sep, header=False, quote=quote).limit(1).collect()
    found = [x for x in head[0]] if head else []
    if found != list(columns):
        raise ValueError(f"{path}: header {found} is not {list(columns)}")
    return spark.read.csv(path, schema=text_schema(columns), sep=sep, header=True, encoding=encoding, quote=quote, nullValue="", mode="FAILFAST", enforceSchema=False)


LOG = "source_quarter string, table_name string, n_rows long"


def load_log(spark: SparkSession, root: str) -> DataFrame:
    tables = Tables(spark, root)
    return tables.read("load_log") if tables.exists("load_log") else spark.createDataFrame([], LOG)


def load_quarter(spark: SparkSession, root: str, quarter: str, files: dict[str, str], force: bool = False) -> dict[str, int]:
    """Load one quarter's files ({table: path}) into tables by quarter below ``root``; rows per table.

    A quarter that the log has is refused unless ``force``, which replaces exactly that quarter.  Each table changes at
    once, the log after all of them: a load that dies is not in the log, and loading the quarter again makes it whole.
    """
    parse_quarter(quarter)
    if not force and load_log(spark, root).where(F.col("source_quarter") == quarter).limit(1).count():
        raise ValueError(f"quarter {quarter} is loaded already")
    tables, counts = Tables(spark, root), {}
    for name, path in files.items():
        rows = read_delimited(spark, path, COLUMNS[name]).withColumn("source_quarter", F.lit(quarter))
        loaded = tables.replace_parts(f"{name}_raw", rows, "source_quarter", drop=[quarter])
        counts[name] = tables.read(f"{name}_raw", loaded).count()
    new = spark.createDataFrame([(quarter, n, c) for n, c in counts.items()], LOG)
    tables.upsert("load_log", new, ["source_quarter", "table_name"], "source_quarter")
    return counts


def load_all(spark: SparkSession, root: str, quarters: dict[str, dict[str, str]], incremental: bool = True) -> list[str]:
    """Load quarters in order, skipping those loaded already; without ``incremental`` nothing may be loaded yet."""
    done = {r["source_quarter"] for r in load_log(spark, root).select("source_quarter").distinct().collect()}
    if done and not incremental:
        raise ValueError("tables hold quarters already; truncate first")
    todo = [q for q in sorted(quarters, key=parse_quarter) if q not in done]
    for q in todo:
        load_quarter(spark, root, q, quarters[q])
    return todo


def truncate(spark: SparkSession, root: str) -> None:
    """Remove every raw table and the log, the log first, so that no quarter counts as loaded without its rows."""
    tables = Tables(spark, root)
    for name in ["load_log", *(f"{n}_raw" for n in COLUMNS)]:
        tables.drop(name)


def raw_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    tables = Tables(spark, root)
    return tables.read(f"{name}_raw") if tables.exists(f"{name}_raw") else spark.createDataFrame([], text_schema([*COLUMNS[name], "source_quarter"]))


def write_table(df: DataFrame, path: str, form: str = "parquet", partition_by=()) -> None:
    """Parquet or CSV export for other programs; files appear when the job commits.  Tables of the engine are ``Tables``."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path, header=True) if form == "csv" else writer.parquet(path)
