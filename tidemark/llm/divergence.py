"""How far the sources of a language are apart: smoothed term shares compared pair by pair.

Tasks count the terms of their texts by (language, source) and merge them before anything is shuffled.  A language keeps the
terms that occur in enough of its documents.  Each kept term becomes one wide row: its counts pivoted into an array with a
place for every source of the language.  JVM higher-order functions turn that array into shares per billion and those into
one contribution for every pair of sources; a pair's contributions are summed on the map side, so that only a row a pair and
task is shuffled.  What a term contributes to two sources that both lack it is the same for all such terms and is added once a
pair, by their number.

All arithmetic is on whole numbers: with n occurrences among N of a group and V kept terms the share is
p = 1 + floor(10^9 (n + 2) / (N + 2 V)), and two shares diverge by floor((p - q)^2 / (p + q)).
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, slices, table, utf8

#: A share is so many parts at most; smoothing adds this to every count.
PARTS, EXTRA = 1_000_000_000, 2
#: (language, source, term) entries that a task holds before it hands them on; bytes of a text that are read at a time.
HELD, PIECE = 400_000, 1 << 20
#: Pieces into which a language's terms are dealt, so that a language with most of the terms is not one task's work.
DEALT = 64
#: Bytes of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` in UTF-8, after A-Z are lower-cased.
TERM, GAP = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")


def pieces(body: bytes):
    """The terms of a text, in lists; long texts are cut where no term is."""
    begin = 0
    while begin < len(body):
        end = len(body)
        if end > begin + PIECE:
            gap = GAP.search(body, begin + PIECE)
            end = gap.start() if gap else end
        yield TERM.findall(body, begin, end)
        begin = end


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, one row at most for each group and term."""

    def count(batches):
        import pyarrow as pa

        held: dict = {}  # (lang, source) -> occurrences and documents of its terms
        entries = 0

        def out():
            for (group_lang, group), (n, seen) in held.items():
                terms = list(n)
                column = lambda x: pa.array([x.decode()] * len(terms), pa.string())  # noqa: B023, E731
                figures = [pa.array(list(n.values()), pa.int64()), pa.array([seen[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays([column(group_lang), column(group), pa.array(terms, pa.binary()).cast(pa.string()), *figures], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for b in slices(batches, 200):
            for group_lang, group, body in zip(*[utf8(c) for c in b.columns]):
                n, seen = held.setdefault((group_lang, group), (Counter(), Counter()))
                own, before = set(), len(n)
                for found in pieces(body.lower()):  # bytes: only A-Z change
                    n.update(found)
                    own.update(found)
                seen.update(own)
                entries += len(n) - before
                if entries > HELD:
                    yield from out()
                    entries = 0
        yield from out()

    told = docs.select(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    partial = told.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(PARTS (n + EXTRA) / (total + EXTRA terms)); decimals where the product would leave 64 bits."""
    div, whole = (lambda a, b: F.call_function("div", a, b)), total + EXTRA * terms
    exact = div((n + EXTRA).cast("decimal(20,0)") * F.lit(PARTS).cast("decimal(10,0)"), whole.cast("decimal(20,0)"))
    return 1 + F.when(n < 9_000_000_000, div((n + EXTRA) * PARTS, whole)).otherwise(exact)


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _sources(docs: DataFrame, kept: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, at, total, terms, base): every occurring group with its place, its count and its share of an absent term."""
    groups = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    totals = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    out = groups.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["total", "terms"])
    return out.withColumns({"at": place, "base": F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))})


def _wide(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, term, q, cells): per place of a source its name, count n and share p of the term; q is the language's share."""
    whole = groups.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("at", "source", "total", "base"))).alias("g"), F.sum("total").alias("all"), F.first("terms").alias("terms")
    )
    # a language with most terms is dealt over several tasks: its one row of groups is copied for each of them
    right = whole.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    left = kept.withColumn("piece", F.pmod(F.xxhash64("term"), F.lit(DEALT)).cast("int"))
    joined = left.join(right, ["lang", "piece"])
    # places are in the order of the sources' bytes: counts and zeros for the others, sorted, stand at their places
    absent = F.array_except(F.col("g.source"), F.col("counts.source"))
    pivoted = F.sort_array(F.concat("counts", F.transform(absent, lambda s: F.struct(s.alias("source"), F.lit(0).cast("long").alias("n")))))
    counted = joined.select("lang", "term", "g", "all", "terms", pivoted.alias("counts"))

    def cell(c: Column, g: Column) -> Column:
        p = F.when(c["n"] == 0, g["base"]).otherwise(share(c["n"], g["total"], F.col("terms")))
        return F.struct(c["source"].alias("source"), c["n"].alias("n"), p.alias("p"))

    every = F.aggregate(F.col("counts.n"), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return counted.select("lang", "term", share(every, F.col("all"), F.col("terms")).alias("q"), F.zip_with("counts", "g", cell).alias("cells"))


def _pairs(wide: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of a language's sources."""

    # contributions of a term to the pairs (i, j), j > i, in order; null where neither source has the term
    def row(x: Column, i: Column) -> Column:
        return F.transform(F.slice("cells", i + 2, F.size("cells")), lambda y: F.when((x["n"] > 0) | (y["n"] > 0), apart(x["p"], y["p"])))

    told = wide.select("lang", F.posexplode(F.flatten(F.transform("cells", row))).alias("pair", "f"))
    sums = told.where("f IS NOT NULL").groupBy("lang", "pair").agg(F.sum("f").alias("f"), F.count("f").alias("told"))
    size = groups.groupBy("lang").agg(F.count("*").alias("size"))
    a, b = (groups.select("lang", F.col("at").alias(f"at{x}"), F.col("source").alias(f"source{x}"), F.col("base").alias(f"base{x}"), *(["terms"] if x == "a" else [])) for x in "ab")
    # one row a pair of sources of a language: the answer's own size
    both = a.join(b, "lang").where("ata < atb").join(size, "lang")
    i, j, m = F.col("ata"), F.col("atb"), F.col("size")
    pair = (i * m - F.floor(i * (i + 1) / 2) + (j - i - 1)).cast("int")
    summed = both.withColumn("pair", pair).join(sums, ["lang", "pair"], "left")
    none = F.lit(0).cast("long")
    absent = (F.col("terms") - F.coalesce("told", none)) * apart(F.col("basea"), F.col("baseb"))
    value = F.coalesce("f", none) + F.coalesce(absent, none)
    one = summed.select("lang", "sourcea", "sourceb", value.alias("value"))
    names = ["lang", "source", "item", "value"]
    return one.toDF(*names).union(one.select("lang", "sourceb", "sourcea", "value").toDF(*names))


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): the sources of a language by their divergence, and the terms a source overuses.

    Part ``pair`` ranks every other source of the language, part ``term`` the ``top`` terms with the largest contribution
    among those that the source uses more than its language; ties go by the bytes of the item.  Null text, language and source are
    empty.  A group without terms has counts of 0 and stays; where a language keeps no term, all pairs are 0 apart; a
    language with one source has no pairs.  Repeated rows count as often as they occur; an empty table gives no rows.
    Other columns are not read.
    """
    counts = term_counts(docs, text, lang, source)
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts")).where(F.col("docs") >= least_docs)
    kept = materialise(kept.select("lang", "term", "counts"), "kept_terms")
    groups = materialise(_sources(docs, kept, lang, source), "groups")
    wide = materialise(_wide(kept, groups), "wide_terms")
    used = wide.select("lang", "term", "q", F.explode("cells").alias("c")).where("c.n > 0 and c.p > q")
    terms = used.select("lang", F.col("c.source").alias("source"), F.col("term").alias("item"), apart(F.col("c.p"), F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    best = terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    pairs = _pairs(wide, groups).withColumn("rank", F.row_number().over(by))
    shown = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return shown(pairs, "pair").union(shown(best, "term"))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Divergence of all sources of the documents, by language."""
    return source_divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), tokens AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM tokens GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p FROM cells JOIN v USING (lang)
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM cells GROUP BY lang, term) JOIN v USING (lang)
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS f
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), parts AS (
  SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term', * FROM terms
)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 10
"""
