"""More bindings of the engine's operators to the driver tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import rel, temporal
from tidemark.plans import concepts, cross, exports, gold, items, spine
from tidemark.plans.concept_config import ConceptConfig
from tidemark.sources import markup, taxonomy

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- peer statistics by fiscal year --------------------------------------------------------------------------------------

PANEL_CONFIG = ConceptConfig(
    concepts=[
        ("revenue", "flow", True), ("net_income", "flow", True), ("cost", "flow", False), ("gross_profit", "flow", True), ("total_assets", "balance", True),
        ("total_equity", "balance", True), ("debt_noncurrent", "balance", False), ("debt_current", "balance", False), ("total_debt", "balance", True),
        ("margin", "ratio", True), ("roe", "ratio", True), ("revenue_growth", "growth", True),
    ],
    tags=[
        ("revenue", "F1", 1, 1, ""), ("revenue", "F2", 2, 1, ""), ("revenue", "F3", 3, 1, "7"), ("net_income", "F4", 1, 1, ""), ("cost", "F5", 1, 1, ""), ("total_assets", "B1", 1, 1, ""),
        ("total_assets", "B2", 2, 1, ""), ("total_equity", "B3", 1, 1, ""), ("debt_noncurrent", "B4", 1, 1, ""), ("debt_current", "B5", 1, -1, ""),
    ],
    formulas=[
        ("gross_profit", 1, [], None, None, [("revenue", 1, True), ("cost", -1, True)]),
        ("total_debt", 1, ["1", "2"], None, None, [("debt_noncurrent", 1, True), ("debt_current", 1, True)]),
        ("total_debt", 2, [], None, None, [("debt_noncurrent", 1, True), ("debt_current", -1, False)]),
    ],
    ratios=[("margin", "net_income", "revenue"), ("roe", "net_income", "total_equity")],
    growths=[("revenue_growth", "revenue")],
)

PANEL_SQL = """WITH o AS (SELECT o_custkey AS cik, substr(o_orderpriority, 1, 1) AS p, o_totalprice AS v,
  CASE WHEN o_custkey % 3 > 0 THEN make_date(year(o_orderdate), 12, 31) WHEN month(o_orderdate) = 1 THEN make_date(year(o_orderdate), 1, 31) ELSE make_date(year(o_orderdate) + 1, 1, 31) END AS ye FROM orders),
f AS (SELECT cik, 'F' || p AS tag, 4 AS qtrs, ye AS d, sum(v) AS v FROM o GROUP BY ALL
  UNION ALL SELECT cik, 'B' || p, 0, ye, max(v) FROM o GROUP BY ALL
  UNION ALL SELECT cik, 'B' || p, 0, last_day(CAST(ye + INTERVAL 3 MONTH AS DATE)), 2 * max(v) FROM o GROUP BY cik, p, ye),
m(concept, tag, pr, sg, px) AS (VALUES ('revenue', 'F1', 1, 1, ''), ('revenue', 'F2', 2, 1, ''), ('revenue', 'F3', 3, 1, '7'), ('net_income', 'F4', 1, 1, ''), ('cost', 'F5', 1, 1, ''),
  ('total_assets', 'B1', 1, 1, ''), ('total_assets', 'B2', 2, 1, ''), ('total_equity', 'B3', 1, 1, ''), ('debt_noncurrent', 'B4', 1, 1, ''), ('debt_current', 'B5', 1, -1, '')),
pick AS (SELECT cik, concept, CASE WHEN month(d) <= 5 THEN year(d) - 1 ELSE year(d) END AS fy, d, v * sg AS v, cik % 100 AS sic FROM f JOIN m USING (tag)
  WHERE (px = '' OR starts_with(CAST(cik % 100 AS VARCHAR), px)) AND (qtrs = 4 OR (cik, d) IN (SELECT (cik, d) FROM f WHERE qtrs = 4)) AND d >= DATE '1996-01-01' AND d <= DATE '2001-06-30'
  QUALIFY row_number() OVER (PARTITION BY cik, concept, fy ORDER BY px <> '' DESC, pr, d DESC, tag, v DESC) = 1),
c AS (SELECT c_custkey AS cik, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS sector, CAST(c_nationkey AS VARCHAR) AS sub FROM customer),
mem AS (SELECT *, 'A' AS ix, DATE '1995-06-30' AS a, DATE '1998-06-30' AS b FROM c WHERE cik % 2 = 1 UNION ALL SELECT *, 'B', DATE '1998-06-30', NULL FROM c WHERE cik % 2 = 1 UNION ALL SELECT *, 'B', DATE '1996-12-31', NULL FROM c WHERE cik % 2 = 0),
dir AS (SELECT pick.*, ix, sector, sub FROM pick JOIN mem ON mem.cik = pick.cik AND a <= d AND (b IS NULL OR b > d)),
wide AS (SELECT cik, fy, max(ix) AS ix, max(sector) AS sector, max(sub) AS sub, max(sic) AS sic, max(v) FILTER (concept = 'revenue') AS rev, max(d) FILTER (concept = 'revenue') AS revd, max(v) FILTER (concept = 'cost') AS cost, max(d) FILTER (concept = 'cost') AS costd,
  max(v) FILTER (concept = 'debt_noncurrent') AS dn, max(d) FILTER (concept = 'debt_noncurrent') AS dnd, max(v) FILTER (concept = 'debt_current') AS dc, max(d) FILTER (concept = 'debt_current') AS dcd,
  max(d) FILTER (concept = 'total_assets') AS ad FROM dir GROUP BY cik, fy),
val AS (SELECT cik, fy, ix, sector, sub, concept, d, v FROM dir WHERE concept NOT IN ('cost', 'debt_noncurrent', 'debt_current')
  UNION ALL SELECT cik, fy, ix, sector, sub, 'gross_profit', greatest(revd, costd), rev - cost FROM wide WHERE rev IS NOT NULL AND cost IS NOT NULL
  UNION ALL SELECT cik, fy, ix, sector, sub, 'total_debt', greatest(dnd, dcd), CASE WHEN left(CAST(sic AS VARCHAR), 1) IN ('1', '2') AND dc IS NOT NULL THEN dn + dc ELSE dn - coalesce(dc, 0) END FROM wide WHERE dn IS NOT NULL
  UNION ALL SELECT cik, fy, ix, sector, sub, 'total_debt', ad, 0 FROM wide WHERE dn IS NULL AND ad IS NOT NULL AND cik % 11 = 0),
al AS (SELECT * FROM val
  UNION ALL SELECT n.cik, n.fy, n.ix, n.sector, n.sub, r.ratio, n.d, n.v / b.v FROM val n JOIN (VALUES ('margin', 'net_income', 'revenue'), ('roe', 'net_income', 'total_equity')) r(ratio, num, den) ON r.num = n.concept JOIN val b ON b.cik = n.cik AND b.fy = n.fy AND b.concept = r.den AND b.v > 0
  UNION ALL SELECT n.cik, n.fy, n.ix, n.sector, n.sub, 'revenue_growth', n.d, (n.v - b.v) / b.v FROM val n JOIN val b ON b.cik = n.cik AND b.fy = n.fy - 1 AND b.concept = 'revenue' AND b.v > 0 AND date_diff('day', b.d, n.d) BETWEEN 300 AND 430 WHERE n.concept = 'revenue'),
lev AS (SELECT *, 'sector' AS peer_level, sector AS peer_group FROM al WHERE sector IS NOT NULL UNION ALL SELECT *, 'sub_industry', sub FROM al WHERE sub IS NOT NULL),
mom AS (SELECT concept, fy, peer_level, peer_group, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd, min(v) AS mn, max(v) AS mx FROM lev GROUP BY ALL HAVING count(*) >= 5)
SELECT cik, ix AS index_name, concept, fy AS fiscal_year, peer_level, peer_group, d AS value_date, round(v, 4) AS value, n AS peer_count, round(mean * n, 2) AS peer_total, round(sd, 3) AS peer_stddev, round(mn, 4) AS peer_min, round(mx, 4) AS peer_max,
round(CASE WHEN sd <> 0 THEN (v - mean) / sd END, 4) AS zscore, round(percent_rank() OVER (PARTITION BY concept, fy, peer_level, peer_group ORDER BY v), 4) AS peer_percentile FROM lev JOIN mom USING (concept, fy, peer_level, peer_group)"""


def panel_facts(spark, d):
    """Customers as companies: yearly sums of orders as flows, largest orders as balances, at the year-end and a quarter on.

    Every third customer's year ends in January.
    """
    day, cik = F.col("o_orderdate").cast("date"), F.col("o_custkey")
    january = F.make_date(F.year(day) + F.when(F.month(day) == 1, 0).otherwise(1), F.lit(1), F.lit(31))
    end = F.when(cik % 3 > 0, F.make_date(F.year(day), F.lit(12), F.lit(31))).otherwise(january)
    o = t(spark, d, "orders").groupBy(cik.alias("cik"), F.substring("o_orderpriority", 1, 1).alias("p"), end.alias("value_date")).agg(F.sum("o_totalprice").alias("total"), F.max("o_totalprice").alias("most"))
    later = F.last_day(F.add_months("value_date", 3))
    fact = lambda kind, q, at, v: F.struct(F.concat(F.lit(kind), "p").alias("tag"), F.lit(q).alias("qtrs"), at.alias("at"), v.alias("value"))
    each = F.explode(F.array(fact("F", 4, F.col("value_date"), F.col("total")), fact("B", 0, F.col("value_date"), F.col("most")), fact("B", 0, later, 2 * F.col("most")))).alias("f")
    rows = o.select("cik", each).select("cik", "f.tag", "f.qtrs", F.col("f.at").alias("value_date"), "f.value")
    return rows.withColumns({"ticker": F.col("cik").cast("string"), "sic": (F.col("cik") % 100).cast("int"), "uom": F.lit("USD"), "tradable_from": F.date_add("value_date", 45)})


def panel_members(spark, d):
    """Odd customers change index in the middle of 1998, even ones join at the end of 1996; every tenth has no sector."""
    sector = F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment"))
    span = lambda index, a, b: F.struct(F.lit(index).alias("index_name"), F.lit(a).cast("date").alias("valid_from"), F.lit(b).cast("date").alias("valid_to"))
    odd = F.array(span("A", "1995-06-30", "1998-06-30"), span("B", "1998-06-30", None))
    spans = F.explode(F.when(F.col("c_custkey") % 2 == 1, odd).otherwise(F.array(span("B", "1996-12-31", None)))).alias("s")
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("cik"), sector.alias("gics_sector"), F.col("c_nationkey").cast("string").alias("gics_sub_industry"), spans)
    return c.select("cik", "gics_sector", "gics_sub_industry", "s.*")


@query(PANEL_SQL)
def peer_panel(spark, d):
    """Peer statistics by fiscal year with formulas, zero debts, ratios and growths; means as totals, which round without ties."""
    facts = panel_facts(spark, d)
    ends = facts.where("qtrs = 4").select("cik", F.col("value_date").alias("period_date")).distinct()
    faces = ends.withColumns({"zero_by_face": F.col("cik") % 11 == 0, "form": F.lit("10-K"), "filed_date": F.date_add("period_date", 45), "tradable_from": F.date_add("period_date", 45)})
    out = cross.peer_panel(facts, panel_members(spark, d), PANEL_CONFIG, faces=faces, since="1996-01-01", until="2001-06-30")
    cut = lambda c, n: F.round(c, n).alias(c)
    return out.select(
        "cik", "index_name", "concept", "fiscal_year", "peer_level", "peer_group", "value_date", cut("value", 4), "peer_count", F.round(F.col("peer_mean") * F.col("peer_count"), 2).alias("peer_total"), cut("peer_stddev", 3),
        cut("peer_min", 4), cut("peer_max", 4), "zscore", "peer_percentile",
    )


# --- states and panels ---------------------------------------------------------------------------------------------------

PANEL_ITEMS = """item,period,rule,variant,priority,term,coefficient,required,notes
sale,duration,tag,,1,1-URGENT,1,,
sale,duration,tag,,2,2-HIGH,1,,
cost,duration,tag,,1,3-MEDIUM,1,,
gain,duration,formula,1,,item:sale,1,TRUE,
gain,duration,formula,1,,item:cost,-1,FALSE,
gain,duration,formula,2,,tag:4-NOT SPECIFIED,1,TRUE,
"""


@query("""WITH o AS (SELECT o_custkey AS cik, CASE WHEN month(o_orderdate) <= 6 THEN make_date(year(o_orderdate), 6, 30) ELSE make_date(year(o_orderdate), 12, 31) END AS vd,
  CAST(o_orderdate AS DATE) AS d, o_orderpriority AS tag, max(o_totalprice) AS v FROM orders GROUP BY ALL),
x AS (SELECT cik, vd, d, tag, v, CASE WHEN cik % 7 = 0 THEN least(coalesce(nx, d + 20), d + 20) ELSE nx END AS n FROM (SELECT *, lead(d) OVER (PARTITION BY cik, vd, tag ORDER BY d) AS nx FROM o)),
days AS (SELECT DISTINCT cik, vd, d AS s FROM o WHERE tag <> '5-LOW'),
w AS (SELECT days.cik, days.vd, s, max(v) FILTER (tag = '1-URGENT') AS u, max(v) FILTER (tag = '2-HIGH') AS h, max(v) FILTER (tag = '3-MEDIUM') AS m, max(v) FILTER (tag = '4-NOT SPECIFIED') AS z
  FROM days JOIN x ON x.cik = days.cik AND x.vd = days.vd AND x.d <= s AND (x.n > s OR x.n IS NULL) AND x.tag <> '5-LOW' GROUP BY ALL),
i AS (SELECT cik, vd, s, coalesce(u, h) / 1e3 AS sale, m / 1e3 AS cost, CASE WHEN coalesce(u, h) IS NOT NULL THEN coalesce(u, h) - coalesce(m, 0) ELSE z END / 1e3 AS gain FROM w),
p AS (SELECT * FROM i QUALIFY vd = max(vd) OVER (PARTITION BY cik, year(vd)))
SELECT cik, vd AS value_date, year(vd) AS fyear, s AS state_from, round(sale, 5) AS sale, round(cost, 5) AS cost, round(gain, 5) AS gain FROM p
WINDOW w AS (PARTITION BY cik, vd ORDER BY s)
QUALIFY row_number() OVER w = 1 OR sale IS DISTINCT FROM lag(sale) OVER w OR cost IS DISTINCT FROM lag(cost) OVER w OR gain IS DISTINCT FROM lag(gain) OVER w""")
def annual_panel(spark, d):
    """Half-yearly periods of customers, their orders' priorities as tags; facts of every seventh customer lapse after 20 days."""
    day = F.col("o_orderdate").cast("date")
    period = F.when(F.month(day) <= 6, F.make_date(F.year(day), F.lit(6), F.lit(30))).otherwise(F.make_date(F.year(day), F.lit(12), F.lit(31)))
    orders = t(spark, d, "orders")
    parts = rel.parts_for(orders)
    o = orders.repartition(parts, "o_custkey").groupBy(F.col("o_custkey").alias("cik"), period.alias("value_date"), day.alias("tradable_from"), F.col("o_orderpriority").alias("tag")).agg(F.max("o_totalprice").alias("value"))
    ahead, lapse = F.lead("tradable_from").over(Window.partitionBy("cik", "value_date", "tag").orderBy("tradable_from")), F.date_add("tradable_from", 20)
    o = o.withColumns({"superseded_tradable": F.when(F.col("cik") % 7 == 0, F.least(ahead, lapse)).otherwise(ahead), "adsh": F.lit("")})
    out = exports.annual_panel(o, items.parse_items(PANEL_ITEMS), scale=1e3, parts=parts)
    return out.select("cik", "value_date", F.col("fyear").cast("long").alias("fyear"), "state_from", *[F.round(c, 5).alias(c) for c in ("sale", "cost", "gain")])


# --- runs of sightings ---------------------------------------------------------------------------------------------------


@query("""WITH s0 AS (SELECT 'T' || (o_custkey % 300) AS ticker, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, arg_min(o_custkey, o_orderkey) AS c, min(o_orderkey) AS k FROM orders GROUP BY ALL),
cap AS (SELECT d, month(d) = 7 AS part, row_number() OVER (ORDER BY d) AS sn FROM (SELECT DISTINCT d FROM s0)),
s AS (SELECT s0.*, sn, sn - row_number() OVER (PARTITION BY ticker ORDER BY sn) AS rk, CASE WHEN k % 4 = 0 THEN c END AS page FROM s0 JOIN cap USING (d)),
run AS (SELECT ticker, rk, min(sn) AS a, max(sn) AS b, min(d) AS f, max(d) AS l FROM s GROUP BY ALL),
co AS (SELECT c_custkey AS cik, DATE '1990-01-01' + CAST(c_custkey * 37 % 3000 AS INTEGER) AS ff FROM customer WHERE c_custkey % 13 <> 0),
xw AS (SELECT ticker, rk, min(c_custkey) AS x FROM run JOIN customer ON 'T' || (c_custkey % 300) = ticker AND c_custkey % 7 = 0 WHERE l >= DATE '1997-01-01' AND l < DATE '1999-01-01' GROUP BY ALL),
pg AS (SELECT ticker, rk, page AS p, count(*) AS n FROM s JOIN co ON co.cik = page GROUP BY ALL),
pick AS (SELECT ticker, rk, p FROM pg LEFT JOIN xw USING (ticker, rk) QUALIFY row_number() OVER (PARTITION BY ticker, rk ORDER BY (p = x) DESC NULLS LAST, n DESC, p) = 1),
r1 AS (SELECT run.*, CASE WHEN p IS NOT NULL AND (x IS NULL OR p = x) THEN p ELSE x END AS cik, CASE WHEN p IS NOT NULL AND (x IS NULL OR p = x) THEN 'page' WHEN x IS NOT NULL THEN 'crosswalk' END AS src FROM run LEFT JOIN xw USING (ticker, rk) LEFT JOIN pick USING (ticker, rk)),
nm AS (SELECT c_custkey AS cik, 'customer' || (c_custkey % 300) AS n, CASE WHEN c_custkey % 2 = 1 THEN coalesce(ff, DATE '1900-01-01') ELSE DATE '1995-06-01' + CAST(c_custkey % 900 AS INTEGER) END AS vf, CASE WHEN c_custkey % 2 = 0 THEN DATE '1995-06-01' + CAST(c_custkey % 900 AS INTEGER) + 1500 END AS vt FROM customer LEFT JOIN co ON co.cik = c_custkey),
cand AS (SELECT r1.ticker, r1.rk, nm.cik, bool_or(vf - 200 <= f AND (vt IS NULL OR vt + 200 >= f)) AS st FROM r1 JOIN (SELECT DISTINCT ticker, rk, 'customer' || (c % 300) AS n FROM s WHERE c % 5 > 1) t ON t.ticker = r1.ticker AND t.rk = r1.rk JOIN nm ON nm.n = t.n JOIN co ON co.cik = nm.cik
  WHERE r1.cik IS NULL AND vf - 200 <= l AND (vt IS NULL OR vt + 200 >= f) AND ff - 200 <= l AND ff + 2700 >= f GROUP BY ALL),
nc AS (SELECT ticker, rk, CASE WHEN count(*) FILTER (st) = 1 THEN min(cik) FILTER (st) WHEN count(*) FILTER (st) = 0 AND count(*) = 1 THEN min(cik) END AS nk FROM cand GROUP BY ALL),
ov AS (SELECT ticker, f, ok FROM (SELECT ticker, min(d) AS f, CAST(substr(ticker, 2) AS BIGINT) AS ok FROM s0 GROUP BY ticker) JOIN co ON co.cik = ok WHERE ok % 10 = 3),
r2 AS (SELECT r1.ticker, a, b, r1.f, l, coalesce(cik, nk, ok) AS cik, CASE WHEN cik IS NOT NULL THEN src WHEN nk IS NOT NULL THEN 'name' WHEN ok IS NOT NULL THEN 'override' END AS src FROM r1 LEFT JOIN nc USING (ticker, rk) LEFT JOIN ov ON ov.ticker = r1.ticker AND ov.f = r1.f),
w AS (SELECT sn, sum(CASE WHEN part THEN 0 ELSE 1 END) OVER (ORDER BY sn) AS wh, CASE WHEN part THEN 0 ELSE 1 END AS self FROM cap),
z AS (SELECT r2.*, CASE WHEN wa.wh - wa.self - lag(wb.wh) OVER t = 0 THEN lag(cik) OVER t END AS p, CASE WHEN lead(wa.wh) OVER t - lead(wa.self) OVER t - wb.wh = 0 THEN lead(cik) OVER t END AS n FROM r2 JOIN w wa ON wa.sn = a JOIN w wb ON wb.sn = b WINDOW t AS (PARTITION BY ticker ORDER BY a)),
y AS (SELECT *, CASE WHEN p IS NULL OR n IS NULL OR p = n THEN coalesce(p, n) END AS near FROM z)
SELECT ticker, a AS first_sn, b AS last_sn, f AS first_seen, l AS last_seen, coalesce(cik, near) AS cik, CASE WHEN cik IS NOT NULL THEN src WHEN near IS NOT NULL THEN 'bridged' END AS cik_source FROM y""")
def run_resolution(spark, d):
    """Months in which any of the customers that share a ticker ordered, as sightings of it; Julys are partial captures."""
    key, ticker = F.col("o_custkey"), lambda c: F.concat(F.lit("T"), (c % 300).cast("string"))
    o = t(spark, d, "orders").groupBy(ticker(key).alias("ticker"), F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("observed_on")).agg(F.min_by("o_custkey", "o_orderkey").alias("c"), F.min("o_orderkey").alias("k"))
    name = F.when(F.col("c") % 5 == 0, "The Inc").when(F.col("c") % 5 == 1, "").otherwise(F.concat(F.lit("Customer "), (F.col("c") % 300).cast("string"), F.lit(" Inc")))
    seen = o.select(F.lit("A").alias("index_name"), "ticker", "observed_on", F.when(F.col("k") % 4 == 0, F.col("c")).alias("cik"), name.alias("name"))
    captures = o.select(F.lit("A").alias("index_name"), "observed_on", (F.month("observed_on") == 7).alias("is_partial")).distinct()
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("cik"))
    date = lambda x: F.lit(x).cast("date")
    held = c.where("cik % 7 = 0").select("cik", ticker(F.col("cik")).alias("ticker"), F.lit(True).alias("is_primary"), date("1997-01-01").alias("valid_from"), date("1999-01-01").alias("valid_to"))
    first = F.date_add(date("1990-01-01"), (F.col("cik") * 37 % 3000).cast("int"))
    companies = c.where("cik % 13 <> 0").select("cik", first.alias("first_filed"), F.date_add(first, 2500).alias("last_filed"))
    start = F.when(F.col("cik") % 2 == 0, F.date_add(date("1995-06-01"), (F.col("cik") % 900).cast("int")))
    names = c.select("cik", F.concat(F.lit("CUSTOMER "), (F.col("cik") % 300).cast("string"), F.lit(" Corp")).alias("name"), start.alias("valid_from"), F.date_add(start, 1500).alias("valid_to"))
    overrides = o.groupBy("ticker").agg(F.min("observed_on").alias("first_seen")).select(F.lit("A").alias("index_name"), "ticker", "first_seen", F.substring("ticker", 2, 9).cast("long").alias("cik")).where("cik % 10 = 3")
    out = spine.resolve_runs(seen, held, companies, names, overrides, captures)
    return out.select("ticker", "first_sn", "last_sn", "first_seen", "last_seen", "cik", "cik_source")


# --- taxonomies ----------------------------------------------------------------------------------------------------------


def linkbases(spark, d):
    """A calculation linkbase per supplier group and year, over the part groups that it shipped."""
    group = lambda c, n, p: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    edges = t(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year"), group("l_suppkey", 50, "S").alias("parent"), group("l_partkey", 200, "P").alias("child")).agg((F.min("l_linenumber") % 2).alias("odd"))
    part = F.substring("child", 2, 9).cast("int")
    loc = lambda prefix, name: F.concat(F.lit('<link:loc xlink:type="locator" xlink:href="t.xsd#'), prefix, F.lit("_"), name, F.lit('" xlink:label="loc_'), name, F.lit('"/>'))
    here = F.when(part % 17 == 0, F.lit("")).otherwise(loc(F.when(part % 19 == 0, "other").otherwise("us-gaap"), F.col("child")))
    arc = F.concat(F.lit('<link:calculationArc xlink:from="loc_'), "parent", F.lit('" xlink:to="loc_'), "child", F.when(F.col("odd") == 1, F.lit('" weight="-1.0"/>')).otherwise(F.lit('"/>')))
    body = F.array_join(F.array_sort(F.collect_list(F.concat(here, arc))), "")
    head = F.lit('<link:linkbase xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink"><link:calculationLink>')
    docs = edges.groupBy("year", "parent").agg(body.alias("body"))
    text = F.concat(head, loc(F.lit("us-gaap"), F.col("parent")), "body", F.lit("</link:calculationLink></link:linkbase>"))
    return docs.select(F.col("year").cast("int").alias("year"), F.concat(F.lit("cal/"), "parent").alias("path"), text.alias("text"))


@query("""WITH e AS (SELECT year(l_shipdate) AS y, l_suppkey % 50 AS s, l_partkey % 200 AS p, min(l_linenumber) % 2 AS odd FROM lineitem GROUP BY ALL),
a AS (SELECT y, 'S' || s AS parent, 'P' || p AS child, CASE WHEN odd = 1 THEN -1.0 ELSE 1.0 END AS weight FROM e WHERE p % 17 <> 0 AND p % 19 <> 0),
r AS (SELECT *, y - row_number() OVER (PARTITION BY parent, child, weight ORDER BY y) AS k FROM a),
i AS (SELECT parent, child, weight, min(y) AS f, max(y) AS l FROM r GROUP BY parent, child, weight, k)
SELECT parent, child, CAST(weight AS DOUBLE) AS weight, CAST(min(f) AS INTEGER) AS first_year, CAST(max(l) AS INTEGER) AS last_year, count(*) AS runs,
  string_agg(CASE WHEN l > f THEN f || '-' || l ELSE CAST(f AS VARCHAR) END, ' ' ORDER BY f) AS years FROM i GROUP BY ALL""")
def taxonomy_spans(spark, d):
    """Years of each calculation arc of generated linkbases; some locators lack, some point elsewhere."""
    return taxonomy.year_spans(taxonomy.calculation_arcs(linkbases(spark, d)), ["parent", "child", "weight"])


# --- audits and share classes ----------------------------------------------------------------------------------------------

AUDIT_CONFIG = ConceptConfig(
    concepts=[("revenue", "flow", True), ("cost", "flow", False), ("gross_profit", "flow", True)],
    tags=[("revenue", "F1", 1, 1, ""), ("cost", "F2", 1, 1, ""), ("gross_profit", "F3", 1, 1, "")],
    formulas=[("gross_profit", 1, [], "^F5$", None, [("revenue", 1, True), ("cost", -1, True)]), ("gross_profit", 2, ["1", "2", "3"], None, None, [("revenue", 1, True), ("cost", -1, False)])],
)


@query("""WITH o AS (SELECT o_custkey AS cik, substr(o_orderpriority, 1, 1) AS p, o_totalprice AS v,
  CASE WHEN o_custkey % 3 > 0 THEN make_date(year(o_orderdate), 12, 31) WHEN month(o_orderdate) = 1 THEN make_date(year(o_orderdate), 1, 31) ELSE make_date(year(o_orderdate) + 1, 1, 31) END AS d FROM orders),
w AS (SELECT cik, d, sum(v) FILTER (p = '1') AS r, sum(v) FILTER (p = '2') AS c, sum(v) FILTER (p = '3') AS g, sum(v) FILTER (p = '5') AS x FROM o GROUP BY ALL),
e AS (SELECT 1 AS variant, x IS NOT NULL AS guarded, abs(r - c - g) / r AS miss FROM w WHERE r IS NOT NULL AND c IS NOT NULL AND g IS NOT NULL
  UNION ALL SELECT 2, FALSE, abs(r - coalesce(c, 0) - g) / r FROM w WHERE r IS NOT NULL AND g IS NOT NULL AND left(CAST(cik % 100 AS VARCHAR), 1) IN ('1', '2', '3'))
SELECT variant, guarded, count(*) AS n, round(avg(CASE WHEN miss <= 0.5 THEN 1.0 ELSE 0.0 END), 4) AS share_within, round(avg(miss), 6) AS mean_miss FROM e GROUP BY ALL""")
def formula_audit(spark, d):
    """What formulas miss where the concept is filed too, guarded periods apart."""
    facts = panel_facts(spark, d).where("qtrs = 4")
    standard = facts.select("tag").distinct().where("tag <> 'F5'")
    guarded = concepts.guarded_periods(facts, AUDIT_CONFIG, standard)
    out = concepts.formula_audit(concepts.resolve_direct(facts, AUDIT_CONFIG), AUDIT_CONFIG, "gross_profit", "revenue", guarded, 0.5)
    return out.withColumn("mean_miss", F.round("mean_miss", 6))


@query("""WITH c AS (SELECT c_custkey AS cik, CASE c_custkey % 4 WHEN 0 THEN 'A' || c_nationkey || 'B' WHEN 1 THEN 'A' || c_nationkey || '-B' ELSE 'C' || c_nationkey END AS symbol FROM customer),
o AS (SELECT o_custkey AS cik, CASE o_orderstatus WHEN 'F' THEN 'A' || c_nationkey || '-B' WHEN 'O' THEN 'C' || c_nationkey ELSE 'Q' || o_orderpriority[1] END AS ticker, CAST(o_orderdate AS DATE) AS f, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) + 400 END AS t FROM orders JOIN customer ON c_custkey = o_custkey),
s AS (SELECT cik, ticker, min(f) AS f, CASE WHEN count(*) FILTER (t IS NULL) = 0 THEN max(t) END AS t, replace(ticker, '-', '') AS line FROM o GROUP BY ALL),
own AS (SELECT c.cik, coalesce(ticker, symbol) AS ticker, f, t FROM c LEFT JOIN s ON s.cik = c.cik AND s.line = replace(symbol, '-', '')),
b AS (SELECT cik, min(f) AS b FROM own GROUP BY cik),
r AS (SELECT s.cik, s.ticker, s.f, s.t FROM s JOIN b USING (cik) WHERE s.t IS NOT NULL AND NOT EXISTS (SELECT 1 FROM own WHERE own.cik = s.cik AND own.ticker = s.ticker) AND s.f < b AND abs(date_diff('day', b, s.t)) <= 200),
a AS (SELECT * FROM own UNION ALL SELECT * FROM r)
SELECT cik, ticker, coalesce(lag(t) OVER w, DATE '1900-01-01') AS effective_from, CASE WHEN lead(ticker) OVER w IS NOT NULL THEN t END AS effective_to FROM a WINDOW w AS (PARTITION BY cik ORDER BY f NULLS LAST, ticker)""")
def share_class_rows(spark, d):
    """Symbols of each customer's one class by spelling and predecessor, over spans of orders as a crosswalk."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("cik"), F.col("c_nationkey").cast("string").alias("n"))
    symbol = F.when(F.col("cik") % 4 == 0, F.concat(F.lit("A"), "n", F.lit("B"))).when(F.col("cik") % 4 == 1, F.concat(F.lit("A"), "n", F.lit("-B"))).otherwise(F.concat(F.lit("C"), "n"))
    o = t(spark, d, "orders").join(c.withColumnRenamed("cik", "o_custkey"), "o_custkey")
    ticker = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("A"), "n", F.lit("-B"))).when(F.col("o_orderstatus") == "O", F.concat(F.lit("C"), "n")).otherwise(F.concat(F.lit("Q"), F.substring("o_orderpriority", 1, 1)))
    day = F.col("o_orderdate").cast("date")
    spans = o.select(F.col("o_custkey").alias("cik"), ticker.alias("ticker"), day.alias("valid_from"), F.when(F.col("o_orderkey") % 5 > 0, F.date_add(day, 400)).alias("valid_to"))
    return markup.share_class_rows(c.select("cik", F.lit("CommonStock").alias("class_member"), symbol.alias("symbol")), spans)[0].drop("class_label")


# --- facts under the labels of their day -----------------------------------------------------------------------------------

ORDER_FACTS = """f AS (SELECT o_custkey AS cik, o_orderkey AS adsh, o_orderpriority AS tag, last_day(CAST(o_orderdate AS DATE)) AS vd, o_totalprice AS v, CAST(o_orderdate AS DATE) + 10 AS tf, CASE WHEN o_orderkey % 9 = 0 THEN 'Unit=Other;' END AS seg FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY cik, tag, vd ORDER BY tf, adsh) AS pit, count(*) OVER (PARTITION BY cik, tag, vd) AS n, lead(tf) OVER (PARTITION BY cik, tag, vd ORDER BY tf, adsh) AS nx FROM f),
sus AS (SELECT DISTINCT adsh FROM k WHERE adsh % 17 = 0),
c AS (SELECT c_custkey AS cik, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS sector, CAST(c_nationkey AS VARCHAR) AS sub FROM customer),
mem AS (SELECT *, 'A' AS ix, DATE '1995-06-30' AS a, DATE '1998-06-30' AS b FROM c WHERE cik % 2 = 1 UNION ALL SELECT *, 'B', DATE '1998-06-30', NULL FROM c WHERE cik % 2 = 1 UNION ALL SELECT *, 'B', DATE '1996-12-31', NULL FROM c WHERE cik % 2 = 0),
tick AS (SELECT c_custkey AS cik, 'OLD' || c_custkey AS ticker, 'extended' AS src, DATE '1995-01-01' AS a, DATE '1998-01-01' AS b FROM customer UNION ALL SELECT c_custkey, 'NEW' || c_custkey, 'observed', DATE '1998-01-01', NULL FROM customer WHERE c_custkey % 2 = 0)"""


def order_facts(spark, d):
    """Orders as facts of their customers at month ends, known ten days later; every ninth is dimensioned."""
    day = F.col("o_orderdate").cast("date")
    f = t(spark, d, "orders").select(
        F.col("o_custkey").alias("cik"), F.col("o_orderkey").alias("adsh"), F.col("o_orderpriority").alias("tag"), F.last_day(day).alias("value_date"), F.lit(0).alias("qtrs"), F.col("o_totalprice").alias("value"),
        F.date_add(day, 10).alias("tradable_from"), F.when(F.col("o_orderkey") % 9 == 0, "Unit=Other;").alias("segments"), F.lit(None).cast("string").alias("coreg"),
    )
    return temporal.vintage_chain(f, ["cik", "tag", "value_date"], ["tradable_from", "adsh"], known="tradable_from")


def order_suspects(facts):
    return facts.where("adsh % 17 = 0").select("adsh", "tag", "value_date", "qtrs")


@query(f"""WITH {ORDER_FACTS} SELECT k.cik, k.adsh, tag, vd AS value_date, v AS value, ticker, coalesce(src = 'observed', FALSE) AS ticker_is_asof, ix AS index_name, sector AS gics_sector, sector IS NOT NULL AS sector_is_asof FROM k
LEFT JOIN tick ON tick.cik = k.cik AND tick.a <= tf AND (tick.b IS NULL OR tick.b > tf) LEFT JOIN mem ON mem.cik = k.cik AND mem.a <= tf AND (mem.b IS NULL OR mem.b > tf) WHERE pit = n AND seg IS NULL AND k.adsh NOT IN (SELECT adsh FROM sus)""")
def tradable_financials(spark, d):
    """Latest vintages under the ticker and index of their first session."""
    facts, c = order_facts(spark, d), t(spark, d, "customer").select(F.col("c_custkey").alias("cik"))
    span = lambda rows, name, source, a, b: rows.select("cik", F.concat(F.lit(name), F.col("cik").cast("string")).alias("ticker"), F.lit(True).alias("is_primary"), F.lit(source).alias("source"), F.lit(a).cast("date").alias("valid_from"), F.lit(b).cast("date").alias("valid_to"))
    tickers = span(c, "OLD", "extended", "1995-01-01", "1998-01-01").unionByName(span(c.where("cik % 2 = 0"), "NEW", "observed", "1998-01-01", None))
    out = gold.tradable_financials(facts, tickers, panel_members(spark, d), order_suspects(facts))
    return out.select("cik", "adsh", "tag", "value_date", "value", "ticker", "ticker_is_asof", "index_name", "gics_sector", "sector_is_asof")


@query(f"""WITH {ORDER_FACTS} SELECT k.cik, k.adsh, tag, vd AS value_date, v AS value, tf AS tradable_from, nx AS superseded_tradable, ix AS index_name FROM k LEFT JOIN mem ON mem.cik = k.cik AND mem.a <= tf AND (mem.b IS NULL OR mem.b > tf)
WHERE seg IS NULL AND vd BETWEEN DATE '1996-01-31' AND DATE '2000-12-31' AND k.adsh NOT IN (SELECT adsh FROM sus)""")
def fact_asof(spark, d):
    """Every vintage of plausible facts with its interval and the index of its day."""
    facts = order_facts(spark, d)
    out = gold.fact_asof(facts, panel_members(spark, d), order_suspects(facts), "1996-01-31", "2000-12-31")
    return out.select("cik", "adsh", "tag", "value_date", "value", "tradable_from", "superseded_tradable", "index_name")


@query("""WITH o AS (SELECT o_custkey AS cik, CAST(o_orderdate AS DATE) AS d, o_orderkey AS k, c_nationkey % 5 AS sub, CASE WHEN o_orderkey % 3 > 0 THEN c_mktsegment END AS sec FROM orders JOIN customer ON c_custkey = o_custkey),
x AS (SELECT cik, d, k, CAST(sub AS VARCHAR) AS sub, CASE sec WHEN 'AUTOMOBILE' THEN 'Energy' WHEN 'BUILDING' THEN 'Health Care' WHEN 'FURNITURE' THEN 'Utilities' WHEN 'MACHINERY' THEN 'Financials' END AS s FROM o),
car AS (SELECT sub, d, s, count(*) AS n FROM x WHERE s IS NOT NULL GROUP BY ALL),
top AS (SELECT sub, d, s, n FROM car QUALIFY row_number() OVER (PARTITION BY sub, d ORDER BY n DESC, s) = 1),
f AS (SELECT x.cik, x.d, k, x.sub, t.s FROM x JOIN top t ON t.sub = x.sub WHERE x.s IS NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY abs(date_diff('day', x.d, t.d)), n DESC, t.s, t.d) = 1)
SELECT cik, k AS order_key, s AS gics_sector FROM x WHERE s IS NOT NULL UNION ALL SELECT cik, k, s FROM f""")
def sector_fill(spark, d):
    """Orders as sightings of customers: missing and unknown sectors from the sub-industry's nearest sighting."""
    names = {"AUTOMOBILE": "Energy", "BUILDING": "Healthcare", "FURNITURE": "Utilites", "MACHINERY": "Finance", "HOUSEHOLD": "Household"}
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 5).cast("string").alias("gics_sub_industry"), F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col("c_mktsegment")).alias("s"))
    o = t(spark, d, "orders").join(c, "o_custkey")
    seen = o.select(F.lit("A").alias("index_name"), F.col("o_custkey").alias("cik"), F.col("o_orderdate").cast("date").alias("observed_on"), F.col("o_orderkey").cast("string").alias("ticker"), F.when(F.col("o_orderkey") % 3 > 0, F.col("s")).alias("gics_sector"), "gics_sub_industry")
    return spine.fill_sectors(seen).select("cik", F.col("ticker").cast("long").alias("order_key"), "gics_sector")


@query("""WITH f AS (SELECT o_custkey AS cik, o_orderkey % 4000 AS adsh, substr(o_orderpriority, 1, 1) AS p, o_totalprice AS v, last_day(CAST(o_orderdate AS DATE)) AS d, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 4 END AS q FROM orders),
g AS (SELECT cik, adsh, max(d) AS value_date, max(v) FILTER (p = '1' AND q = 4) AS a, max(v) FILTER (p = '2' AND q = 4) AS b, max(v) FILTER (p = '3') AS c FROM f GROUP BY ALL)
SELECT cik, value_date, adsh, round(coalesce(a, b) / 1e3, 5) AS xad, round(c / 1e3, 5) AS ppegt FROM g WHERE a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL""")
def footnote_items(spark, d):
    """Advertising and gross plant of orders as footnote facts, by the elements that priorities stand for."""
    names = {"1": "AdvertisingExpense", "2": "MarketingAndAdvertisingExpense", "3": "PropertyPlantAndEquipmentGross"}
    p = F.substring("o_orderpriority", 1, 1)
    tag = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), p), F.lit("Other"))
    qtrs = F.when(p == "3", 0).when(F.col("o_orderkey") % 7 == 0, 1).otherwise(4)
    f = t(spark, d, "orders").select(F.col("o_custkey").alias("cik"), (F.col("o_orderkey") % 4000).alias("adsh"), tag.alias("tag"), F.last_day(F.col("o_orderdate").cast("date")).alias("value_date"), qtrs.alias("qtrs"), F.col("o_totalprice").alias("value"))
    return exports.footnote_items(f, 1e3).withColumns({c: F.round(c, 5) for c in ("xad", "ppegt")})


@query("""WITH f AS (SELECT o_custkey AS cik, o_orderkey, o_orderkey % 3000 AS adsh, ['10-K', '10-Q/A', '8-K', '20-F', 'S-1'][1 + o_custkey % 5] AS form, last_day(CAST(o_orderdate AS DATE)) AS d, CASE WHEN o_orderkey % 3 = 0 THEN 'ClassOfStock=A;' END AS seg, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS v FROM orders)
SELECT adsh, d AS value_date, seg AS segments, max(v) AS shares FROM f WHERE form IN ('10-K', '10-Q/A', '20-F') AND v > 0 GROUP BY ALL""")
def cover_shares(spark, d):
    """Share counts on covers: orders of customers whose reports are periodic."""
    form = F.get(F.array(*map(F.lit, ["10-K", "10-Q/A", "8-K", "20-F", "S-1"])), (F.col("o_custkey") % 5).cast("int"))
    f = t(spark, d, "orders").select(
        F.col("o_custkey").alias("cik"), (F.col("o_orderkey") % 3000).alias("adsh"), form.alias("form"), F.lit("EntityCommonStockSharesOutstanding").alias("tag"), F.last_day(F.col("o_orderdate").cast("date")).alias("value_date"),
        F.when(F.col("o_orderkey") % 3 == 0, "ClassOfStock=A;").alias("segments"), F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(F.col("o_totalprice")).alias("value"), F.col("o_orderdate").alias("known_at"),
    )
    return exports.cover_shares(f).select("adsh", "value_date", "segments", "shares")


@query("""WITH x AS (SELECT c_custkey AS k, ' t' || (c_custkey % 97) || ['', '.b', '-un', '-WS', '-PA', '-RT', '.A'][1 + c_custkey % 7] || ' ' AS t, ['Energy', 'Utilites', 'Technology', 'Nothing', 'FInancials'][1 + c_nationkey % 5] AS s, CAST(c_custkey % 7000 AS VARCHAR) AS sic FROM customer)
SELECT k, replace(upper(trim(t)), '.', '-') AS ticker, NOT regexp_matches(upper(trim(t)), '-(UN|U|WT|WS|W|R|RT|P[A-Z]?)$') AS common, CASE s WHEN 'Energy' THEN s WHEN 'Utilites' THEN 'Utilities' WHEN 'Technology' THEN 'Information Technology' WHEN 'FInancials' THEN 'Financials' END AS sector,
  sic LIKE '6%' OR sic LIKE '63%' OR sic LIKE '15%' AS scoped FROM x""")
def scalar_codes(spark, d):
    """Tickers, sectors and industries made of the keys of customers."""
    pick = lambda values, c: F.get(F.array(*map(F.lit, values)), (F.col(c) % len(values)).cast("int"))
    name = F.concat(F.lit(" t"), (F.col("c_custkey") % 97).cast("string"), pick(["", ".b", "-un", "-WS", "-PA", "-RT", ".A"], "c_custkey"), F.lit(" "))
    sector = scalars.sector_canonical(pick(["Energy", "Utilites", "Technology", "Nothing", "FInancials"], "c_nationkey"))
    scoped = scalars.industry_in((F.col("c_custkey") % 7000).cast("int"), F.array(F.lit("6"), F.lit("63"), F.lit("15")))
    return t(spark, d, "customer").select(F.col("c_custkey").alias("k"), scalars.yahoo_symbol(name).alias("ticker"), scalars.common_ticker(name).alias("common"), sector.alias("sector"), scoped.alias("scoped"))


@query(f"""WITH {ORDER_FACTS}, h AS (SELECT c_custkey AS new, c_custkey + 1000000 AS old, DATE '1996-06-30' + CAST(c_custkey % 1500 AS INTEGER) AS cut FROM customer WHERE c_custkey % 5 = 0),
j AS (SELECT mem.cik, ix, a, b, old, cut FROM mem LEFT JOIN h ON h.new = mem.cik)
SELECT cik, ix AS index_name, CASE WHEN cut > a THEN cut ELSE a END AS valid_from, b AS valid_to FROM j WHERE cut IS NULL OR a >= cut OR b IS NULL OR b > cut
UNION ALL SELECT old, ix, a, least(cut, coalesce(b, DATE '9999-12-31')) FROM j WHERE cut IS NOT NULL AND a < cut""")
def succession_split(spark, d):
    """Memberships before a handoff go to the predecessor."""
    cut = F.date_add(F.lit("1996-06-30").cast("date"), (F.col("c_custkey") % 1500).cast("int"))
    handoffs = t(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("new_cik"), (F.col("c_custkey") + 1000000).alias("old_cik"), cut.alias("handoff_date"), F.lit(None).cast("date").alias("new_first_filed"))
    return spine.split_successions(panel_members(spark, d), handoffs).select("cik", "index_name", "valid_from", "valid_to")
