"""Peer statistics by fiscal year on inline cases."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.plans import cross
from tidemark.plans.concept_config import ConceptConfig

CONFIG = ConceptConfig(
    concepts=[
        ("revenue", "flow", True), ("cost_of_goods", "flow", False), ("gross_profit", "flow", True), ("total_assets", "balance", True), ("debt_noncurrent", "balance", False),
        ("total_debt", "balance", True), ("turnover", "ratio", True), ("revenue_growth", "growth", True),
    ],
    tags=[("revenue", "Revenues", 1, 1, ""), ("cost_of_goods", "Cost", 1, 1, ""), ("total_assets", "Assets", 1, 1, ""), ("debt_noncurrent", "Debt", 1, 1, "")],
    formulas=[("gross_profit", 1, [], "Cost", None, [("revenue", 1, True), ("cost_of_goods", -1, True)]), ("total_debt", 1, [], None, None, [("debt_noncurrent", 1, True)])],
    ratios=[("turnover", "revenue", "total_assets")],
    growths=[("revenue_growth", "revenue")],
)
FACT = "cik long, ticker string, tag string, value_date date, qtrs int, uom string, value double, tradable_from date, sic int"
MEMBER = "cik long, index_name string, gics_sector string, gics_sub_industry string, valid_from date, valid_to date"


def day(s):
    return dt.date.fromisoformat(s)


def fact(cik, tag, end, qtrs, value, uom="USD"):
    return (cik, f"T{cik}", tag, day(end), qtrs, uom, value, day(end) + dt.timedelta(40), 3571)


def values(spark, facts, members=None, **kw):
    members = members or [(c, "IX", "Tech", "Chips", day("2000-01-01"), None) for c in {f[0] for f in facts}]
    out = cross.fiscal_values(spark.createDataFrame(facts, FACT), spark.createDataFrame(members, MEMBER), CONFIG, **kw)
    return {(r["cik"], r["concept"], r["fiscal_year"]): (r["value"], r["value_date"].isoformat()) for r in out.collect()}


def test_a_balance_belongs_to_its_year_end(spark):
    """A December filer's March balance falls into the same fiscal year by date and is still not its balance."""
    facts = [fact(1, "Revenues", "2024-12-31", 4, 10.0), fact(1, "Assets", "2024-12-31", 0, 100.0), fact(1, "Assets", "2025-03-31", 0, 999.0), fact(2, "Assets", "2024-12-31", 0, 5.0)]
    assert values(spark, facts) == {(1, "revenue", 2024): (10.0, "2024-12-31"), (1, "total_assets", 2024): (100.0, "2024-12-31")}


def test_january_years_line_up_and_bounds_hold(spark):
    facts = [fact(1, "Revenues", "2025-01-31", 4, 10.0), fact(1, "Revenues", "1999-12-31", 4, 7.0), fact(1, "Revenues", "2031-12-31", 4, 8.0), fact(1, "Revenues", "2023-12-31", 4, 9.0, "JPY")]
    assert values(spark, facts, until="2026-12-31") == {(1, "revenue", 2024): (10.0, "2025-01-31")}


def test_membership_is_that_of_the_periods_own_end(spark):
    facts = [fact(1, "Revenues", f"{y}-12-31", 4, float(y)) for y in (2018, 2019, 2020, 2021)]
    members = [(1, "MID", "Auto", "Cars", day("2019-06-01"), day("2020-12-31")), (1, "BIG", "Tech", "Cars", day("2020-12-31"), day("2021-06-01"))]
    out = cross.fiscal_values(spark.createDataFrame(facts, FACT), spark.createDataFrame(members, MEMBER), CONFIG).collect()
    assert {(r["fiscal_year"], r["index_name"], r["gics_sector"]) for r in out} == {(2019, "MID", "Auto"), (2020, "BIG", "Tech")}


def test_formula_guard_and_face_zero(spark):
    base = [fact(c, t, "2024-12-31", q, v) for c in (1, 2, 3) for t, q, v in (("Revenues", 4, 10.0), ("Cost", 4, 4.0), ("Assets", 0, 50.0))]
    facts = [*base, fact(2, "CustomCostLine", "2024-12-31", 4, 1.0), fact(2, "Debt", "2024-12-31", 0, 6.0)]
    standard = spark.createDataFrame([("Revenues",), ("Cost",), ("Assets",), ("Debt",)], "tag string")
    face = "cik long, period_date date, form string, filed_date date, zero_by_face boolean, tradable_from date"
    row = lambda c, form, zero: (c, day("2024-12-31"), form, day("2025-02-01"), zero, day("2025-02-02"))
    faces = spark.createDataFrame([row(1, "10-K", True), row(2, "10-K", True), row(3, "10-Q", True), row(3, "10-K", False), row(4, "10-K", True)], face)
    got = values(spark, facts, standard_tags=standard, faces=faces)
    assert got[1, "gross_profit", 2024][0] == 6.0 and (2, "gross_profit", 2024) not in got
    assert {k: v[0] for k, v in got.items() if k[1] == "total_debt"} == {(1, "total_debt", 2024): 0.0, (2, "total_debt", 2024): 6.0}


def test_growth_asks_for_consecutive_years_of_full_length(spark):
    facts = [fact(1, "Revenues", e, 4, v) for e, v in (("2019-12-31", 10.0), ("2020-12-31", 15.0), ("2022-12-31", 30.0), ("2023-06-30", 33.0), ("2024-06-30", -3.0), ("2025-06-30", 9.0))]
    frame = spark.createDataFrame(facts, FACT)
    members = spark.createDataFrame([(1, "IX", "Tech", None, day("2000-01-01"), None)], MEMBER)
    grown = cross.fiscal_derived(cross.fiscal_values(frame, members, CONFIG), CONFIG).where("concept = 'revenue_growth'").collect()
    assert {(r["concept"], r["fiscal_year"]): round(r["value"], 6) for r in grown} == {("revenue_growth", 2020): 0.5, ("revenue_growth", 2024): round(-36 / 33, 6)}


def test_panel_levels_moments_and_thin_groups(spark):
    facts = [fact(c, t, "2024-12-31", q, float(c * k)) for c in range(1, 8) for t, q, k in (("Revenues", 4, 1), ("Assets", 0, 2))]
    members = spark.createDataFrame([(c, "IX", "Tech" if c < 7 else None, "Chips" if c < 4 else "Soft", day("2000-01-01"), None) for c in range(1, 8)], MEMBER)
    out = cross.peer_panel(spark.createDataFrame(facts, FACT), members, CONFIG)
    rows = out.where("concept = 'revenue'").collect()
    assert {(r["peer_level"], r["peer_group"], r["peer_count"]) for r in rows} == {("sector", "Tech", 6)}
    best = next(r for r in rows if r["cik"] == 6)
    assert (best["peer_mean"], best["peer_percentile"], best["zscore"]) == (3.5, 1.0, round(2.5 / 3.5**0.5, 4))
    flat = out.where("concept = 'turnover'").select("value", "zscore", "peer_stddev").distinct().collect()
    assert [tuple(r) for r in flat] == [(0.5, None, 0.0)]


def test_an_empty_table(spark):
    assert cross.peer_panel(spark.createDataFrame([], FACT), spark.createDataFrame([], MEMBER), CONFIG).select(F.count("*")).first()[0] == 0


# --- states by forward fill


def test_states_against_all_days(spark):
    import random

    from tidemark.plans import exports

    rng = random.Random(6)
    base = dt.date(2024, 1, 1)
    date = lambda n: None if n is None else base + dt.timedelta(n)
    rows = [(rng.choice([1, 2, 3]), rng.choice("abc"), f"f{i}", rng.choice([None, float(i)]), rng.randrange(40), rng.choice([None, rng.randrange(45), rng.randrange(45)])) for i in range(120)]
    rows += [(9, "a", "g1", 1.0, 5, None), (9, "a", "g2", 2.0, 8, 10), (9, "b", "g3", 3.0, 12, 12)]  # g1 comes back on day 10, g3 never holds
    want = {}
    for k in {r[0] for r in rows}:
        for day in {r[4] for r in rows if r[0] == k}:
            for tag in "abc":
                live = [r for r in rows if r[0] == k and r[1] == tag and r[4] <= day and (r[5] is None or r[5] > day)]
                if live:
                    best = max(live, key=lambda r: (r[4], r[2]))
                    want[k, date(day), tag] = best[3]
    df = spark.createDataFrame([(k, t, a, v, date(lo), date(hi)) for k, t, a, v, lo, hi in rows], "cik int, tag string, adsh string, value double, tradable_from date, superseded_tradable date")
    out = exports.states(df.repartition(3), ["cik"])
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["cik"], r["state_from"], r["tag"]): r["value"] for r in out.collect()} == want
    assert want[9, date(12), "a"] == 1.0 and (9, date(12), "b") not in want
    assert exports.states(df.limit(0), ["cik"], ["a"]).count() == 0
