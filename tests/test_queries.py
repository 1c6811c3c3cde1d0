"""Registered queries on small tables of their own."""

import datetime as dt

from tidemark.plans import standins


def day(n):
    return dt.datetime(1997, 1, 1) + dt.timedelta(n)


def test_financials_pit_keeps_every_part(spark, tmp_path):
    lines = [(1, 10, 1, 1, 3.0, day(0)), (2, 10, 1, 1, 9.0, day(5)), (3, 20, 1, 1, 8.0, day(1)), (4, 30, 1, 1, 4.0, day(2))]
    schema = "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double, l_shipdate timestamp"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["part"], r["adsh"], r["value"]) for r in standins.queries()["financials_pit"](spark, str(tmp_path)).collect()}
    assert got == {(10, 1, 3.0), (20, 3, 8.0), (30, 4, 4.0)}  # first lines of four units or less too


def test_fold_moves_each_row_once(spark, tmp_path):
    lines = [(i, i % 5 if i % 11 else None, 1, 1, 9.0, day(i * 29) if i % 13 else None) for i in range(60)]
    schema = "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double, l_shipdate timestamp"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to send
    try:
        folded = standins.queries()["incremental_fold"](spark, str(tmp_path))
        plan = folded._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3  # old rows, new rows, the sources of the new
        whole = standins.queries()["vintage_chain"](spark, str(tmp_path))
        assert sorted(map(str, folded.collect())) == sorted(map(str, whole.select(*folded.columns).collect())) and folded.count() == 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def dealt_once(spark, tmp_path, monkeypatch, name):
    """Rows of the query with 4 orders a task; its plan deals rows by number only, and by the number that the rows ask for."""
    import duckdb

    from tidemark.operators import rel
    from tidemark.plans import standins

    ranks = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    orders = [(i, i % 9, "O", float(i * 7 % 50), day(i * 37 % 900), ranks[i * 3 % 5]) for i in range(120)]
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(orders, schema).write.parquet(f"{tmp_path}/orders.parquet")
    asked = rel.parts_for
    monkeypatch.setattr(rel, "parts_for", lambda df: asked(df, 4))
    got = standins.queries()[name](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and "hashpartitioning(cik" in plan and ", 30), REPARTITION_BY_NUM" in plan
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({standins.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and want


def test_annual_panel_deals_tasks_by_rows(spark, tmp_path, monkeypatch):
    dealt_once(spark, tmp_path, monkeypatch, "annual_panel")


def test_state_expansion_deals_tasks_by_rows(spark, tmp_path, monkeypatch):
    dealt_once(spark, tmp_path, monkeypatch, "state_expansion")


def test_successions_meet_in_slices_of_the_calendar(spark):
    import random

    from tidemark.plans import spine

    rng, d0 = random.Random(3), dt.date(2000, 1, 1)
    span = lambda: (a := d0 - dt.timedelta(rng.randrange(-900, 900)), a + dt.timedelta(rng.choice([30, 200, 400])) if rng.random() < 0.9 else None)
    held = [(rng.randrange(30), f"T{rng.randrange(3)}", *span(), rng.random() < 0.9) for _ in range(120)]
    filed = {c: (d0 + dt.timedelta(rng.randrange(500)) if c % 4 else None, d0 + dt.timedelta(rng.randrange(900))) for c in range(28)}
    t = spark.createDataFrame(held, "cik int, ticker string, valid_from date, valid_to date, is_primary boolean")
    c = spark.createDataFrame([(k, *v) for k, v in filed.items()], "cik int, first_filed date, last_filed date")
    want = {}
    for o, tick, _, end, p in held:
        for n, other, start, _, q in held:
            if p and q and end and o != n and o in filed and tick == other and -45 <= (start - end).days <= 120:
                of, ol, nf = *filed[o], filed.get(n, (None,))[0]
                if (nf and of and (nf - of).days > 30) or (nf is None and (end - ol).days <= 400):
                    want[o, n, tick] = min(start, want.get((o, n, tick), start))
    out = spine.successions(t, c)
    assert {tuple(r)[:3]: r["handoff_date"] for r in out.collect()} == want and out.count() == len(want) > 20
    assert "_slice" in out._jdf.queryExecution().optimizedPlan().toString()  # pairs are not made of all holders of a ticker
