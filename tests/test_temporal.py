"""Temporal and relational primitives on small inline frames."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rel, temporal

D = date


def rows(df, *cols):
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=str)


def test_three_vintages(spark):
    f = spark.createDataFrame([("a", "k", 76.555, D(2023, 2, 10)), ("b", "k", 58.1, D(2023, 4, 25)), ("c", "k", 29.139, D(2025, 2, 3))], "adsh string, key string, value double, known_at date").withColumn("tradable_from", F.col("known_at"))
    c = temporal.vintage_chain(f, ["key"]).cache()
    for day, want in (("2023-03-01", 76.555), ("2023-06-30", 58.1), ("2025-06-30", 29.139)):
        got = c.where(temporal.asof_pred(F.col("tradable_from"), F.col("superseded_tradable"), F.lit(day).cast("date"))).collect()
        assert [r["value"] for r in got] == [want]
    assert rows(c, "adsh", "rank_pit", "rank_latest") == [("a", 1, 3), ("b", 2, 2), ("c", 3, 1)]


def test_fold_equals_full_build_and_is_idempotent(spark):
    data = [(f"f{i % 9}", i % 4, None if i % 3 else "seg", float(i), D(2020, 1 + (i * 7) % 12, 1 + i % 9)) for i in range(60)]
    f = spark.createDataFrame(data, "adsh string, cik int, segments string, value double, known_at date").withColumn("tradable_from", F.col("known_at")).dropDuplicates(["cik", "segments", "known_at", "adsh"])
    new = f.where("adsh IN ('f3', 'f7')")
    key = ["cik", "segments"]
    old = temporal.vintage_chain(f.where("adsh NOT IN ('f3', 'f7')"), key)
    once = temporal.fold_chain(old, new, key)
    full = temporal.vintage_chain(f, key)
    cols = full.columns
    assert rows(once, *cols) == rows(full, *cols) == rows(temporal.fold_chain(once, new, key), *cols)


CALENDAR = [(D(2024, 7, 2), "16:00:00"), (D(2024, 7, 3), "13:00:00"), (D(2024, 7, 5), "16:00:00"), (D(2024, 7, 8), "16:00:00")]


@pytest.fixture(scope="module")
def calendar(spark):
    from tidemark.sources.reference import build_calendar

    return build_calendar(spark.createDataFrame(CALENDAR, "session_date date, close_time_et string")).cache()


def test_after_close_rolls_to_the_next_session(spark, calendar):
    known = [(1, datetime(2024, 7, 2, 19, 59)), (2, datetime(2024, 7, 2, 20, 0)), (3, datetime(2024, 7, 3, 17, 30)), (4, datetime(2024, 7, 6, 12, 0)), (5, datetime(2024, 7, 9, 0, 0)), (6, None)]
    out = temporal.availability(spark.createDataFrame(known, "id int, known_at timestamp"), calendar)
    assert {r["id"]: r["tradable_from"] for r in out.collect()} == {1: D(2024, 7, 2), 2: D(2024, 7, 3), 3: D(2024, 7, 5), 4: D(2024, 7, 8), 5: None, 6: None}


def test_shift_sessions(calendar):
    assert temporal.shift_sessions(calendar, D(2024, 7, 6), 0) == D(2024, 7, 6)
    assert temporal.shift_sessions(calendar, D(2024, 7, 6), 1) == D(2024, 7, 3)
    with pytest.raises(ValueError):
        temporal.shift_sessions(calendar, D(2024, 7, 3), 5)
    with pytest.raises(ValueError):
        temporal.shift_sessions(calendar, None, 1)


@pytest.mark.parametrize("by", [["k"], []])
@pytest.mark.parametrize("direction,strict,want", [("forward", True, [D(2024, 3, 9), None]), ("forward", False, [D(2024, 1, 5), D(2024, 5, 1)]), ("backward", True, [D(2023, 12, 1), D(2024, 3, 9)]), ("backward", False, [D(2024, 1, 5), D(2024, 5, 1)])])
def test_asof_join(spark, by, direction, strict, want):
    left = spark.createDataFrame([(1, D(2024, 1, 5)), (1, D(2024, 5, 1))], "k int, t date")
    right = spark.createDataFrame([(1, D(2023, 12, 1)), (1, D(2024, 1, 5)), (1, D(2024, 3, 9)), (1, D(2024, 5, 1))], "k int, at date")
    out = temporal.asof_join(left, right.withColumn("hit", F.col("at")), "t", "at", ["hit"], by=by, direction=direction, strict=strict)
    assert [r["hit"] for r in out.orderBy("t").collect()] == want
    with pytest.raises(ValueError):
        temporal.asof_join(left, right, "t", "at", ["at"], direction="sideways")


def test_asof_tolerance_and_empty_right(spark):
    left = spark.createDataFrame([(1, D(2024, 1, 5)), (None, D(2024, 1, 5))], "k int, t date")
    right = spark.createDataFrame([(1, D(2023, 1, 1))], "k int, at date")
    out = temporal.asof_join(left, right, "t", "at", ["at"], by=["k"], direction="backward", tolerance_days=30)
    assert [r["at"] for r in out.collect()] == [None, None]
    assert temporal.asof_join(left, right.where("k = 9"), "t", "at", ["at"]).count() == 2


def test_intervals(spark):
    d = lambda x: D(2020, 1, x)
    i = spark.createDataFrame([("a", d(1), d(5), "x"), ("a", d(5), d(7), "x"), ("a", d(10), None, "y"), ("a", d(12), d(14), "z"), ("b", d(3), d(3), "x")], "k string, lo date, hi date, p string")
    assert rows(temporal.merge_intervals(i, ["k"], "lo", "hi"), "k", "lo", "hi") == [("a", d(1), d(7)), ("a", d(10), None), ("b", d(3), d(3))]
    flat = temporal.flatten_intervals(i, ["k"], "lo", "hi", ["p"], [F.col("p").desc()])
    assert rows(flat, "k", "lo", "hi", "p") == [("a", d(1), d(7), "x"), ("a", d(10), d(12), "y"), ("a", d(12), d(14), "z"), ("a", d(14), None, "y")]
    rel.assert_non_overlapping(flat, ["k"], "lo", "hi")
    with pytest.raises(rel.CheckFailed):
        rel.assert_non_overlapping(i, ["k"], "lo", "hi")
    clipped = temporal.clip_intervals(i, "lo", "hi", F.lit("2020-01-04").cast("date"), F.lit(None).cast("date"))
    assert set(rows(clipped, "lo", "hi")) == {(d(4), d(5)), (d(5), d(7)), (d(10), None), (d(12), d(14))}
    points = spark.createDataFrame([("a", d(5)), ("a", d(8)), ("a", d(13))], "k string, at date")
    assert rows(temporal.interval_join(points, i, ["k"], "at", "lo", "hi"), "at", "p") == [(d(13), "y"), (d(13), "z"), (d(5), "x")]


def test_bridged_islands_bridge_short_and_partial_gaps(spark):
    days = [D(2020, 1, 1), D(2020, 3, 1), D(2021, 1, 1), D(2022, 1, 1), D(2023, 1, 1)]
    caps = spark.createDataFrame([(x, i == 2) for i, x in enumerate(days)], "observed_on date, is_partial boolean")
    seen = spark.createDataFrame([("p", days[1]), ("p", days[3]), ("q", days[0]), ("q", days[3]), ("r", days[4])], "k string, observed_on date")
    out = temporal.bridge_islands(seen, caps, ["k"])
    assert rows(out, "k", "valid_from", "valid_to") == [("p", days[1], days[4]), ("q", days[0], days[1]), ("q", days[3], days[4]), ("r", days[4], None)]


def test_relational_helpers(spark):
    old = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "k int, s string, v string")
    new = spark.createDataFrame([(1, None, "A"), (3, None, "c")], "k int, s string, v string")
    assert rows(rel.upsert(old, new, ["k", "s"]), "k", "v") == [(1, "A"), (2, "b"), (3, "c")]
    assert rows(rel.upsert(old, new, ["k", "s"], overwrite=False), "k", "v") == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(rel.union_prefer([new, old], ["k"]), "k", "v") == [(1, "A"), (2, "b"), (3, "c")]
    a, b = rel.table_digest(old).first(), rel.table_digest(old.orderBy(F.col("k").desc())).first()
    assert a == b != rel.table_digest(new).first()
    rel.assert_unique(old, ["k"])
    with pytest.raises(rel.CheckFailed):
        rel.assert_unique(old.union(old), ["k"])
    with pytest.raises(rel.CheckFailed):
        rel.assert_check(old, F.col("k") > 1, "k above one")


# --- nulls, nearest rows, sweeps


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_asof_join_on_nulls(spark, by, direction):
    left = spark.createDataFrame([(1, "a", D(2024, 1, 5)), (2, "a", None), (3, None, D(2024, 1, 5)), (4, None, None)], "i int, k string, d date")
    right = spark.createDataFrame([("a", D(2024, 1, 4), 4), ("a", D(2024, 1, 6), 6), (None, D(2024, 1, 5), 5), ("a", None, 9), (None, None, 8)], "k string, e date, v int")
    if not by:
        right = right.drop("k")
    got = {r["i"]: r["v"] for r in temporal.asof_join(left, right, "d", "e", ["v"], by, direction, strict=True).collect()}
    hit = 6 if direction == "forward" else 4
    assert got == ({1: hit, 2: None, 3: None, 4: None} if by else {1: hit, 2: None, 3: hit, 4: None})


def test_nearest_against_all_pairs(spark):
    rng = random.Random(4)
    day = lambda: D(2024, 1, 1) + timedelta(rng.randrange(40))
    left = [(i, rng.choice(["a", "b", "c", None]), rng.choice([day(), day(), None])) for i in range(80)]
    right = [(rng.choice(["a", "b", None]), rng.choice([day(), day(), day(), None]), rng.randrange(3), j) for j in range(40)]
    for within in (None, 3):
        want = {}
        for i, k, d in left:
            fits = [(abs((e - d).days), -n, e, v) for kk, e, n, v in right if k is not None and kk == k and d is not None and e is not None and (within is None or abs((e - d).days) <= within)]
            want[i] = min(((a, n, e) for a, n, e, _ in fits), default=None)
        out = temporal.nearest_join(spark.createDataFrame(left, "i int, k string, d date"), spark.createDataFrame(right, "k string, e date, n int, v int"), "k", "d", "e", ["n", "e"], ["i"], within, [F.col("n").desc()])
        got = {r["i"]: None if r["e"] is None else (abs((r["e"] - r["d"]).days), -r["n"], r["e"]) for r in out.collect()}
        assert got == want


def test_nearest_of_one_large_key(spark):
    n = 100_000
    left = spark.range(n).select(F.col("id").alias("i"), F.lit("k").alias("k"), F.date_add(F.lit(D(1900, 1, 1)), (F.col("id") % 60_000).cast("int")).alias("d"))
    right = spark.range(n).select(F.lit("k").alias("k"), F.date_add(F.lit(D(1900, 1, 1)), (F.col("id") % 30_000 * 2).cast("int")).alias("e"), F.col("id").alias("v"))
    out = temporal.nearest_join(left, right, "k", "d", "e", ["v"], ["i"])
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    row = out.agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.count_if(F.col("v").isNull()).alias("lost")).first()
    # even days meet their own row, odd days the day before; of copies the earlier id would tie by time alone, so any has the day's remainder
    assert (row["n"], row["lost"]) == (n, 0)
    assert out.where((F.col("v") % 30_000) != F.floor((F.col("i") % 60_000) / 2)).count() == 0


def brute_timeline(rows):
    """Payload by day for each key, from (key, lo, hi, order, payload)."""
    out = {}
    for key in {r[0] for r in rows}:
        for day in range(0, 80):
            live = [r for r in rows if r[0] == key and r[1] is not None and r[1] <= day and (r[2] is None or r[2] > day)]
            if live:
                out[key, day] = min(live, key=lambda r: (r[3], -r[1], r[4] is not None, r[4] or ""))[4]
    return out


def test_sweep_against_days(spark):
    rng = random.Random(8)
    base = D(2024, 1, 1)
    date = lambda n: None if n is None else base + timedelta(n)
    rows = [(rng.choice("abc"), rng.randrange(60), rng.choice([None, rng.randrange(70), rng.randrange(70)]), rng.randrange(4), rng.choice(["x", "y", None])) for _ in range(120)]
    rows += [("d", 5, 5, 0, "x"), ("d", 9, 3, 0, "x"), ("d", None, 9, 0, "x"), ("e", 1, 4, 1, "x"), ("e", 4, 8, 2, "x"), ("e", 10, None, 0, "x")]
    df = spark.createDataFrame([(k, date(a), date(b), o, p) for k, a, b, o, p in [*rows, (None, 1, 2, 0, "x")]], "k string, lo date, hi date, o int, p string").repartition(5)
    got = temporal.flatten_intervals(df, ["k"], "lo", "hi", ["p"], [F.col("o").asc()]).collect()
    days = {}
    for r in got:
        for n in range((r["lo"] - base).days, min(80, (r["hi"] - base).days if r["hi"] else 80)):
            assert (r["k"], n) not in days
            days[r["k"], n] = r["p"]
    assert days == brute_timeline(rows)
    edges = {(r["k"], r["lo"], r["p"]) for r in got}
    assert not any((r["k"], r["hi"], r["p"]) in edges for r in got if r["hi"])  # abutting equals are one
    assert sorted((r["lo"], r["hi"]) for r in got if r["k"] == "e") == [(date(1), date(8)), (date(10), None)]
    assert temporal.flatten_intervals(df.limit(0), ["k"], "lo", "hi", ["p"], [F.col("o").asc()]).count() == 0


def test_sweep_of_one_key_with_50000_overlapping_intervals(spark):
    n = 50_000
    lo = F.date_add(F.lit(D(1800, 1, 1)), F.col("id").cast("int"))
    df = spark.range(n).select(F.lit(1).alias("k"), lo.alias("lo"), F.date_add(lo, 60_000).alias("hi"), F.col("id").alias("p"), (-F.col("id")).alias("o"))
    rows = temporal.flatten_intervals(df, ["k"], "lo", "hi", ["p"], [F.col("o").asc()])  # the newest start holds
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    out = rows.agg(F.count("*").alias("n"), F.sum(F.datediff("hi", "lo")).alias("days"), F.max("p").alias("p")).first()
    assert (out["n"], out["days"], out["p"]) == (n, n - 1 + 60_000, n - 1)
