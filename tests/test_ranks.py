"""Ranks in pieces against Spark's windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ranks

SCHEMA = "g string, h int, v double, s string, i long"


def frame(spark, seed, n=3000):
    rng = random.Random(seed)
    value = lambda: rng.choice([rng.random(), rng.randrange(5) * 1.0, 1.0, 1.0, None])  # noqa: E731  a third is one value
    rows = [(rng.choice(["big", "big", "big", "small", None]), rng.choice([1, None]), value(), rng.choice(["é", "z", "Z", "日", ""]), i) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


def expected(df, by, order, values, n):
    key = lambda k: [F.col(c).asc() if up else F.col(c).desc() for c, up in order[:k]]
    whole, equal = Window.partitionBy(*by).orderBy(*key(len(order))), Window.partitionBy(*by).orderBy(*key(values))
    return df.withColumns({"rn": F.row_number().over(whole).cast("long"), "rk": F.rank().over(equal).cast("long"), "pr": F.percent_rank().over(equal), "t": F.ntile(n).over(whole).cast("long")})


@pytest.mark.parametrize("by,order,values,large,tile", [
    ([], [("v", True), ("i", True)], 1, 100, 7), (["g"], [("v", False), ("i", False)], 1, 40, 5), (["g", "h"], [("v", True), ("s", False), ("i", True)], 2, 10, 100),
    (["g"], [("s", True), ("i", False)], 1, 1, 3), (["g"], [("v", True), ("i", True)], 1, 10**6, 4),
])
def test_pieces_equal_windows(spark, monkeypatch, by, order, values, large, tile):
    monkeypatch.setattr(ranks, "SAMPLED", 2)
    monkeypatch.setattr(ranks, "RUN", 4)
    df = frame(spark, len(order) * 10 + large % 7)
    got = ranks.numbered(df, by, order, values, "rn", "rk", "pr", ("t", tile), large)
    want = {tuple(r) for r in expected(df, by, order, values, tile).collect()}
    assert {tuple(r) for r in got.select("g", "h", "v", "s", "i", "rn", "rk", "pr", "t").collect()} == want


def test_a_large_group_is_cut(spark, monkeypatch):
    """No window partition holds more than a few pieces' worth of the one group there is."""
    monkeypatch.setattr(ranks, "SAMPLED", 20)
    df = spark.range(40_000).select((F.hash("id") % 1_000_003).alias("v"), "id")
    cuts = ranks._thresholds(df, [], [("v", True), ("id", True)], ["k0", "k1"], 4000)
    thresholds = sum(len(r) for r in cuts.first()["_runs"])
    assert 12 <= thresholds <= 30
    got = ranks.numbered(df, [], [("v", True), ("id", True)], row="rn", percent="pr", large=4000)
    assert got.agg(F.count_distinct("rn"), F.min("rn"), F.max("rn"), F.max("pr")).first()[:] == (40_000, 1, 40_000, 1.0)
    w = Window.orderBy("rn")
    assert got.withColumn("b", F.lag("v").over(w)).where("b > v").count() == 0


def test_edges(spark):
    df = frame(spark, 3, 10)
    assert ranks.numbered(df.limit(0), ["g"], [("v", True)], rank="rk", large=0).count() == 0
    one = ranks.numbered(df.limit(1), ["g"], [("v", True)], rank="rk", percent="pr", tile=("t", 3), large=0).first()
    assert (one["rk"], one["pr"], one["t"]) == (1, 0.0, 1)
    with pytest.raises(ValueError):
        ranks.numbered(df, ["g"], [("v", True)], rank="s")
