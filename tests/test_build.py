"""Stored tables under failures, and the ordered build from raw files to derived tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators.rel import table_digest
from tidemark.plans import build
from tidemark.plans.build import Done, Raw, Step
from tidemark.plans.concept_config import ConceptConfig
from tidemark.sources import bronze, resume
from tidemark.sources.tables import Changed, Tables

ROW = "k int, v string, p string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- tables


def test_tables_by_parts(spark, tmp_path):
    t = Tables(spark, f"{tmp_path}/t")
    assert not t.exists("x")
    with pytest.raises(LookupError):
        t.read("x")
    t.write("x", spark.createDataFrame([(1, "a", "p/1"), (2, "b", "q"), (3, "c", None)], ROW), by="p")
    before = t.manifest("x")["parts"]
    assert t.upsert("x", spark.createDataFrame([(1, "new", "p/1"), (4, "d", "p/1")], ROW), ["k"], "p") == ["p%2F1"]
    after = t.manifest("x")["parts"]
    assert {p for p in after if after[p] != before[p]} == {"p%2F1"}  # the others keep their files
    assert rows(t.read("x").where("p IS NOT NULL")) == [(1, "new", "p/1"), (2, "b", "q"), (4, "d", "p/1")]
    assert t.upsert("x", spark.createDataFrame([(1, "late", "p/1"), (9, "z", "new")], ROW), ["k"], "p", overwrite=False) == ["new", "p%2F1"]
    assert rows(t.read("x").where("k IN (1, 9)")) == [(1, "new", "p/1"), (9, "z", "new")]
    t.replace_parts("x", spark.createDataFrame([(5, "e", "q")], ROW), "p", drop=["new"])
    assert rows(t.read("x").select("k")) == [(1,), (3,), (4,), (5,)]
    t.replace_parts("x", spark.createDataFrame([], ROW), "p")
    assert t.read("x").count() == 4 and t.names() == ["x"]
    reader = t.read("x", ["q"])
    t.expire("x", keep=10)  # the folder of no rows
    assert t.expire("x", keep=10) == 0 and t.expire("x") > 0
    assert rows(reader) == [(5, "e", "q")] and t.read("x").count() == 4


def test_a_failure_between_the_steps_leaves_the_old_table(spark, tmp_path, monkeypatch):
    t = Tables(spark, f"{tmp_path}/t")
    t.write("x", spark.createDataFrame([(1, "old", "p")], ROW), by="p")

    def dies(*a):
        raise RuntimeError("lost")

    for step in ("_commit", "_stage"):
        with monkeypatch.context() as m:
            m.setattr(Tables, step, dies)
            for change in (lambda: t.write("x", spark.createDataFrame([(2, "new", "p")], ROW)), lambda: t.upsert("x", spark.createDataFrame([(1, "new", "p")], ROW), ["k"], "p")):
                with pytest.raises(RuntimeError):
                    change()
        assert rows(t.read("x")) == [(1, "old", "p")]
    failing = spark.createDataFrame([(7, "x", "p")], ROW).withColumn("v", F.raise_error(F.lit("bad row")).cast("string"))
    with pytest.raises(Exception, match="bad row"):
        t.write("x", failing)
    assert rows(t.read("x")) == [(1, "old", "p")]
    (tmp_path / "t" / "x" / "manifest" / "0000000002.json").write_text('{"schema": ')  # a writer that died in the manifest
    assert rows(t.read("x")) == [(1, "old", "p")]
    t.write("x", spark.createDataFrame([(3, "next", "p")], ROW))
    assert rows(t.read("x")) == [(3, "next", "p")]
    assert t.expire("x") >= 3


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    t = Tables(spark, f"{tmp_path}/t")
    t.write("x", spark.createDataFrame([(1, "a", "p")], ROW))
    seen = t.manifest("x")["number"]
    t.write("x", spark.createDataFrame([(2, "b", "p")], ROW))
    with pytest.raises(Changed):
        t._commit("x", t.read("x").schema, {}, {}, seen)
    assert rows(t.read("x")) == [(2, "b", "p")]


def test_digest_tells_rows_apart(spark):
    digest = lambda *r: table_digest(spark.createDataFrame(list(r), "a string, b string")).first()["digest"]
    assert digest(("x\x1fy", "z")) != digest(("x", "y\x1fz"))
    assert len({digest((x, "a")) for x in (None, "\0", "", "~", "0:")}) == 5
    assert digest(("a", "b"), ("c", "d")) == digest(("c", "d"), ("a", "b"))


def test_prices_are_upserted_by_year(spark, tmp_path):
    from tidemark.plans import market

    t, schema = Tables(spark, f"{tmp_path}/t"), "cik int, ticker string, month_end date, close_raw double"
    day = dt.date.fromisoformat
    market.store_prices(t, spark.createDataFrame([(1, "A", day("2022-12-30"), 1.0), (1, "A", day("2023-01-31"), 2.0), (2, None, day("2023-01-31"), 3.0)], schema))
    before = t.manifest("monthly_price")["parts"]
    assert market.store_prices(t, spark.createDataFrame([(1, "A", day("2023-01-31"), 2.5), (2, None, day("2023-01-31"), 3.5), (1, "A", day("2023-02-28"), 4.0)], schema)) == ["2023"]
    assert t.manifest("monthly_price")["parts"]["2022"] == before["2022"]
    assert sorted(r["close_raw"] for r in t.read("monthly_price").collect()) == [1.0, 2.5, 3.5, 4.0]


def test_a_quarter_that_dies_can_be_loaded_again(spark, tmp_path, monkeypatch):
    path = tmp_path / "tag.txt"
    path.write_text("\t".join(bronze.COLUMNS["tag"]) + "\n" + "\t".join(["T", "v", "0", "0", "m", "I", "D", "L", ""]) + "\n")
    root = f"{tmp_path}/raw"
    bronze.load_quarter(spark, root, "2024q1", {"tag": str(path)})
    with monkeypatch.context() as m:
        m.setattr(Tables, "upsert", lambda *a: (_ for _ in ()).throw(RuntimeError("before the log")))
        with pytest.raises(RuntimeError):
            bronze.load_quarter(spark, root, "2024q2", {"tag": str(path)})
    assert rows(bronze.load_log(spark, root)) == [("2024q1", "tag", 1)]
    assert bronze.load_all(spark, root, {q: {"tag": str(path)} for q in ("2024q1", "2024q2")}) == ["2024q2"]
    assert bronze.raw_table(spark, root, "tag").count() == 2
    bronze.truncate(spark, root)
    assert bronze.load_log(spark, root).count() == 0 and bronze.raw_table(spark, root, "tag").count() == 0


# --- many sources


def test_an_interrupted_load_ends_as_one_run(spark, tmp_path):
    data = {"a/1": [1, 2], "b": [], "c": [3], "d": [4, 5], "e": [6]}
    marks = {s: "1" for s in data}
    read = lambda s: spark.createDataFrame([(n,) for n in data[s]], "n int")
    whole, broken = Tables(spark, f"{tmp_path}/whole"), Tables(spark, f"{tmp_path}/broken")
    assert resume.load_sources(whole, "x", marks, read) == sorted(data)
    asked = []

    def dies(s):
        asked.append(s)
        if s == "d":
            raise RuntimeError("lost")
        return read(s)

    with pytest.raises(RuntimeError):
        resume.load_sources(broken, "x", marks, dies, together=2)
    assert set(resume.finished(broken, "x")) == {"a/1", "b"} and rows(broken.read("x")) == [(1, "a/1"), (2, "a/1")]
    assert resume.load_sources(broken, "x", marks, read, together=2) == ["c", "d", "e"]
    assert rows(broken.read("x")) == rows(whole.read("x")) and resume.finished(broken, "x") == resume.finished(whole, "x")
    assert resume.load_sources(broken, "x", marks, dies) == []
    data["a/1"] = [7]  # a changed source replaces its own rows only
    assert resume.load_sources(broken, "x", marks | {"a/1": "2"}, read) == ["a/1"]
    assert rows(broken.read("x").where("n IN (1, 2, 7)")) == [(7, "a/1")]
    assert resume.purge(broken, "x", ["a/1", "c", "never"]) == ["a/1", "c"]
    assert rows(broken.read("x")) == [(4, "d"), (5, "d"), (6, "e")]
    assert resume.load_sources(broken, "x", marks, read) == ["a/1", "c"]
    assert resume.finished(broken, "nothing") == {} and resume.purge(broken, "nothing", ["a"]) == []


# --- ordered build on small steps


def small_steps(spark):
    text = lambda name: lambda t, f: spark.read.text(f[name])
    count = lambda *names: lambda t, f: spark.createDataFrame([(n, -1 if t[n] is None else t[n].count()) for n in names], "name string, n long")
    parts = lambda raw: [(n[:-4], f"many/{n}") for n in raw.names("many")]
    return [
        Step("top", count("a", "opt"), needs=["a"], wants=["opt"]),
        Step("a", text("a.txt"), files=["a.txt"]),
        Step("opt", text("opt.txt"), files=["opt.txt"]),
        Step("b", text("b.txt"), files=["b.txt"]),
        Step("many", lambda t, f: spark.read.text(f["part"]), by="part", parts=parts),
        Step("last", count("b", "many"), needs=["b", "many"]),
    ]


def states(done):
    return {d.name: d.state for d in done}


def test_only_what_changed_is_built(spark, tmp_path):
    raw, out = tmp_path / "raw", f"{tmp_path}/out"
    (raw / "many").mkdir(parents=True)
    for name, text in (("a.txt", "1\n2\n"), ("b.txt", "1\n"), ("many/x.txt", "1\n"), ("many/y.txt", "2\n3\n")):
        (raw / name).write_text(text)
    run = lambda **kw: build.build(spark, small_steps(spark), str(raw), out, **kw)
    first = run()
    assert states(first) == {"a": "built", "opt": "absent", "b": "built", "many": "built", "top": "built", "last": "built"}
    t = Tables(spark, out)
    assert rows(t.read("top")) == [("a", 2), ("opt", -1)] and rows(t.read("last")) == [("b", 1), ("many", 3)]
    assert set(states(run()).values()) == {"kept", "absent"}
    (raw / "a.txt").write_text("1\n2\n")  # touched, not changed
    assert set(states(run()).values()) == {"kept", "absent"}
    (raw / "a.txt").write_text("1\n2\n3\n")
    assert {n for n, s in states(run()).items() if s == "built"} == {"a", "top"}
    (raw / "many" / "y.txt").write_text("2\n")
    (raw / "many" / "z.txt").write_text("9\n")
    done = {d.name: d for d in run()}
    assert done["many"] == Done("many", "built", ("y", "z")) and done["last"].state == "built" and done["top"].state == "kept"
    (raw / "many" / "x.txt").unlink()
    assert {n for n, s in states(run()).items() if s == "built"} == {"many", "last"}
    assert rows(t.read("last")) == [("b", 1), ("many", 2)]
    (raw / "opt.txt").write_text("1\n")
    assert {n for n, s in states(run()).items() if s == "built"} == {"opt", "top"}
    assert rows(t.read("top")) == [("a", 3), ("opt", 1)]
    (raw / "b.txt").unlink()
    assert states(run(only=["last"])) == {"b": "absent", "many": "kept", "last": "absent"}


def test_a_build_that_dies_goes_on(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\n")
    bad = {"now": True}

    def fails(t, f):
        if bad["now"]:
            raise RuntimeError("lost")
        return t["a"]

    steps = [Step("a", lambda t, f: spark.read.text(f["a.txt"]), files=["a.txt"]), Step("b", fails, ["a"])]
    with pytest.raises(RuntimeError):
        build.build(spark, steps, str(tmp_path), f"{tmp_path}/out")
    bad["now"] = False
    assert states(build.build(spark, steps, str(tmp_path), f"{tmp_path}/out")) == {"a": "kept", "b": "built"}


def test_graphs_that_cannot_be_built():
    nothing = lambda t, f: None
    for steps in ([Step("a", nothing, ["b"]), Step("b", nothing, ["a"])], [Step("a", nothing, ["x"])], [Step("a", nothing), Step("a", nothing)]):
        with pytest.raises(ValueError):
            build.in_order(steps)


# --- raw files to gold

CONFIG = ConceptConfig(
    concepts=[("revenue", "flow", True), ("total_assets", "balance", True), ("turnover", "ratio", True)],
    tags=[("revenue", "Revenues", 1, 1, ""), ("total_assets", "Assets", 1, 1, "")],
    ratios=[("turnover", "revenue", "total_assets")],
)
TODAY = "2024-06-30"


def write_raw(root, companies=7):
    def table(quarter, name, records):
        folder = root / "quarters" / quarter
        folder.mkdir(parents=True, exist_ok=True)
        lines = ["\t".join(bronze.COLUMNS[name])] + ["\t".join(str(r.get(c, "")) for c in bronze.COLUMNS[name]) for r in records]
        (folder / f"{name}.txt").write_text("\n".join(lines) + "\n", encoding="latin-1")

    for quarter, year in (("2023q1", 2022), ("2024q1", 2023)):
        subs = [{"adsh": f"{year}-{c}", "cik": c, "name": f"Company {c}", "sic": "3571", "form": "10-K", "period": f"{year}1231", "fy": year, "fp": "FY", "filed": f"{year + 1}0215", "accepted": f"{year + 1}-02-15 12:00:00"} for c in range(1, companies + 1)]
        table(quarter, "sub", subs)
        table(quarter, "tag", [{"tag": t, "version": "us-gaap/2023", "custom": "0", "abstract": "0", "tlabel": t} for t in ("Revenues", "Assets")])
        facts = [{"adsh": s["adsh"], "tag": t, "version": "us-gaap/2023", "ddate": s["period"], "qtrs": q, "uom": "USD", "value": s["cik"] * k * (year - 2020)} for s in subs for t, q, k in (("Revenues", 4, 10), ("Assets", 0, 100))]
        table(quarter, "num", facts)
        table(quarter, "pre", [{"adsh": s["adsh"], "report": 2, "line": i, "stmt": "BS", "inpth": 0, "tag": "Assets", "version": "us-gaap/2023", "plabel": "Assets"} for s in subs for i in (1,)])
    ref = root / "lookups"
    ref.mkdir()
    days = [dt.date(2022, 1, 3) + dt.timedelta(i) for i in range(1300)]
    (ref / "trading_calendar.csv").write_text("session_date,close_time_et\n" + "".join(f"{d},16:00:00\n" for d in days if d.weekday() < 5))
    seen = ["2022-06-01", "2022-12-01", "2023-06-01", "2023-12-01", "2024-06-01"]
    (ref / "ticker_history.csv").write_text("cik,ticker,title,observed_on,source\n" + "".join(f"{c},T{c},Company {c},{d},archive\n" for c in range(1, companies + 1) for d in seen))
    (ref / "index_history_SP500.csv").write_text("observed_on,ticker,name,cik,gics_sector,gics_sub_industry,date_added\n" + "".join(f"{d},T{c},Company {c},{c},Information Technology,Hardware,\n" for c in range(1, companies + 1) for d in seen))


@pytest.mark.parametrize("indices", [True, False])
def test_raw_files_to_gold_in_one_call(spark, tmp_path, indices):
    raw, out = tmp_path / "raw", f"{tmp_path}/out"
    raw.mkdir()
    write_raw(raw)
    if not indices:
        (raw / "lookups" / "index_history_SP500.csv").unlink()
    run = lambda: build.build(spark, build.standard_steps(spark, TODAY, CONFIG), str(raw), out)
    first = states(run())
    optional = {"universe", "ticker_map", "overrides", "share_class", "security_event", "company_name"}
    assert {n for n, s in first.items() if s == "absent"} == optional and {s for n, s in first.items() if n not in optional} == {"built"}
    t = Tables(spark, out)
    peers = t.read("peer_stats").where("peer_level = 'sector'")
    assert t.read("tradable_financials").count() == 28
    if not indices:
        assert peers.count() == 0  # no index: no cross-section, and everything else is there
        return
    got = {(r["concept"], r["fiscal_year"]): r["n"] for r in peers.groupBy("concept", "fiscal_year").agg(F.count("*").alias("n")).collect()}
    assert got == {(c, y): 7 for c in ("revenue", "total_assets", "turnover") for y in (2022, 2023)}
    assert {r["value"] for r in peers.where("concept = 'turnover'").collect()} == {0.1}
    assert set(states(run()).values()) == {"kept", "absent"}
    path = raw / "quarters" / "2024q1" / "num.txt"
    path.write_text(path.read_text().replace("\t30\t", "\t33\t", 1))
    done = run()
    assert {d.name for d in done if d.state == "built"} == {"num_raw", "num", "suspect_fact", "tradable_financials", "debt_face", "share_class_shares", "peer_stats"}
    assert next(d for d in done if d.name == "num_raw").parts == ("2024q1",)
    assert json.dumps(Raw(spark, str(raw)).names("quarters")) == '["2023q1", "2024q1"]'


def test_files_in_order(spark, tmp_path):
    (tmp_path / "u.csv").write_text('ticker,name,index_name\nb.a,"First, Inc",SP500\nZZ,Zed,SP500\nB-A,Second,SP400\n,none,SP400\nshort\n')
    got = build.reference.load_universe(build.reference.csv_in_order(build.reference.read_lines(spark, f"{tmp_path}/u.csv"))).collect()
    assert sorted((r["ticker"], r["name"], r["index_name"]) for r in got) == [("B-A", "First, Inc", "SP500"), ("ZZ", "Zed", "SP500")]
    (tmp_path / "t.csv").write_text("320193,aapl,Apple,Nasdaq\n\nx,BAD,Bad,NYSE\n7,AAPL,Other,NYSE\n8,short\n9, brk ,Berk,NYSE\n")
    got = build.reference.load_ticker_map(build.reference.read_lines(spark, f"{tmp_path}/t.csv")).collect()
    assert sorted(tuple(r) for r in got) == [(9, "BRK", "Berk", "NYSE"), (320193, "AAPL", "Apple", "Nasdaq")]
