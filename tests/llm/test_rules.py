"""Quality rules against a plain Python version."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import rules


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {w: windows.count(w) for w in set(windows)}
    covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in rules.SYMBOLS for c in text),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_letter_words": sum(any(c.isalpha() for c in w) for w in words),
        "n_bullet_lines": sum(x.strip(" \t\n\v\f\r")[0] in "-*•" for x in lines),
        "n_ellipsis_lines": sum(x.strip(" \t\n\v\f\r").endswith(("...", "…")) for x in lines),
    }


def test_measures_against_plain_python(spark):
    rng = random.Random(12)
    word = lambda: rng.choice(["a", "b", "c", "über", "The", "x#", "12", "...", "ñ,", "|"])
    rows = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "a a a a", "- x\n\n- x\n \n* y...\n", "x\r\nx\r\n", "w " * 5000, "z" * 100_000, "1" * 50_000]
    rows += ["".join(word() + rng.choice([" ", " ", "  ", "\n", "\n\n", "\t"]) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("w", F.lit(0))
    got = {r["doc_id"]: r["rules"] for r in rules.judge(df).collect()}
    for i, t in enumerate(rows):
        want = plain(t)
        assert {k: got[i]["measures"][k] for k in want} == want, repr(t)[:80]


def test_windows_of_any_width(spark):
    text = "p q r p q s t p q"
    for width, want in ((1, 6), (2, 6), (3, 0)):
        assert spark.range(1).select(rules.repeated_window_words(F.split(F.lit(text), " "), width)).first()[0] == want


def test_each_threshold_decides(spark):
    prose = " ".join(f"the w{i} of" for i in range(60))
    cases = {
        prose: [], "the few words": ["few_words"], prose + "".join(f" #{i}" for i in range(60)): ["symbols"], " ".join(f"v{i}" for i in range(60)): ["stop_words_en"],
        prose + " " + " ".join(str(1000 + i) for i in range(99)): ["words_without_letters"], "\n".join([prose] + ["the x"] * 4): ["repeated_lines"],
        "\n".join(f"- the apple{i} of berry{i}" for i in range(30)): ["bullets"], "\n".join(f"the apple{i} of berry{i}..." for i in range(30)): ["ellipses"],
        " ".join("the of and to" if i % 7 == 0 else "q" for i in range(99)): ["repeated_words", "short_words"], " ".join("the " + "long" * 9 + str(i) for i in range(60)): ["long_words"],
    }
    df = spark.createDataFrame([(t, "en") for t in cases], "text string, lang string")
    for r in rules.judge(df).collect():
        assert r["rules"]["failed"] == cases[r["text"]], r["text"][:60]
        assert r["rules"]["kept"] == (not cases[r["text"]])


def test_languages_and_edges(spark):
    plain_words = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(plain_words, x) for x in ("en", "ja", None, "")], "text string, lang string")
    assert {r["lang"]: r["rules"]["kept"] for r in rules.judge(df).collect()} == {"en": False, "ja": True, None: True, "": True}
    assert rules.judge(df.limit(0)).count() == 0
    assert rules.judge(df.union(df)).count() == 8
    assert rules.judge(df.withColumn("rules", F.lit(1)), out="mine").where("mine.kept").count() == 3
    with pytest.raises(ValueError):
        rules.judge(df.withColumn("rules", F.lit(1)))
    with pytest.raises(ValueError):
        rules.judge(df, rows=[])


def test_no_python_and_no_exchange(spark, tmp_path):
    spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = rules.op12_quality_rules(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert out.collect()[0].asDict() == {"doc_id": 1, "n_words": 2, "word_chars": 2, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0, "base_failed": True, "kept": False}
