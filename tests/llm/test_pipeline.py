"""The pipeline's stages on planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import queries


def test_queries_name_every_operator():
    names = queries.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)


def test_pipeline_catches_planted_cases(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: " ".join("w%d" % rng.randrange(3000) for _ in range(n))
    clean = [(i, text(80)) for i in range(40)]
    item, passage = text(30), text(60)
    toxic = [(100 + i, text(40) + " you idiot. stupid moron. " + text(10)) for i in range(30)]
    copy = (200, clean[0][1])
    near = (201, clean[1][1] + " tail")
    leak = (202, text(20) + " " + item + " " + text(20))
    repeats = [(203, text(30) + " " + passage + " " + text(30)), (204, text(30) + " " + passage)]
    rows = clean + toxic + [copy, near, leak, *repeats]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100 and i < 130)) for i, _ in clean + toxic], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r for r in now.collect()}
        if name != "packing":
            assert now.columns == docs.columns
    assert set(seen["toxicity"]) == {i for i, _ in rows} - {i for i, _ in toxic}
    assert set(seen["near_duplicates"]) == set(seen["toxicity"]) - {200, 201}
    assert passage[:100] not in seen["repeated_passages"][203]["text"] and passage[:100] not in seen["repeated_passages"][204]["text"]
    assert seen["repeated_passages"][5]["text"] == clean[5][1]
    assert set(seen["benchmark_leaks"]) == set(seen["near_duplicates"]) - {202}
    assert set(seen["packing"]) == set(seen["benchmark_leaks"])
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.countDistinct("doc_id")).first()[0] == len(seen["packing"])
