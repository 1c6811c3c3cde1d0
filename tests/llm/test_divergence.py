"""Source divergence against a plain Python version with unbounded whole numbers."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence

SCHEMA = "text string, lang string, source string"


def plain(rows, least, top):
    docs = [(x or "", s or "", [w for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))]) for t, x, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for d in mine for w in set(d[2]))
        kept = {w for w, n in df.items() if n >= least}
        counts = {s: Counter(w for d in mine if d[1] == s for w in d[2] if w in kept) for s in {d[1] for d in mine}}
        shares = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        p, q = {s: shares(c) for s, c in counts.items()}, shares(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in p if o != s]
            terms = [(-f(p[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, r + 1) for r, (v, _, item) in enumerate(items)]
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "über", "Über", "É", "é", "x", "don't", "a_b", "日本", "z9z", "–"] + [f"w{c}" for c in "abcdefghij"]
    rows = []
    for _ in range(n):
        source = rng.choice(["s1", "s1", "s1", "s2", "s10", None, ""])
        rows.append((" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "en", "de", None]), source))
    return [*rows, (None, "en", "s3"), ("", "fr", "only"), ("12 34", "it", "a"), ("5", "it", "b"), ("lonely", "fr", "other"), ("big " * 20_000, "en", "s2"), *rows[:5]]


@pytest.mark.parametrize("seed,least,top,held", [(1, 10, 10, 200_000), (2, 3, 2, 4), (3, 1, 50, 200_000), (4, 10_000, 10, 50)])
def test_against_plain_python(spark, monkeypatch, seed, least, top, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("term", F.lit("clash")).withColumn("n", F.lit(1))
    got = sorted(tuple(r) for r in divergence.source_divergence(df, least_docs=least, top=top).collect())
    assert got == plain(rows, least, top)


def test_edges(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("a b", "en", "one")] * 12
    got = divergence.source_divergence(spark.createDataFrame(rows, SCHEMA)).collect()
    assert got == []  # one source: no pairs, and no term is above its language's share


def test_shares_of_large_counts_are_exact(spark):
    n, total, terms = 3_000_000_000_000, 9_000_000_000_007, 123_457
    row = spark.range(1).select(divergence.share(F.lit(n).cast("long"), F.lit(total).cast("long"), F.lit(terms).cast("long")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 2) // (total + 2 * terms)


def test_the_shuffle_holds_a_row_a_pair_and_task(spark):
    df = spark.createDataFrame(corpus(5), SCHEMA)
    plan = divergence.source_divergence(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
