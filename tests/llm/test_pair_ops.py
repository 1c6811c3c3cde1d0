"""Jaccard join, suffix dedup, embedding join, components and the pipeline against brute force."""

import hashlib
import pickle
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embeddings, jaccard, suffixdedup
from tidemark.llm.common import materialise
from tidemark.llm.components import components


def groups(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    out = {}
    for n in nodes:
        out.setdefault(find(n), []).append(n)
    return {n: min(g) for g in out.values() for n in g}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (3, 5), (5, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    want = groups(edges, {x for e in edges for x in e})
    assert got == {n: want[n] for n in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- n-gram Jaccard


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def varied(rng, base, n):
    w = base.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed, n_base=25):
    rng = random.Random(seed)
    text = lambda n: " ".join("w%d" % rng.randrange(400) for _ in range(n))
    passage, rows = text(30), []
    for _ in range(n_base):
        base = text(rng.randint(1, 120)) + (" " + passage if rng.random() < 0.5 else "")
        rows += [base] + [varied(rng, base, rng.randint(0, 4)) for _ in range(rng.randint(0, 6))]
    rows += [None, "", " \t\n", "one", "ONE", "one two", "x", "Ünï cödé tèxt", rows[0], rows[0].upper()]
    return list(enumerate(rows)), rng


@pytest.mark.parametrize("k,num,crowd", [(3, 90, 256), (3, 90, 3), (5, 80, 4), (2, 60, 256)])
def test_jaccard_against_brute_force(spark, monkeypatch, k, num, crowd):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "GROUP", 4 if crowd < 256 else 256)
    rows, _ = corpus(k * 100 + num)
    sets = {i: shingles(t, k) for i, t in rows}
    ids = list(sets)
    edges = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = groups(edges, ids)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(df, k, num, 100).collect()}
    assert {i: got[i]["component_id"] for i in ids} == want
    assert all(got[i]["n_shingles"] == len(sets[i]) for i in ids)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CROWD", 20)
    monkeypatch.setattr(jaccard, "GROUP", 16)
    rng = random.Random(9)
    base = " ".join("w%d" % i for i in range(150))
    rows = [(i, varied(rng, base, rng.randint(0, 9))) for i in range(150)]
    sets = {i: shingles(t, 3) for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == groups(edges, list(sets))


def test_a_single_set_that_meets_only_a_group(spark):
    """A family just above the crowd and a copy that lacks exactly the crowded prefix tokens, linked with one member alone."""
    base = ["w%d" % i for i in range(100)]
    rows = [" ".join([*base, f"a{i}", f"b{i}"]) for i in range(jaccard.CROWD + 4)] + [" ".join(base), " ".join(base[9:])]
    rows = list(enumerate(rows))
    sets = {i: shingles(t, 1) for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 90, 100).collect()}
    assert got == groups(edges, list(sets))


def _linked_sets(rng, n, frequent):
    """A set of n tokens, partly frequent, and one that is only just linked with it at 0.9."""
    token = lambda m: rng.integers(-(1 << 63), (1 << 63) - 1, m)
    a = np.unique(np.concatenate((rng.choice(frequent, n // 2, replace=False), token(n - n // 2))))
    drop = int(rng.integers(0, n // 19 + 1))
    add = 0
    while 100 * (n - drop) >= 90 * (n + add + 1):
        add += 1
    return a, np.sort(np.concatenate((rng.choice(a, n - drop, replace=False), token(add))))


def test_linked_sets_share_a_compound_token():
    rng = np.random.default_rng(4)
    frequent, least = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, 3000)), jaccard.bands(90, 100)
    for n in [*range(10, 60), 99, 100, 101, *least[(least > 100) & (least < 3000)], *(least[(least > 100) & (least < 3000)] - 1)]:
        for _ in range(8):
            a, b = _linked_sets(rng, int(n), frequent)
            x, y = (jaccard.part_tokens(s, frequent, least, 90, 100) for s in (a, b))
            assert np.array_equal(a, b) or np.intersect1d(x, y).size, n


def test_tokens_in_few_sets_do_not_make_pairs_that_grow_with_the_square(spark):
    """Sets of tokens that are rare, but not frequent enough for the order: shared by chance, linked with nothing."""
    counts = []
    for n in (300, 1500):
        rng = random.Random(n)
        rows = [(i, " ".join("w%d" % rng.randrange(20_000) for _ in range(200))) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(""))
        tokens = jaccard.signatures(docs, 1, 90, 100, np.empty(0, np.int64)).select(F.explode("prefix").alias("token"))
        counts.append(tokens.groupBy("token").count().agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0])
    assert counts[1] <= 5 * counts[0] + 100, counts


def test_jaccard_edges_and_stage(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "y"), (4, None, "z"), (5, "", "z"), (6, "q " * 30_000, "long"), (7, "q " * 30_000 + "r", "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = jaccard.jaccard_components(df)
    assert got.count() == 7 and {r["component_id"] for r in got.where("n_shingles = 2 AND doc_id < 6").collect()} == {1}
    kept = jaccard.keep_one_per_group(spark, df, "").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 4, 5, 6, 7]  # the row without an id is a copy of 1
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_of_one_id_with_different_texts_are_judged_apart(spark):
    rng = random.Random(3)
    a, b, c, d = (" ".join("w%d" % rng.randrange(10**6) for _ in range(40)) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (9, c), (9, d), (12, d + " tail"), (None, b), (None, "x y z"), (9, c)]
    kept = jaccard.keep_one_per_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r["doc_id"] or 99, r["text"]) for r in kept) == sorted([(1, a), (5, b), (9, c), (9, d), (99, "x y z")])
    with pytest.raises(ValueError):
        jaccard.keep_one_per_group(spark, spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, _key int"), "")


# --- suffix dedup


def brute_repeats(texts, length):
    count: dict = {}
    for t in texts:
        for a in range(len(t) - length + 1):
            count[t[a : a + length]] = count.get(t[a : a + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if count[t[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed,length,crowd", [(1, 40, 50_000), (2, 64, 50_000), (3, 400, 50_000), (1, 40, 2), (3, 400, 1)])
def test_repeats_against_brute_force(spark, monkeypatch, seed, length, crowd):
    monkeypatch.setattr(suffixdedup, "CROWD", crowd)
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [text(rng.randint(length // 2, 3 * length)) for _ in range(6)]
    rows = []
    for _ in range(40):
        rows.append("".join(rng.choice([text(rng.randint(0, length)), rng.choice(shared), text(5)]) for _ in range(rng.randint(0, 6))))
    rows += [rows[0], rows[1], "", None, "a" * (3 * length), "ab" * length, text(length), text(length - 1)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3).withColumn("key", F.lit("clash"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["h"]) for r in suffixdedup.remove_repeats(df, length).withColumn("h", F.sha2("kept", 256)).collect()}
    assert [got[i] for i in range(len(rows))] == brute_repeats([(t or "").encode() for t in rows], length)


@pytest.mark.parametrize("crowd", [50_000, 1000])
def test_one_passage_in_thousands_of_documents(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffixdedup, "CROWD", crowd)
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, near = text(450), text(700)
    rows = [text(rng.randint(0, 150)) + passage + text(rng.randint(0, 150)) for _ in range(3000)]
    for _ in range(1500):
        at = rng.randrange(700)
        rows.append(near[:at] + text(3) + near[at:])
    rows += [near] * 500 + ["xy " * 300] * 3 + ["z" + "xy " * 200]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["h"]) for r in suffixdedup.remove_repeats(df, 400).withColumn("h", F.sha2("kept", 256)).collect()}
    assert [got[i] for i in range(len(rows))] == brute_repeats([t.encode() for t in rows], 400)


def test_loser_tree_merges_with_true_prefixes():
    rng = random.Random(4)
    for k in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 30))) for _ in range(k)]
        coded = [suffixdedup.decode_run(suffixdedup.encode_run([(s, s[::-1], i) for i, s in enumerate(r)])) for r in runs]
        out = list(suffixdedup.LoserTree(coded))
        assert [x[0] for x in out] == sorted(s for r in runs for s in r)
        for a, b in zip(out, out[1:]):
            assert b[1] == suffixdedup.common_prefix(a[0], b[0]) and b[2] == b[0][::-1]


def test_passage_stage_keeps_rows_and_columns(spark):
    p = "é shared passage " * 20
    df = spark.createDataFrame([(1, "one " + p + "tail", 5), (2, "two " + p, 6), (3, None, None), (4, "alone", 5)], "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r for r in suffixdedup.cut_repeated_passages(spark, df, "").collect()}
    assert len(out) == 4 and out[3]["text"] is None and out[4]["text"] == "alone" and out[4]["n_chars"] == 5
    assert "shared passage shared" not in out[1]["text"] and out[1]["n_chars"] == len(out[1]["text"])
    with pytest.raises(ValueError):
        suffixdedup.remove_repeats(df.withColumn("kept", F.lit(1)), 100)


# --- embeddings


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 12] + rng.normal(scale=0.12, size=16)]) for i in range(300)]
    rows += [(300, rows[0][1]), (301, [0.0] * 16), (302, None), (303, [float("nan")] * 16), (304, [1.0] * 3), (305, [2.0] * 3), (306, []), (307, [None] * 16), (308, [x * 1e150 for x in rows[1][1]])]
    x = {i: np.array(v, float) for i, v in rows if v and all(e is not None and np.isfinite(e) for e in v) and any(v)}
    unit = {i: v / np.abs(v).max() for i, v in x.items()}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    edges = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    want = groups(edges, [i for i, _ in rows])
    links: dict = {}
    for a, b in edges:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = embeddings.near_vectors(df, "vec_id", "embedding", 0.95, block=64).collect()
    assert len(got) == len(rows) and len(edges) > 300
    for r in got:
        assert (r["n_links"], r["component_id"], r["kept"]) == (links.get(r["id"], 0), want[r["id"]], want[r["id"]] == r["id"])


def test_embeddings_skip_distant_blocks_and_join_copies_once(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    x = np.repeat(centres, 60, axis=0) + rng.normal(scale=0.02, size=(2400, 24))
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(3000 + i, x[7].tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    known = embeddings.usable(df, "vec_id", "embedding")
    axes, eps = embeddings.principal_axes(known, 24), (2 - 2 * 0.95) ** 0.5
    order = materialise(embeddings.grid_order(known.select("id", "x"), axes, eps, 64), "order")
    near = embeddings.near_blocks(order, eps)
    opened, n = embeddings.open_pairs(near, embeddings.intervals(order, axes), 24, eps).count(), order.agg(F.max("block")).first()[0] + 1
    assert opened < 0.35 * n * (n + 1) / 2
    got = {r["id"]: r for r in embeddings.near_vectors(df, "vec_id", "embedding", block=64).collect()}
    assert all(got[i]["n_links"] == (559 if i >= 3000 or i // 60 == 0 else 59) and got[i]["component_id"] == (0 if i >= 3000 else i // 60 * 60) for i, _ in rows)


def test_embeddings_edges(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding").count() == 0
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [0.0, 1.0])]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()
    assert sorted((r["id"] or -1, r["n_links"], r["component_id"]) for r in got) == [(-1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2)]


def test_a_task_of_repeated_passages_holds_little_at_once():
    """An executor has little memory beside its heap: kernels take texts and windows in small pieces, also in long batches."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = pa.array([rng.integers(97, 123, 4096, np.uint8).tobytes().decode() for _ in range(1000)])
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    before = [bytes(x) for x in rng.integers(97, 99, (3000, 360), np.uint8)]
    shared = rng.integers(32, 400, 3000)
    low, high = np.zeros(3000, int), np.full(3000, 360)

    def peak(work):
        work()  # tables of powers stay
        tracemalloc.start()
        work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / 2**20

    def scan():
        for _ in suffixdedup._batches(batch, 200):
            pass

    assert peak(scan) < 50
    assert peak(lambda: suffixdedup.repeated_windows(shared, before, low, high, 400)) < 40


def test_told_places_leave_a_run_before_it_is_full():
    run, key = suffixdedup.Run(), b"k" * 16
    for i in range(12_000):
        run.tell(key, 2000 * i, 2000 * i + 200)
    told = [x for part, blob in run.places() for x in pickle.loads(blob)]
    assert told == [(key, 2000 * i, 2000 * i + 200) for i in range(12_000)] and not run.told
    run.tell(key, 5, 300)
    assert [x for _, blob in run.places() for x in pickle.loads(blob)] == [(key, 5, 300)]
