"""Toxicity, URL filter, quality, WARC, sharding, packing, decontamination on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, packing, quality, sharding, toxicity, urlfilter, warc
from tidemark.llm.common import materialise, scratch_path

TEXTS = [(1, "a b c"), (2, None), (3, ""), (4, "word " * 40_000), (1, "a b c"), (None, "no id"), (6, "é\u2028x 🙂")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"score_": F.lit(1), "bucket": F.lit("clash"), "_spans": F.lit(2)})


def empty(spark, schema="doc_id long, text string"):
    return spark.createDataFrame([], schema)


# --- toxicity


def test_machine_composes_facts_of_a_clause():
    words = toxicity.lexicon()
    x = toxicity.features(["you are an idiot", "what scum.", "i will kill you", "they kill time", "you are not an idiot", "he said idiot", "all fine", None, ""], words)
    names = ["one", *toxicity.PATTERNS]
    hits = [[n for n, v in zip(names[1:], row[1:]) if v] for row in x]
    assert hits == [["directed insult"], ["insult"], ["threat"], ["threat"], ["negated"], ["reported"], [], [], []]


def test_without_labels_an_aimed_clause_decides_and_a_lone_word_does_not():
    model = toxicity.Model(toxicity.lexicon(), toxicity.PRIOR)
    score = lambda t: float(model.score([t])[0])
    assert score("you are an idiot") > 0.5 and score("i will kill you.") > 0.5
    assert all(score(t) < 0.5 for t in ("idiot", "the word idiot", "you are not an idiot", "he said idiot", "kill time", "you. idiot."))


def test_clauses_beat_a_count_of_listed_words(spark):
    rng = random.Random(8)
    fill = lambda n: " ".join(rng.choice(["sun", "tree", "walk", "table", "blue", "song"]) for _ in range(n))
    toxic = ["you are an idiot", "they are scum", "i will hurt you", "you moron"]
    clean = ["you are not an idiot", "he said you are scum", "reported that he will hurt you", "never a moron", "kill the lights"]
    rows = [(i, f"{fill(6)}. {rng.choice(toxic if i % 2 else clean)}. {fill(5)}.") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    held = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((s >= 0.5) == (i % 2 == 1) for (i, _), s in zip(held, model.score([t for _, t in held])))
    words = {w for w, k in model.words.items() if k in (toxicity.INSULT, toxicity.THREAT)}
    count = [sum(w in words for w in toxicity.TOKEN.findall(t)) for _, t in held]
    best = max(sum((c >= k) == (i % 2 == 1) for (i, _), c in zip(held, count)) for k in range(4))
    assert len(held) > 50 and right == len(held) and best < 0.75 * len(held)


def test_negation_reaches_only_a_few_tokens():
    words = toxicity.lexicon()
    far = toxicity.features(["not one two three four five idiot"], words)[0]
    near = toxicity.features(["not one idiot"], words)[0]
    assert far[1] > 0 and far[4] == 0 and near[4] > 0


def test_learned_words_weights_and_held_out(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join([word() for _ in range(20)] + (["zzgrub"] if bad else []))))
        labels.append((i, int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "zzgrub" in model.words
    scored = toxicity.score_documents(d, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).where("held").collect()
    assert scored and all((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in scored)
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)


def test_toxicity_edges(spark, docs):
    model = toxicity.fit(empty(spark), empty(spark, "doc_id long, toxic int"))
    rows = toxicity.score_documents(docs, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] < 0.5 for r in rows) and rows[0]["bucket"] == "clash"
    assert toxicity.score_documents(empty(spark), model).count() == 0
    with pytest.raises(ValueError):
        toxicity.score_documents(docs.withColumn("score", F.lit(0)), model)


# --- url filter


def test_cascade_is_exact_over_its_universe(spark):
    keys = [(f"host{i}.example", i % 7 == 0) for i in range(3000)]
    cascade = urlfilter.build_cascade(spark.createDataFrame(keys, "key string, listed boolean"))
    got = spark.createDataFrame(keys, "key string, listed boolean").withColumn("in", cascade.contains(F.col("key"))).where("listed <> `in`")
    assert got.count() == 0 and len(cascade.levels) >= 2
    assert spark.createDataFrame([(None,)], "key string").select(cascade.contains(F.col("key"))).first()[0] is False


@pytest.mark.parametrize("listed", [True, False])
def test_cascade_of_all_or_nothing(spark, listed):
    u = spark.createDataFrame([(f"k{i}", listed) for i in range(50)], "key string, listed boolean")
    cascade = urlfilter.build_cascade(u)
    assert u.where(cascade.contains(F.col("key"))).count() == (50 if listed else 0)


def test_long_lists_are_split_and_stay_exact(spark):
    rng = random.Random(4)
    keys = [(f"h{rng.randrange(10**9)}", rng.random() < 0.3) for _ in range(4000)]
    u = spark.createDataFrame([*keys, (None, True), keys[0]], "key string, listed boolean")
    cascade = urlfilter.build_cascade(u, max_bits=4096)
    assert len(cascade.parts) >= 3
    assert u.where("key is not null").where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0


def test_url_filter_edges(spark):
    pages = spark.createDataFrame([(1, "http://spam-x.io/a"), (1, "http://spam-x.io/a"), (2, None), (3, "http://y.com/en/q"), (4, "http://b.example.com/en/7" + "z" * 50_000), (5, "")], "page_id long, url string")
    cascade = urlfilter.build_cascade(spark.createDataFrame([("spam-x.io", True), ("y.com", False), ("", False)], "key string, listed boolean"))
    got = [(r["page_id"], r["host"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages, "url", cascade).collect()]
    assert sorted(got, key=repr) == sorted([(1, "spam-x.io", None, "block")] * 2 + [(2, "", None, "allow"), (3, "y.com", "com/en/", "block"), (4, "b.example.com", "example.com/en/7", "allow"), (5, "", None, "allow")], key=repr)
    assert urlfilter.filter_urls(pages.limit(0), "url", cascade).count() == 0
    with pytest.raises(ValueError):
        urlfilter.filter_urls(pages.withColumn("rule", F.lit(1)), "url", cascade)


def test_rules_and_parts(spark):
    rows = [("http://A.Example.com/en/7x?q", "a.example.com", "/en/7x", "example.com/en/7"), ("http://com/en/", "com", "/en/", "com/en/"), ("x://telecom/en/", "telecom", "/en/", None), ("no scheme", "", "", None), (None, "", "", None), ("a://b://c/d#e", "b:", "//c/d", None), ("http://q.net?x/de/", "q.net", "", None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "url string")
    host, path = urlfilter.url_parts(F.col("url"))
    got = df.select(host.alias("h"), path.alias("p")).withColumn("r", urlfilter.match_rules(F.col("h"), F.col("p"))[0]).collect()
    assert [(r["h"], r["p"], r["r"]) for r in got] == [r[1:] for r in rows]


# --- quality


TRUSTED = [("en", "the cat sat on the mat. " * 30), ("en", "a hat for the cat, a bat for the rat"), ("de", "der hund lief durch den wald. " * 30), (None, "xÄx"), ("en", None), ("fr", "")]


def brute_kneser_ney(texts):
    """probability(gram) under the same model, from plain dictionaries."""
    n_max, counts = quality.ORDER, {}
    counts[n_max] = Counter(g for t in texts for g in padded_grams(t))
    for n in range(n_max - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts = {}
    for n, c in counts.items():
        have = Counter(c.values())
        y = have[1] / max(have[1] + 2 * have[2], 1)
        discounts[n] = [0] + [max(0.05, min(i - 0.05, i - (i + 1) * y * have[i + 1] / max(have[i], 1))) for i in (1, 2, 3)]

    def probability(gram):
        n = len(gram)
        lower = probability(gram[1:]) if n > 1 else 1 / 256
        after = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not after:
            return lower
        off = {g: discounts[n][min(c, 3)] for g, c in after.items()}
        own = after[gram] - off[gram] if gram in after else 0
        return (own + sum(off.values()) * lower) / sum(after.values())

    return probability


def padded_grams(text):
    raw = b" " * (quality.ORDER - 1) + (text or "").encode()
    return [raw[i : i + quality.ORDER] for i in range(len(raw) - quality.ORDER + 1)]


def test_perplexity_is_that_of_a_brute_force_model(spark):
    model = quality.fit(spark.createDataFrame(TRUSTED, "lang string, text string"))
    docs = [(1, "the mat sat on the cat.", "en"), (2, "%%% ###!! ZZQ", "en"), (3, "", "en"), (4, None, None), (5, "der Hund, ÄÖ", "de"), (6, "le chat", "fr"), (7, "x", None), (7, "x", None)]
    rows = quality.perplexities(spark.createDataFrame(docs, "doc_id long, text string, lang string"), model).collect()
    assert len(rows) == len(docs) and {r["text"] for r in rows} == {d[1] for d in docs}
    p = {r["doc_id"]: r["perplexity"] for r in rows}
    every = brute_kneser_ney([t for _, t in TRUSTED])
    for doc, text, lang in docs:
        if not text:
            assert p[doc] is None
            continue
        mine = [t for k, t in TRUSTED if k == lang and lang]
        n, own = sum(len((t or "").encode()) for t in mine), brute_kneser_ney(mine)
        w = n / (n + quality.PRIOR_BYTES)
        logs = [math.log((w * own(g) if n else 0) + (1 - w) * every(g)) for g in padded_grams(text)]
        assert math.isclose(p[doc], math.exp(-sum(logs) / len(logs)), rel_tol=1e-9), doc
    assert p[1] < p[2]


def test_kneser_ney_sums_to_one_and_grows(spark):
    model = quality.fit(spark.createDataFrame(TRUSTED, "lang string, text string"))
    contexts = [b"the ", b"qqqq", b"    ", b" der"]
    asked = [(lang, int.from_bytes(c + bytes([i]), "big")) for lang in ("en", "de", quality.POOLED) for c in contexts for i in range(256)]
    rows = quality.probabilities(spark.createDataFrame(asked, "lang string, code long"), model).collect()
    sums = Counter()
    for r in rows:
        sums[r["lang"], r["code"] >> 8] += math.exp(r["logp"])
    assert len(sums) == 12 and all(abs(v - 1) < 1e-9 for v in sums.values())
    more = quality.fit(spark.createDataFrame([*TRUSTED, ("en", "words never seen before")], "lang string, text string"))
    assert more.seen[quality.ORDER].count() > model.seen[quality.ORDER].count()


@pytest.mark.parametrize("sent", [0, 40, 1000])
def test_perplexity_moves_no_text_and_is_whole_however_few_answers_are_sent(spark, monkeypatch, sent):
    written, write = [], quality.materialise
    monkeypatch.setattr(quality, "materialise", lambda df, *a, **b: written.append(df.columns) or write(df, *a, **b))
    monkeypatch.setattr(quality, "FREQUENT", sent, raising=False)
    model = quality.fit(spark.createDataFrame(TRUSTED, "lang string, text string"))
    docs = [(i, text, lang) for i, (text, lang) in enumerate([("the mat sat on the cat.", "en"), ("%%% ###!! ZZQ", "en"), ("", "en"), ("der Hund, ÄÖ", "de"), ("x", None)] * 2)]
    p = {r["doc_id"]: r["perplexity"] for r in quality.perplexities(spark.createDataFrame(docs, "doc_id long, text string, lang string"), model, keep_text=False).collect()}
    assert len(p) == len(docs) and not any("text" in columns for columns in written)
    every = brute_kneser_ney([t for _, t in TRUSTED])
    for doc, text, lang in docs:
        mine = [t for k, t in TRUSTED if k == lang and lang]
        n, own = sum(len((t or "").encode()) for t in mine), brute_kneser_ney(mine)
        w = n / (n + quality.PRIOR_BYTES)
        logs = [math.log((w * own(g) if n else 0) + (1 - w) * every(g)) for g in padded_grams(text)]
        assert p[doc] is None if not text else math.isclose(p[doc], math.exp(-sum(logs) / len(logs)), rel_tol=1e-9), doc


def trusted_corpus(n):
    rng = random.Random(5)
    words = [("".join(rng.choice("abcdefgh") for _ in range(4))) for _ in range(60)]
    good = [(i, " ".join(rng.choice(words) for _ in range(80)), "en" if i % 40 else "xx") for i in range(n)]
    return good, [(n + i, "".join(rng.choice("QXZ#%&0123 ") for _ in range(300)), "en" if i % 2 else "xx") for i in range(6)]


def test_judge_keeps_trusted_like_texts_also_of_a_rare_language(spark, monkeypatch):
    monkeypatch.setattr(quality, "BATCH_TEXT", 2000)  # many batches
    good, bad = trusted_corpus(200)
    d = spark.createDataFrame([*good, *bad, (1000, good[3][1] * 200, "en"), (1001, good[5][1], None)], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["keep"] for r in quality.judge(d, spark.createDataFrame([(i,) for i, _, _ in good], "doc_id long")).collect()}
    assert sum(out[i] for i, _, _ in good) >= 196 and not any(out[i] for i, _, _ in bad) and out[1000] and out[1001]


def test_judge_edges(spark):
    good, _ = trusted_corpus(20)
    d = spark.createDataFrame([*good, good[1], (100, None, "en"), (101, "", None), (None, good[2][1], None)], "doc_id long, text string, lang string").withColumn("n", F.lit("clash"))
    out = quality.judge(d, spark.createDataFrame([(i,) for i, _, _ in good] + [(None,)], "doc_id long")).collect()
    assert len(out) == 24 and all(r["n"] == "clash" for r in out)
    assert [r["keep"] for r in out if r["doc_id"] in (100, 101)] == [False, False] and len({r["keep"] for r in out if r["doc_id"] == 1}) == 1
    none = quality.judge(d, spark.createDataFrame([], "doc_id long")).collect()
    assert len(none) == 24 and not any(r["keep"] or r["perplexity"] for r in none)
    assert quality.judge(d.limit(0), spark.createDataFrame([(1,)], "doc_id long")).count() == 0
    for taken in ("perplexity", "threshold", "keep", "_batch"):
        with pytest.raises(ValueError):
            quality.judge(d.withColumn(taken, F.lit(1)), spark.createDataFrame([(1,)], "doc_id long"))


# --- WARC


def test_warc_round_trip(spark):
    long = "x" * 1500
    rows = [(1, "http://a/\r\nb", long), (2, "u", long), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "é" * 3_000_000), (None, "u", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assigned = warc.assign_revisits(pages, "page_id", "html").select("page_id", "url", "payload", "digest", "refers_to", "size")
    raw = materialise(warc.write_archives(assigned, scratch_path(spark, "warc")), "a")
    single = materialise(warc.normalise_archives(raw, scratch_path(spark, "members")), "b")
    got = {r["page_id"]: r for r in warc.read_archives(single).collect()}
    assert len(got) == 8 and single.agg(F.sum("records")).first()[0] == 8
    for i, _, html in rows:
        payload = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
    assert got[2]["record_type"] == "response" and got[2]["refers_to"] is None
    assert (got[1]["record_type"], got[1]["refers_to"], got[1]["stored_bytes"]) == ("revisit", 2, 0) and got[None]["refers_to"] == 2
    assert got[5]["record_type"] == got[6]["record_type"] == "response"


def test_inflate_many_members_and_damage():
    import io

    one = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    data = warc._member(one, 1) + warc._member(one, 9)
    assert list(warc.split_records(warc.inflate(io.BytesIO(data)))) == [one, one]
    with pytest.raises(ValueError):
        list(warc.inflate(io.BytesIO(data[:-4])))
    with pytest.raises(ValueError):
        list(warc.split_records([one[:-6]]))


def test_warc_empty(spark):
    none = warc.assign_revisits(empty(spark, "page_id long, url string, html string"), "page_id", "html")
    raw = materialise(warc.write_archives(none.select("page_id", "url", "payload", "digest", "refers_to", "size"), scratch_path(spark, "warc")), "e")
    assert warc.read_archives(warc.normalise_archives(raw, scratch_path(spark, "m"))).count() == 0


# --- sharding


def test_sharding_laws(spark):
    rows = [(i, (i * 37) % 500 + 1, i % 3) for i in range(2000)] + [(5, 186, 2), (None, 1, 0), (None, 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, size long, record int")
    out = sharding.external_shuffle(df, "doc_id", "size", 16, bucket_bytes=4096)
    got = out.collect()
    assert len(got) == len(rows)
    by: dict = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by) == 16
    assert len({r["shard"] for r in got if r["doc_id"] == 5}) == 1 and len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    assert sorted((r["doc_id"] or -1, r["slot"], r["shard"]) for r in out.collect()) == sorted((r["doc_id"] or -1, r["slot"], r["shard"]) for r in got)
    order = [r["doc_id"] for r in sorted((r for r in got if r["shard"] == 3), key=lambda r: r["slot"])]
    assert order != sorted(order, key=lambda x: x or -1)


def test_sharding_writes_whole_documents(spark, monkeypatch, tmp_path):
    rows = [(i, "é %d " % i * (i % 50), "en") for i in range(600)] + [(5, None, "de"), (None, "no id", "fr"), (7, "twice", "en"), (7, "twice", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    paths, shuffle, write = [], sharding.external_shuffle, sharding.write_shards
    monkeypatch.setattr(sharding, "external_shuffle", lambda *a: shuffle(*a, bucket_bytes=1024))
    monkeypatch.setattr(sharding, "write_shards", lambda df, path: (paths.append(path), write(df, path)))
    got = sharding.op6_sharding(spark, str(tmp_path)).collect()
    want = sorted((repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    assert len(paths) == 1
    records, place = [], {(r["shard"], r["slot"]): r["doc_id"] for r in got}
    for shard in range(16):
        files = sorted(Path(paths[0].removeprefix("file://")).glob(f"shard={shard}/*.parquet"))
        found = [r for f in files for r in pq.ParquetFile(f).read().to_pylist()]
        assert [r["slot"] for r in found] == list(range(len(found)))
        assert all(place[shard, r["slot"]] == r["doc_id"] for r in found)
        records += [(r["doc_id"], r["text"], r["lang"]) for r in found]
    assert sorted(records, key=repr) == sorted(rows, key=repr)


def test_sharding_edges(spark):
    assert sharding.external_shuffle(empty(spark, "doc_id long, size long"), "doc_id", "size", 4).count() == 0
    with pytest.raises(ValueError):
        sharding.external_shuffle(spark.range(1).selectExpr("id doc_id", "1L size", "1 shard"), "doc_id", "size", 4)


# --- packing


def brute_cost(at, pen, window):
    best = {0: 0}
    for j in range(1, len(at)):
        best[j] = min(best[i] + pen[j] + window - (at[j] - at[i]) for i in range(j) if at[j] - at[i] <= window and i in best)
    return best[len(at) - 1]


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_optimal(seed):
    rng = np.random.default_rng(seed)
    at = np.concatenate(([0], np.cumsum(rng.integers(1, 9, 60))))
    pen = rng.integers(0, 12, len(at))
    cuts = packing.best_cuts(at, pen, 16)
    assert cuts[-1] == at[-1] and max(np.diff([0, *cuts])) <= 16
    where = {int(p): i for i, p in enumerate(at)}
    cost = sum(int(pen[where[c]]) + 16 - (c - p) for p, c in zip([0, *cuts], cuts))
    assert cost == brute_cost(at.tolist(), pen.tolist(), 16)


def test_packing_pieces(spark, docs):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    rows = packing.pack_documents(docs, path, window=64, with_ids=True).collect()
    own = Tokenizer.from_file(path)
    sizes: dict = {}
    for i, t in TEXTS:
        sizes[i] = sizes.get(i, 0) + len(own.encode(t or "", add_special_tokens=False).ids) + 1
    assert {k: sum(r["length"] for r in rows if r["doc_id"] == k) for k in {r["doc_id"] for r in rows}} == sizes
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    seqs: dict = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 64
    assert packing.pack_documents(empty(spark), path).count() == 0


def test_word_ids_equal_the_tokenizers_own():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    own, words = Tokenizer.from_file(path), packing.WordIds(path)
    texts = ["Hello, World. It's 3.14!! (x)...\n\tno", "ÉCOLE a\u0301 b", "<|endoftext|> a<|startoftext|>b .", "a . b , c.d, e.\nf", " ", "", "l'été\u00a0là. ½ 中文。x"]
    got = words.encode([t.encode() for t in texts])
    assert [x.tolist() for x, _ in got] == [own.encode(t, add_special_tokens=False).ids for t in texts]


# --- decontamination


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        k, op = rng.randrange(len(words)), rng.random()
        if op < 0.4:
            words[k] = f"zz{rng.randrange(999)}"
        elif op < 0.7:
            words.insert(k, f"yy{rng.randrange(999)}")
        else:
            del words[k]
    return words


def edit_distance_in(item, doc):
    """Least edits between the item and any run of words, by the plain table."""
    row = [0] * (len(doc) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(doc, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_alignment_equals_plain_table():
    rng = np.random.default_rng(5)
    for _ in range(40):
        item, doc = rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 20)).astype(np.uint64)
        assert decontam.best_alignment(item, doc)[0] == edit_distance_in(item.tolist(), doc.tolist())


def test_leaks_against_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "w%d" % min(int(rng.expovariate(0.05)), 200)
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 40)))) for i in range(15)]
    docs = []
    for d in range(120):
        base = [word() for _ in range(rng.randint(0, 120))]
        if d % 3 == 0:
            src = rng.choice(items)[1].split()
            k = rng.randint(0, len(base))
            base = base[:k] + edited(src, rng.randint(0, int(0.2 * len(src)) + 2), rng) + base[k:]
        docs.append((d, " ".join(base)))
    want = {(d, i) for d, t in docs for i, x in items if edit_distance_in(x.split(), t.split()) <= int(0.2 * len(x.split()))}
    found = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["x"]["item_id"]) for r in found.select("doc_id", F.explode("leaks").alias("x")).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 25


def test_leaks_in_blocks_and_edges(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "A, B. c!"), (1, "a b c")], "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK", 2)
    rows = decontam.find_leaks(docs, bench).collect()
    assert len(rows) == len(TEXTS)
    assert sorted(x["item_id"] for x in rows[0]["leaks"]) == [1, 1, 4] and rows[1]["leaks"] == rows[2]["leaks"] == []
    assert decontam.find_leaks(empty(spark), bench).count() == 0
    assert all(r["leaks"] == [] for r in decontam.find_leaks(docs, empty(spark, "item_id long, text string")).collect())
