"""Quality by perplexity under an interpolated modified Kneser-Ney model of byte n-grams, per language.

An n-gram is its bytes packed into a long, so nothing is hashed.  Counts of trusted text are sharded over Spark by
(language, n-gram) and grow with it; joins of each order's counts with its contexts and discounts give the parts of the
interpolation.  Stretches of about 16 MB of text send each n-gram once, and the distinct n-grams meet the count tables of
every order in joins.  The most frequent answers, a fixed number, are sent to all tasks, which sum a document's log
probabilities where its text is read; its other n-grams are joined with the other answers, and no text is moved.  No key
of these joins is hot: a context has at most 256 successors, and an n-gram that is not sent is rare.
A language's model is mixed with that of all languages by the trusted bytes behind it, and documents are kept up to a
quantile of trusted documents that were left out of the fit, drawn to the quantile of all languages by their number.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import chunked, discard, materialise, slices, small_batches, table, utf8

#: Bytes of an n-gram; up to 7 fit into a long.
ORDER = 5
#: Text of one stretch whose n-grams are counted together.
BATCH_TEXT = 16 << 20
#: Answers sent to every task at most (16 bytes each), the most asked ones; the others are joined.
FREQUENT = 500_000
#: Trusted bytes at which a language's own model and the pooled one weigh alike.
PRIOR_BYTES = 20_000
#: Left-out trusted documents keep up to this quantile; the pooled quantile counts like so many documents of a language.
QUANTILE, PRIOR_DOCS = 0.99, 30
#: One of so many trusted documents is left out of the fit and sets thresholds.
FOLDS = 5
#: Bits per byte are compared at so many digits, which bounds the distinct values of a sorted count.
DIGITS = 3
#: Trusted ids that may be broadcast (4 MB of longs).
MAX_SENT = 500_000
#: Name of the model of all languages together; documents without a language use it alone.
POOLED = "*"


def _low(n: int) -> int:
    return (1 << 8 * n) - 1


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, blanks standing before each text, and the bytes per text."""
    pad, sizes = b" " * (ORDER - 1), np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(pad.join([b"", *texts]), np.uint8)
    n = len(buf) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64), sizes
    out = np.zeros(n, np.int64)
    for j in range(ORDER):
        out = (out << 8) | buf[j : j + n]
    across = (np.cumsum(sizes + ORDER - 1)[:-1, None] - np.arange(1, ORDER)).ravel()
    return np.delete(out, across), sizes


def _distinct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of some texts with their counts, a slice of about 1 MB at a time."""
    parts = [np.unique(grams(texts[s])[0], return_counts=True) for s in chunked(texts, 1 << 20)]
    code, back = np.unique(np.concatenate([np.zeros(0, np.int64), *(c for c, _ in parts)]), return_inverse=True)
    return code, np.bincount(back, np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)]), len(code)).astype(np.int64)


def _counting():
    """Counts n-grams of (lang, text) by stretches of about BATCH_TEXT bytes: (lang, code, count)."""

    def count(batches):
        import pyarrow as pa

        def flush():
            for lang, texts in held.items():
                code, c = _distinct(texts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(c)], names=["lang", "code", "n"])

        held, size = {}, 0
        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                held.setdefault(lang if lang is not None else POOLED, []).append(text)
                size += len(text)
                if size > BATCH_TEXT:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return count


def count_ngrams(trusted: DataFrame) -> DataFrame:
    """(lang, code, c) of all text of ``trusted`` (lang, text), and of all languages together under POOLED."""
    parts = trusted.select("lang", "text").mapInArrow(_counting(), "lang string, code long, n long")
    named = materialise(parts.groupBy("lang", "code").agg(F.sum("n").alias("c")), "counts")
    pooled = named.groupBy("code").agg(F.sum("c").alias("c")).select(F.lit(POOLED).alias("lang"), "code", "c")
    counts = materialise(named.where(F.col("lang") != POOLED).unionByName(pooled), "ngrams")
    discard(named)
    return counts


class Model(NamedTuple):
    """Tables in the shared folder: per order the probabilities of seen n-grams (lang, code, p) and the weight that their
    contexts leave to the lower order (lang, context, g); the trusted bytes of each language."""

    seen: dict[int, DataFrame]
    contexts: dict[int, DataFrame]
    sizes: DataFrame


def interpolate(counts: DataFrame) -> Model:
    """Model of (lang, code, c).  Lower orders count distinct preceding bytes instead of occurrences; the end of a seen
    n-gram is seen in the lower order, so an order is one join with its contexts and one with the order below."""
    sizes = materialise(counts.groupBy("lang").agg(F.sum("c").cast("double").alias("bytes")), "sizes")
    levels, seen, contexts = {ORDER: counts}, {}, {}
    for n in range(ORDER - 1, 0, -1):
        levels[n] = materialise(levels[n + 1].groupBy("lang", F.col("code").bitwiseAND(F.lit(_low(n))).alias("code")).agg(F.count("*").alias("c")), f"order{n}")
    for n in range(1, ORDER + 1):
        have = lambda k: F.sum((F.col("c") == k).cast("long")).alias(f"n{k}")
        totals = levels[n].groupBy("lang").agg(*[have(k) for k in (1, 2, 3, 4)])
        share = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1))
        discount = [F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * share * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1)))).alias(f"d{i}") for i in (1, 2, 3)]
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = levels[n].join(totals.select("lang", *discount), "lang").select("lang", "code", "c", d.alias("d"), F.shiftright("code", 8).alias("context"))
        left = rows.groupBy("lang", "context").agg(F.sum("c").alias("all"), F.sum("d").alias("off"))
        parts = rows.join(left, ["lang", "context"])
        if n == 1:
            parts = parts.withColumn("lower", F.lit(1 / 256))
        else:
            below = seen[n - 1].select("lang", F.col("code").alias("tail"), F.col("p").alias("lower"))
            parts = parts.withColumn("tail", F.col("code").bitwiseAND(F.lit(_low(n - 1)))).join(below, ["lang", "tail"])
        seen[n] = materialise(parts.select("lang", "code", ((F.col("c") - F.col("d") + F.col("off") * F.col("lower")) / F.col("all")).alias("p")), f"seen{n}")
        contexts[n] = materialise(left.select("lang", "context", (F.col("off") / F.col("all")).alias("g")), f"contexts{n}")
    discard(*levels.values())
    return Model(seen, contexts, sizes)


def fit(trusted: DataFrame) -> Model:
    """Model of (lang, text); nulls and empty texts count nothing, a null language only in the pooled model.  Its tables grow
    with the distinct n-grams of the trusted text."""
    return interpolate(count_ngrams(trusted))


def probabilities(asked: DataFrame, model: Model) -> DataFrame:
    """(lang, code, logp): natural log of the probability of each n-gram's last byte after the others.

    ``asked`` holds distinct (lang, code).  An n-gram ends at the longest order that has seen it; only those an order has not
    seen go on to its contexts and to the order below.  ``logp`` is null where the model has no text at all.
    """
    rest = asked.unionByName(asked.select(F.lit(POOLED).alias("lang"), "code")).distinct().withColumn("weight", F.lit(1.0))
    found = None
    for n in range(ORDER, 0, -1):
        end = F.col("code").bitwiseAND(F.lit(_low(n)))
        seen = model.seen[n].select("lang", F.col("code").alias("end"), "p")
        step = materialise(rest.withColumn("end", end).join(seen, ["lang", "end"], "left").select("lang", "code", "weight", "p"), f"asked{n}")
        hits = step.where("p IS NOT NULL").select("lang", "code", (F.col("weight") * F.col("p")).alias("p"))
        found = hits if found is None else found.unionByName(hits)
        missed = step.where("p IS NULL").withColumn("context", F.shiftright(end, 8)).join(model.contexts[n], ["lang", "context"], "left")
        left = F.coalesce("g", F.lit(1.0)) if n > 1 else F.col("g") / 256  # null for a language without any text
        rest = missed.select("lang", "code", (F.col("weight") * left).alias("weight"))
    p = found.unionByName(rest.withColumnRenamed("weight", "p"))
    own = F.coalesce(F.col("bytes") / (F.col("bytes") + PRIOR_BYTES), F.lit(0.0))
    pooled = p.where(F.col("lang") == POOLED).select("code", F.col("p").alias("all"))
    mixed = p.join(pooled, "code").join(model.sizes, "lang", "left")
    return mixed.select("lang", "code", F.log(F.coalesce(own * F.col("p"), F.lit(0.0)) + (1 - own) * F.col("all")).alias("logp"))


def _refuse(df: DataFrame, *names: str) -> None:
    taken = [c for c in df.columns if c.lower() in names]
    if taken:
        raise ValueError(f"columns of the operator are in use: {taken}")


def requests(docs: DataFrame) -> DataFrame:
    """(lang, code, n): the distinct n-grams of the texts of ``docs`` (lang, text) and how often they occur, a null language
    under POOLED."""
    parts = docs.select("lang", "text").mapInArrow(_counting(), "lang string, code long, n long")
    return materialise(parts.groupBy("lang", "code").agg(F.sum("n").alias("n")), "requests")


def _frequent(answers: DataFrame) -> tuple[DataFrame, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """The answers that stay with Spark, and at most FREQUENT of the most asked ones as sorted arrays per language."""
    import pyarrow.compute as pc

    binned = answers.withColumn("bin", F.floor(F.log2("n") * 16).cast("int"))
    # the least bin from which on all n-grams fit; a few hundred bins reach the driver
    cut, total = 1 << 30, 0
    for r in sorted(binned.groupBy("bin").count().collect(), reverse=True):
        total += r["count"]
        if total > FREQUENT:
            break
        cut = r["bin"]
    top, sent = binned.where(F.col("bin") >= cut).select("lang", "code", "logp").toArrow(), {}
    for lang in pc.unique(top["lang"]).to_pylist():
        mine = top.filter(pc.equal(top["lang"], lang))
        code, logp = mine["code"].to_numpy(), mine["logp"].to_numpy()
        order = np.argsort(code)
        sent[lang] = code[order], logp[order]
    return binned.where(F.col("bin") < cut).drop("bin"), sent


def perplexities(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """``docs`` with perplexity, on request without the text; null for null and empty texts (and for all, without any
    trusted text).  The texts are read twice.  Columns called perplexity, _row, _lang, _size, _sum or _rest are refused."""
    _refuse(docs, "perplexity", "_row", "_lang", "_size", "_sum", "_rest")
    small_batches(docs.sparkSession)
    asked = requests(docs)
    told = probabilities(asked.select("lang", "code"), model)
    # no answer at all (a model without text) is not a number, which no sum loses
    answers = materialise(asked.join(told, ["lang", "code"]).withColumn("logp", F.coalesce("logp", F.lit(float("nan")))), "answers")
    discard(asked)
    rare, frequent = _frequent(answers)
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    kept = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    at, lang_at, places = docs.columns.index("text"), docs.columns.index("lang"), [docs.columns.index(f.name) for f in kept]
    rest = T.ArrayType(T.StructType([T.StructField("code", T.LongType()), T.StructField("n", T.LongType())]))
    own = [T.StructField("_row", T.LongType()), T.StructField("_lang", T.StringType()), T.StructField("_size", T.LongType()), T.StructField("_sum", T.DoubleType()), T.StructField("_rest", rest)]
    schema = T.StructType([*kept, *own])

    def score(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        row, empty = TaskContext.get().partitionId() << 32, (np.zeros(0, np.int64), np.zeros(0))
        for b in slices(batches):
            langs = np.array([x if x is not None else POOLED for x in b.column(lang_at).to_pylist()], object)
            texts = utf8(b.column(at))
            total, lost = np.zeros(len(langs)), [None] * len(langs)
            for lang in set(langs):
                codes, logs = sent.value.get(lang, empty)
                rows = np.flatnonzero(langs == lang)
                mine = [texts[i] for i in rows]
                for s in chunked(mine, 1 << 20):
                    ends, sizes = grams(mine[s])
                    place = np.minimum(np.searchsorted(codes, ends), max(len(codes) - 1, 0))
                    known = codes[place] == ends if len(codes) else np.zeros(len(ends), bool)
                    upto = np.cumsum(sizes)
                    for i, lo, hi in zip(rows[s], upto - sizes, upto):
                        have = known[lo:hi]
                        total[i] = logs[place[lo:hi][have]].sum()
                        if not have.all():
                            lost[i] = np.unique(ends[lo:hi][~have], return_counts=True)
            none = np.zeros(0, np.int64)
            code, n = (np.concatenate([none, *(x[j] for x in lost if x)]).astype(np.int64) for j in (0, 1))
            edges = np.cumsum([0, *(len(x[0]) if x else 0 for x in lost)]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"]))
            number = pa.array(np.arange(row, row + len(langs), dtype=np.int64))
            row += len(langs)
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in places), number, pa.array(langs, pa.string()), sizes, pa.array(total), arrays], names=schema.names)

    # rows are told apart by place, so equal rows stay apart; written once, so that the places hold
    known = materialise(docs.mapInArrow(score, schema), "known", compression="zstd")
    asks = known.select("_row", F.col("_lang").alias("lang"), F.explode("_rest").alias("r")).select("_row", "lang", "r.code", "r.n")
    added = asks.join(rare.select("lang", "code", "logp"), ["lang", "code"], "left")
    more = added.groupBy("_row").agg(F.sum(F.col("n") * F.coalesce("logp", F.lit(float("nan")))).alias("_more"))
    total = F.col("_sum") + F.coalesce("_more", F.lit(0.0))
    perplexity = F.when((F.col("_size") > 0) & ~F.isnan(total), F.exp(-total / F.col("_size")))
    return known.drop("_rest").join(more, "_row", "left").select(*[f.name for f in kept], perplexity.alias("perplexity"))


def _quantile(values: DataFrame, by: str, q: float) -> DataFrame:
    """(by, n, cut): the least value with a share of ``q`` at or below it, exact over the rounded ``bits``."""
    from pyspark.sql import Window

    counted = values.groupBy(by, "bits").agg(F.count("*").alias("c"))
    here = Window.partitionBy(by)
    ranked = counted.withColumn("upto", F.sum("c").over(here.orderBy("bits"))).withColumn("n", F.sum("c").over(here))
    return ranked.where(F.col("upto") >= q * F.col("n")).groupBy(by).agg(F.first("n").alias("n"), F.min("bits").alias("cut"))


def judge(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``docs`` (doc_id, text, lang) without the text, with perplexity, threshold and keep.

    Trusted documents whose crc32(doc_id) mod FOLDS is 0 are left out of the fit and set thresholds: a language's quantile
    of bits per byte, averaged with the quantile of all languages by n to PRIOR_DOCS, at every n from none up.
    Null and empty texts are not kept; repeated rows are judged alike; nothing is kept without trusted rows on both sides.
    Columns called perplexity, threshold, keep, _batch, _lang, _n, _cut, _row, _size, _sum or _rest are refused.  The texts are read
    three times.
    """
    _refuse(docs, "threshold", "keep", "_batch", "_n", "_cut")
    small_batches(docs.sparkSession)
    ids = trusted_ids.select("doc_id").where("doc_id IS NOT NULL").distinct()
    # up to MAX_SENT ids are sent to the texts; beyond it both sides are shuffled
    ids = ids.hint("broadcast" if ids.count() <= MAX_SENT else "merge")
    left_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0
    model = fit(docs.join(ids.where(~left_out), "doc_id", "left_semi"))
    scored = materialise(perplexities(docs, model, keep_text=False), "perplexities")
    mine = scored.join(ids.where(left_out), "doc_id", "left_semi").where("perplexity IS NOT NULL")
    bits = materialise(mine.select("lang", F.lit(0).alias("every"), F.round(F.log2("perplexity"), DIGITS).alias("bits")), "left-out")
    pooled = _quantile(bits, "every", quantile).first()
    common = F.lit(pooled["cut"] if pooled else None).cast("double")
    own = _quantile(bits.where("lang IS NOT NULL"), "lang", quantile).select(F.col("lang").alias("_lang"), F.col("n").alias("_n"), F.col("cut").alias("_cut"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    cut = F.round((n * F.coalesce("_cut", F.lit(0.0)) + PRIOR_DOCS * common) / (n + PRIOR_DOCS), DIGITS)
    joined = scored.join(own, F.col("lang") == F.col("_lang"), "left").withColumn("threshold", F.pow(F.lit(2.0), cut))
    keep = F.coalesce(F.round(F.log2("perplexity"), DIGITS) <= cut, F.lit(False))
    return joined.withColumn("keep", keep).drop("_lang", "_n", "_cut")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's perplexity and decision; documents labelled with quality 1 are the trusted text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return judge(docs, trusted).select("doc_id", "lang", "perplexity", "threshold", "keep")
