"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

The CGK random walk copies a sequence's symbols and steps on or stays by a random bit of (step, symbol); sequences within
a small edit distance fall into step again after each edit, so their copies differ in few places.  Sampled places of the
copies, hashed, are the LSH keys; items and windows that share a key are aligned exactly.  Symbols are words without
ASCII punctuation and case.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import chunked, mix, slices, small_batches, table, utf8, word_hashes

#: An item leaks where some run of words is within this share of its words in edits.
EDITS = 0.2
#: Walks; sampled places of a key; share of places that agree in copies at the allowed distance; recall to reach.
WALKS, SAMPLED, AGREE, RECALL = 3, 2, 0.5, 0.999
#: Items that a pass over the documents compares with (a bounded broadcast); more items take more passes.
BLOCK = 20_000

_CLEAN = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i + 32 if 65 <= i <= 90 else i for i in range(256))
_PAD = np.uint64(0)


def tables_needed(sampled: int = SAMPLED, agree: float = AGREE, recall: float = RECALL) -> int:
    """Keys so that a pair whose copies agree in a share of places collides with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**sampled))


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([t.translate(_CLEAN) for t in texts])


def cgk(x: np.ndarray, seed: int) -> np.ndarray:
    """Copies (rows of 3n symbols) of the sequences in the rows of x (n symbols each)."""
    k, n = x.shape
    padded = np.concatenate((x, np.full((k, 1), _PAD)), axis=1)
    at, out, row = np.zeros(k, np.int64), np.empty((k, 3 * n), np.uint64), np.arange(k)
    factors = np.random.Generator(np.random.PCG64([seed, 7])).integers(0, 2**64, 3 * n, np.uint64) | np.uint64(1)
    for j in range(3 * n):
        symbol = padded[row, at]
        out[:, j] = symbol
        with np.errstate(over="ignore"):
            step = ((symbol * factors[j]) >> np.uint64(63)).astype(np.int64)
        at = np.minimum(at + step, n)
    return out


def lsh_keys(x: np.ndarray) -> np.ndarray:
    """A column of 64-bit keys per table for the sequences in the rows of x."""
    n, per_walk, cols = x.shape[1], -(-tables_needed() // WALKS), []
    for walk in range(WALKS):
        copy = cgk(x, walk)
        places = np.random.Generator(np.random.PCG64([walk, n])).integers(0, 3 * n, (per_walk, SAMPLED))
        for t, p in enumerate(places):
            with np.errstate(over="ignore"):
                key = np.full(len(x), np.uint64(walk * 1000 + t + 1))
                for c in p:
                    key = mix(key + copy[:, c])
            cols.append(key)
    return np.stack(cols, axis=1)


def best_alignment(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """(edits, end) of the run of words in the region with the least edit distance to the item (the first such end)."""
    m = len(region)
    row = np.zeros(m + 1, np.int64)
    ramp = np.arange(m + 1)
    for i, symbol in enumerate(item, 1):
        best = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (region != symbol))))
        row = np.minimum.accumulate(best - ramp) + ramp  # insertions chain to the right
    end = int(row.argmin())
    return int(row[end]), end


class Items:
    """A block of items, ready to be looked up: bigrams, words by length, keys by length."""

    def __init__(self, items: list[tuple]):
        words, counts = words_of([(t or "").encode() for _, t in items])
        ends = np.cumsum(counts)
        self.words = {i: words[e - n : e] for i, (e, n) in enumerate(zip(ends.tolist(), counts.tolist())) if n > 1}
        self.ids = [i for i, _ in items]
        self.bigrams = np.unique(np.concatenate([np.zeros(1, np.uint64), *[_bigrams(w) for w in self.words.values()]]))
        self.seen = np.zeros(1 << 20, bool)  # a first look by the low bits
        self.seen[(self.bigrams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.own = {i: np.unique(_bigrams(w)) for i, w in self.words.items()}
        self.distinct = {}
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(w) for w in self.words.values()}):
            which = [i for i, w in self.words.items() if len(w) == n]
            self.distinct[n] = min(len(self.own[i]) for i in which)
            keys = lsh_keys(np.stack([self.words[i] for i in which]))
            flat, owner = keys.ravel(), np.repeat(which, keys.shape[1])
            order = np.argsort(flat, kind="stable")
            self.by_length[n] = flat[order], owner[order]


def _bigrams(w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(w[:-1] * np.uint64(3) + mix(w[1:]))


def _needed(n: int) -> int:
    """Known bigrams in the item-sized window at a leak's start: no edit breaks or pushes out more than two."""
    return max(1, n - 1 - 2 * int(EDITS * n))


def _windows(known: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of the windows of n words with enough known bigrams; a shorter document is one window itself."""
    docs, starts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(known) > n - 1:
        at = np.flatnonzero(known[n - 1 :] - known[: len(known) - n + 1] >= _needed(n))
        doc = np.searchsorted(end, at, side="right")
        whole = at + n <= end[np.minimum(doc, len(end) - 1)]
        docs.append(doc[whole])
        starts.append(at[whole])
    size = end - begin
    small = np.flatnonzero((size < n) & (size >= n - int(EDITS * n)) & (size > 0))
    enough = known[np.maximum(end[small] - 1, begin[small])] - known[begin[small]] >= _needed(n)
    docs.append(small[enough])
    starts.append(begin[small[enough]])
    return np.concatenate(docs), np.concatenate(starts)


def leaks_in(texts: list[bytes], items: Items) -> list[list[tuple[int, int, int]]]:
    """Per text (item, edits, first word of the window) of the items that leak into it."""
    out: list[list] = [[] for _ in texts]
    words, counts = words_of(texts)
    if len(words) < 2 or not items.by_length:
        return out
    end = np.cumsum(counts)
    begin = end - counts
    flag = np.zeros(len(words), np.int32)
    two = _bigrams(words)
    maybe = np.flatnonzero(items.seen[(two & np.uint64(len(items.seen) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(items.bigrams, two[maybe]), len(items.bigrams) - 1)
    flag[maybe] = items.bigrams[at] == two[maybe]
    flag[end[counts > 0] - 1] = 0  # no bigram goes on into the next text
    known = np.concatenate((np.zeros(1, np.int32), np.cumsum(flag, dtype=np.int32)))
    for n, (keys, owner) in items.by_length.items():
        doc, start = _windows(known, begin, end, n)
        if not len(doc):
            continue
        # as many different known bigrams as an item keeps after the edits
        at = start[:, None] + np.arange(n - 1)
        rows = np.sort(np.where(flag[np.minimum(at, len(flag) - 1)] * (at + 1 < end[doc][:, None]), two[np.minimum(at, len(two) - 1)], _PAD), axis=1)
        varied = ((rows[:, 1:] != rows[:, :-1]).sum(axis=1) + (rows[:, 0] != _PAD)) >= items.distinct[n] - 2 * int(EDITS * n)
        doc, start = doc[varied], start[varied]
        if not len(doc):
            continue
        place = start[:, None] + np.arange(n)
        inside = place < end[doc][:, None]
        mine = lsh_keys(np.where(inside, words[np.minimum(place, len(words) - 1)], _PAD))
        first = np.searchsorted(keys, mine)
        row, col = np.nonzero(keys[np.minimum(first, len(keys) - 1)] == mine)
        a = first[row, col]
        hits = np.searchsorted(keys, mine[row, col], "right") - a
        slot = np.repeat(a, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
        met = np.unique(np.repeat(row, hits) * len(items.ids) + owner[slot])
        which, item_of = met // len(items.ids), met % len(items.ids)
        pairs = []
        for item in np.unique(item_of):  # enough bigrams of this very item
            w = which[item_of == item]
            at = start[w][:, None] + np.arange(n - 1)
            own, bigrams = items.own[item], two[np.minimum(at, len(two) - 1)]
            near = own[np.minimum(np.searchsorted(own, bigrams), len(own) - 1)] == bigrams
            ok = (near & (at + 1 < end[doc[w]][:, None])).sum(axis=1) >= _needed(n)
            pairs += [(int(doc[i]), int(item), int(start[i])) for i in w[ok]]
        slack, last, best = int(EDITS * n), {}, {}
        for d, item, at in sorted(pairs):
            if at <= last.get((d, item), -1):
                continue  # the stretch that was aligned covers this window
            low, high = max(int(begin[d]), at - slack), min(int(end[d]), at + 2 * n + slack)
            last[d, item] = at + n - slack
            edits, _ = best_alignment(items.words[item], words[low:high])
            if edits <= slack and (edits, at) < best.get((d, item), (slack + 1, 0)):
                best[d, item] = (edits, at)
        for (d, item), (edits, at) in best.items():
            out[d].append((item, edits, at - int(begin[d])))
    return [sorted(x) for x in out]


MATCH = "array<struct<item_id:long,edits:int,word:int>>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "leaks") -> DataFrame:
    """``docs`` with the benchmark items (item_id, text) that leak into each text: item, edits, where.

    Null and empty texts and items of fewer than two words never match; repeated items are all named; an empty benchmark finds
    nothing.  Whole texts are searched; items go through in blocks of ``BLOCK``.
    """
    small_batches(docs.sparkSession)
    if out in docs.columns:
        raise ValueError(f"column already present: {out}")
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull())
    n = rows.count()
    parts = max(1, -(-n // BLOCK))
    found = docs.withColumn(out, F.array().cast(MATCH))
    at = docs.columns.index(text)
    for p in range(parts):
        block = rows.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == p) if parts > 1 else rows
        known = docs.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in block.orderBy("item_id", "text").collect()]))
        schema = found.schema

        def search(batches, known=known, schema=schema):
            import pyarrow as pa

            items = known.value
            for b in slices(batches):
                texts, new = utf8(b.column(at)), []
                for part in chunked(texts, 2 << 20):
                    new += [[{"item_id": items.ids[i], "edits": d, "word": w} for i, d, w in found] for found in leaks_in(texts[part], items)]
                old = b.column(b.num_columns - 1).to_pylist()
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("word", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x + y for x, y in zip(old, new)], kind)], names=schema.names)

        found = found.mapInArrow(search, T.StructType(schema.fields))
    return found


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """A row per document and benchmark item that leaks into it, with the edits of the best alignment."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("x"))
    return leaks.select("doc_id", F.col("x.item_id").alias("item_id"), F.col("x.edits").alias("edits"), F.col("x.word").alias("word"))


def drop_leaking(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a benchmark item stay."""
    return find_leaks(docs, table(spark, sf_dir, "benchmark"), out="_leaks").where(F.size("_leaks") == 0).drop("_leaks")
