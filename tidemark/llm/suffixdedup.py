"""Repeated byte strings across a corpus by a distributed, common-prefix-aware merge sort of suffixes.

Sorting every suffix of a corpus costs many times its size, so suffixes start at anchors only: the leftmost place with
the least hash of ``GRAM`` bytes in each window of ``length`` bytes.  Equal windows have their anchors at equal places, so
two windows are equal iff the suffixes at their anchors share enough of a prefix and the bytes before them agree.  An
anchor's context is all that its windows cover.

1. Count the distinct contexts of the anchors' grams; an anchor whose gram has one context, seen once, has no equal window.
2. Each task sorts the distinct contexts of a stretch into a run, cut at the splitters; runs are front-coded (length of the
   prefix shared with the suffix before, then the rest) and exchanged.  A context seen twice in the stretch is repeated
   whole: its places are told at once and only one copy travels, so copies and periodic texts cost no exchange.
3. A task merges its runs with a loser tree that keeps, for each run's head, the length of the prefix shared with the
   last winner: differing lengths decide without a look at the bytes, equal ones compare only what follows.
4. In the merged order, neighbours' common prefixes and the bytes before the anchors tell which windows occur twice.

A gram with more than ``CROWD`` distinct contexts never meets in one task: its distinct contexts are counted by Spark, their
windows are dealt by hash, and those that occur twice are joined back.  Windows and contexts are equated by 64-bit hashes
within a gram (itself 64 bits), so the result is exact up to their collisions.
"""

from __future__ import annotations

import hashlib
import pickle
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common
from tidemark.llm.common import chunked, discard, materialise, mix, slices, small_batches, table, utf8

GRAM = 32
#: Bits of the filter of repeated grams (a fixed 8 MB; a gram that passes wrongly only costs an exchange of its suffix).
FILTER_BITS = 1 << 26
#: Suffixes that a merging task should get; parts at most (every task knows the splitters).
PART, MAX_PARTS = 12_000, 100_000
#: Distinct contexts of a gram that one task may hold (about 1.5 kB each).
CROWD = 50_000
#: Bytes of contexts that a task gathers into one run, places that it keeps before it passes them on, bytes of a batch of these.
RUN_BYTES, RUN_PLACES, OUT_BYTES = 8 << 20, 50_000, 1 << 20
#: Windows of a group that are hashed and ranked at once.
CELLS = 250_000


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text number, anchor, first and last window start, gram hash, context hash) of every anchor; places within their
    text."""
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    size = np.array([len(t) for t in texts], np.int64)
    if not len(size) or size.max() < length:
        return none
    buf = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(size) - size
    pow_, ipow = common._powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(common._BYTE[buf] * pow_[: len(buf)], dtype=np.uint64)))
        gram = mix((total[GRAM:] - total[:-GRAM]) * ipow[: len(buf) - GRAM + 1])
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    width, step = length - GRAM + 1, 1
    while step * 2 <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    least = np.minimum(key[: len(key) - (width - step)], key[width - step :]) if width > step else key
    has = np.flatnonzero(size >= length)
    n = size[has] - length + 1
    text = np.repeat(has, n)
    start = np.repeat(begin[has] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    at = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]))))
    last = np.concatenate((new[1:], [len(at)])) - 1
    which, low, high = text[new], start[new], start[last] + length
    with np.errstate(over="ignore"):
        context = mix((total[high] - total[low]) * ipow[low] + mix((at[new] - low).astype(np.uint64) * np.uint64(1 << 20) + (high - low).astype(np.uint64)))
    return which, at[new] - begin[which], low - begin[which], high - length - begin[which], gram[at[new]], context


def text_key(text: bytes) -> bytes:
    return hashlib.md5(text).digest()


def _batches(batch, length: int):
    """Per slice of a batch: distinct texts, whether each occurs twice in the batch, their anchors."""
    count: dict[bytes, int] = {}
    for t in utf8(batch.column(0)):
        if len(t) >= length:
            count[t] = count.get(t, 0) + 1
    texts = list(count)
    twice = np.array([count[t] > 1 for t in texts], bool)
    for part in chunked(texts):
        yield texts[part], twice[part], anchors(texts[part], length)


def gram_counts(docs: DataFrame, length: int) -> DataFrame:
    """(gram, n, head) of the grams that may be repeated: their contexts, distinct within each batch, and first bytes."""

    def count(batches):
        import pyarrow as pa

        for b in batches:
            grams, contexts, weights, heads = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for texts, twice, (which, at, _, _, gram, context) in _batches(b, length):
                context, first, inverse = np.unique(context, return_index=True, return_inverse=True)
                weights.append(np.bincount(inverse, weights=1 + twice[which], minlength=len(context)).astype(np.int64))
                contexts.append(context)
                grams.append(gram[first])
                heads.append(np.array([int.from_bytes(texts[w][p : p + 7], "big") for w, p in zip(which[first].tolist(), at[first].tolist())], np.int64))
            context, first, inverse = np.unique(np.concatenate(contexts), return_index=True, return_inverse=True)
            often = np.bincount(inverse, weights=np.concatenate(weights), minlength=len(context)) > 1
            gram, head, inverse = np.unique(np.concatenate(grams)[first], return_index=True, return_inverse=True)
            n = np.bincount(inverse, minlength=len(gram)).astype(np.int64)
            again = np.bincount(inverse, weights=often, minlength=len(gram)) > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(n), pa.array(again), pa.array(np.concatenate(heads)[first][head])], names=["gram", "n", "again", "head"]
            )

    found = docs.select("text").mapInArrow(count, "gram long, n long, again boolean, head long")
    return found.groupBy("gram").agg(F.sum("n").alias("n"), F.max("again").alias("again"), F.min("head").alias("head")).where("n > 1 or again").drop("again")


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    n = min(len(a), len(b))
    x, y = a[start:n], b[start:n]
    if x == y:
        return n
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return start + (8 * (n - start) - differ.bit_length()) // 8


def encode_run(records: list[tuple]) -> bytes:
    """Front-code records (suffix, reversed bytes before it, payload) that are sorted by suffix."""
    shared, rest, before_shared, before_rest, payload = [], [], [], [], []
    suffix = before = b""
    for s, l, p in records:
        h, g = common_prefix(suffix, s), common_prefix(before, l)
        shared.append(h)
        rest.append(s[h:])
        before_shared.append(g)
        before_rest.append(l[g:])
        payload.append(p)
        suffix, before = s, l
    return pickle.dumps((shared, rest, before_shared, before_rest, payload), protocol=5)


def decode_run(run: bytes):
    """(suffix, prefix shared with the suffix before, reversed bytes before, payload), one at a time."""
    suffix = before = b""
    for h, s, g, l, p in zip(*pickle.loads(run)):
        suffix, before = suffix[:h] + s, before[:g] + l
        yield suffix, h, before, p


class LoserTree:
    """Merge of sorted runs; each inner node keeps the loser of its match, each head its prefix shared with the winner."""

    def __init__(self, runs: list):
        size = 1
        while size < len(runs):
            size *= 2
        self.size, self.runs = size, [iter(r) for r in runs] + [iter(())] * (size - len(runs))
        self.head = [next(r, None) for r in self.runs]
        self.shared = [0] * size  # with the last winner; the empty string before the first
        self.tree = [0] * size
        winner = list(range(size))
        while len(winner) > 1:
            above = []
            for i in range(0, len(winner), 2):
                win, lose = self._match(winner[i], winner[i + 1])
                self.tree[(size + winner[i]) // (2 * (size // len(winner)))] = lose
                above.append(win)
            winner = above
        self.winner = winner[0]

    def _match(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.head[a], self.head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = self.shared[a], self.shared[b]
        if p != q:  # the one that shares more with the last winner is the lesser one
            return (a, b) if p > q else (b, a)
        h = common_prefix(x[0], y[0], p)
        if x[0][h : h + 1] <= y[0][h : h + 1]:
            self.shared[b] = h
            return a, b
        self.shared[a] = h
        return b, a

    def __iter__(self):
        """(suffix, prefix shared with the one before, reversed bytes before, payload) in order."""
        while (best := self.head[w := self.winner]) is not None:
            yield best[0], self.shared[w], best[2], best[3]
            self.head[w] = nxt = next(self.runs[w], None)
            self.shared[w] = nxt[1] if nxt else 0
            node, up = (self.size + w) // 2, w
            while node:
                win, lose = self._match(up, self.tree[node])
                self.tree[node], up = lose, win
                node //= 2
            self.winner = up


def repeated_windows(shared: np.ndarray, before: list[bytes], lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """For neighbours in suffix order, which windows starting ``o`` bytes before their anchors occur more than once.

    ``shared[i]`` is the common prefix of suffixes i-1 and i; the answer has a row per suffix and a column per o.
    """
    m, reach = len(before), max(len(b) for b in before)
    bytes_ = np.frombuffer(b"".join(b.ljust(reach, b"\0") for b in before), np.uint8).reshape(m, reach)
    size = np.array([len(b) for b in before])
    pow_, _ = common._powers(reach + 1)
    out = np.zeros((m, reach + 1), bool)
    left = np.zeros((m, 1), np.uint64)  # hash of the a bytes before each anchor
    cols = max(1, CELLS // m)
    for a in range(0, reach + 1, cols):
        o = np.arange(a, min(reach + 1, a + cols))
        group = np.cumsum(shared[:, None] < (length - o)[None, :], axis=0).astype(np.uint64)
        with np.errstate(over="ignore"):
            step = common._BYTE[bytes_[:, a : a + cols]] * pow_[a : min(reach, a + cols)]
            upto = np.cumsum(np.concatenate((left, step), axis=1), axis=1, dtype=np.uint64)
            left = upto[:, -1:].copy()
            key = mix(upto[:, : len(o)] + mix(group))
        fits = (o[None, :] <= size[:, None]) & (o[None, :] >= lo[:, None]) & (o[None, :] <= hi[:, None])
        key[~fits] = mix(np.arange(m, dtype=np.uint64) + np.uint64(1 << 60))[np.nonzero(~fits)[0]]
        order = np.argsort(key, axis=0, kind="stable")
        ranked = np.take_along_axis(key, order, axis=0)
        same = ranked[1:] == ranked[:-1]
        hit = np.zeros(key.shape, bool)
        hit[1:] |= same
        hit[:-1] |= same
        back = np.zeros(key.shape, bool)
        np.put_along_axis(back, order, hit, axis=0)
        out[:, o] = back & fits
    return out


def _spans(key: bytes, q: int, mask: np.ndarray, length: int) -> list[tuple]:
    o = np.flatnonzero(mask)
    if not len(o):
        return []
    cut = np.flatnonzero(np.diff(o) > 1)
    first, last = o[np.concatenate(([0], cut + 1))], o[np.concatenate((cut, [len(o) - 1]))]
    return [(key, q - int(b), q - int(a) + length) for a, b in zip(first, last)]


class Group:
    """The distinct contexts of one gram in suffix order; a context's second place tells both places at once."""

    def __init__(self, length: int):
        self.length, self.place, self.records = length, {}, []

    def add(self, suffix: bytes, shared: int, before: bytes, owner: tuple | None, out: list) -> None:
        """``owner``: (text key, anchor) of a context seen once, None of one that is known to be repeated."""
        at = self.place.setdefault((suffix, before), len(self.records))
        if at == len(self.records):
            self.records.append((suffix, shared, before, owner))
            return
        old = self.records[at][3]
        for key, q in (x for x in (old, owner) if x is not None):
            out.append((key, q - len(before), q + len(suffix)))
        if old is not None:
            self.records[at] = (*self.records[at][:3], None)

    def resolve(self, out: list) -> None:
        """Byte spans (text key, from, to) of the repeated windows of contexts that were seen once."""
        group, length = self.records, self.length
        if len(group) < 2 or all(r[3] is None for r in group):
            return
        lo, hi = np.array([length - len(r[0]) for r in group]), np.array([len(r[2]) for r in group])
        if len(group) == 2:
            low, high = max(int(lo.max()), length - group[1][1]), min(int(hi.min()), common_prefix(group[0][2], group[1][2]))
            if low <= high:
                out.extend((r[3][0], r[3][1] - high, r[3][1] - low + length) for r in group if r[3] is not None)
            return
        shared = np.array([r[1] for r in group])
        shared[0] = 0
        mask = repeated_windows(shared, [r[2] for r in group], lo, hi, length)
        for i, r in enumerate(group):
            if r[3] is not None:
                out.extend(_spans(*r[3], mask[i], length))


def _filter(keys: DataFrame, column: str) -> np.ndarray:
    """The fixed-size bit set of the values of a column of longs."""
    slot = F.pmod(F.col(column), F.lit(FILTER_BITS))
    words = keys.groupBy(F.shiftright(slot, 6).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({column}, {FILTER_BITS}) & 63 as int))")).alias("w"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.toLocalIterator():
        bits[r["i"]] = r["w"]
    return bits


def _in(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    s = (values % np.uint64(FILTER_BITS)).astype(np.int64)
    return ((bits[s >> 6] >> (s & 63)) & 1).astype(bool)


class Run:
    """The distinct contexts that a task gathers, and the places of those that are repeated among them."""

    def __init__(self):
        self.contexts: dict[int, list] = {}  # context hash -> [suffix, bytes before reversed, owner or None]
        self.told: list[tuple] = []  # (text key, from, to), neighbours of one text joined
        self.size = 0

    def tell(self, key: bytes, lo: int, hi: int) -> None:
        if self.told and self.told[-1][0] == key and self.told[-1][1] <= lo <= self.told[-1][2]:
            self.told[-1] = (key, self.told[-1][1], max(hi, self.told[-1][2]))
        else:
            self.told.append((key, lo, hi))

    def gather(self, texts, twice, found, keep, length: int) -> None:
        which, at, alo, ahi, _, context = (x[keep] for x in found)
        key, last = b"", -1
        for w, q, x, y, c in zip(which.tolist(), at.tolist(), alo.tolist(), ahi.tolist(), context.tolist()):
            if w != last:
                key, last = text_key(texts[w]), w
            if (old := self.contexts.get(c)) is None:
                t = texts[w]
                self.contexts[c] = [t[q : y + length], t[x:q][::-1], None if twice[w] else (key, q)]
                self.size += y + length - x
                if twice[w]:
                    self.tell(key, x, y + length)
                continue
            if old[2] is not None:
                k, p = old[2]
                self.tell(k, p - len(old[1]), p + len(old[0]))
                old[2] = None
            self.tell(key, x, y + length)

    def blobs(self, splitters: np.ndarray):
        """(part, front-coded piece of the run)."""
        records = sorted(map(tuple, self.contexts.values()), key=lambda r: r[:2])
        self.contexts.clear()
        part = np.searchsorted(splitters, np.array([int.from_bytes(r[0][:7], "big") for r in records], np.float64), side="right")
        edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(records)] if records else [0]
        for a, z in zip(edge, edge[1:]):
            yield int(part[a]), encode_run(records[a:z])

    def places(self):
        """(part below zero, places that are told), which are forgotten."""
        told, self.told = self.told, []
        for i in range(0, len(told), 5000):
            yield -1 - told[i][0][0], pickle.dumps(told[i : i + 5000], protocol=5)


def crowded_spans(docs: DataFrame, length: int, crowded: np.ndarray) -> DataFrame:
    """(key, lo, hi) for the anchors whose gram is in the bit set: contexts are counted by Spark, their windows by hash."""

    def places(batches):
        import pyarrow as pa

        seen, size = set(), 0
        for b in slices(batches):
            rows = []
            for texts, twice, found in _batches(b, length):
                which, _, alo, ahi, gram, context = (x[_in(crowded, found[4])] for x in found)
                for w, x, y, g, c in zip(which.tolist(), alo.tolist(), ahi.tolist(), gram.view(np.int64).tolist(), context.view(np.int64).tolist()):
                    content = None if c in seen else texts[w][x : y + length]
                    seen.add(c)
                    size += len(content or b"")
                    rows.append((g, c, text_key(texts[w]), x, 2 if twice[w] else 1, content))
            if size > RUN_BYTES:
                seen, size = set(), 0
            for i in range(0, len(rows), 5000):
                cols = list(zip(*rows[i : i + 5000]))
                types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["gram", "context", "key", "x", "n", "content"])

    found = materialise(docs.select("text").mapInArrow(places, "gram long, context long, key binary, x long, n long, content binary"), "crowded")
    contexts = materialise(found.groupBy("gram", "context").agg(F.sum("n").alias("n"), F.max("content").alias("content")), "contexts")

    def windows(bits):
        def deal(batches):
            import pyarrow as pa

            pow_, ipow = common._powers(4 * length)
            names = ["gram", "window", "context", "at"]
            for b in batches:
                for g, c, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                    with np.errstate(over="ignore"):
                        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(common._BYTE[np.frombuffer(t, np.uint8)] * pow_[: len(t)], dtype=np.uint64)))
                        hashed = mix((upto[length:] - upto[:-length]) * ipow[: len(t) - length + 1])
                    at = np.arange(len(hashed)) if bits is None else np.flatnonzero(_in(bits.value, hashed))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g)), pa.array(hashed[at].view(np.int64)), pa.array(np.full(len(at), c)), pa.array(at)], names=names)

        return deal

    schema = "gram long, window long, context long, at long"
    all_ = contexts.select("gram", "context", "content").mapInArrow(windows(None), schema)
    again = materialise(all_.groupBy("gram", "window").count().where("count > 1").select("gram", "window"), "windows")
    known = docs.sparkSession.sparkContext.broadcast(_filter(again, "window"))
    mine = contexts.where("n = 1").select("gram", "context", "content").mapInArrow(windows(known), schema).join(again, ["gram", "window"], "left_semi")
    island = F.col("at") - F.row_number().over(Window.partitionBy("gram", "context").orderBy("at"))  # at most ``length`` rows each
    parts = mine.withColumn("island", island).groupBy("gram", "context", "island").agg(F.min("at").alias("a"), (F.max("at") + length).alias("z")).drop("island")
    marks = parts.union(contexts.where("n > 1").select("gram", "context", F.lit(0).cast("long").alias("a"), F.length("content").cast("long").alias("z")))
    return found.select("gram", "context", "key", "x").join(marks, ["gram", "context"]).select("key", (F.col("x") + F.col("a")).alias("lo"), (F.col("x") + F.col("z")).alias("hi"))


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """(key, lo, hi): bytes lo..hi of the text with that MD5 lie in strings of ``length`` bytes that start elsewhere too.

    Spans of one text may overlap or touch.
    """
    spark = docs.sparkSession
    grams = materialise(gram_counts(docs, length), "grams")
    sizes = grams.agg(F.sum(F.when(F.col("n") <= CROWD, F.col("n"))).alias("n"), F.count(F.when(F.col("n") > CROWD, 1)).alias("crowded")).first()
    parts = max(1, min(MAX_PARTS, -(-int(sizes["n"] or 0) // PART)))
    # a gram weighs by its contexts
    heavy = grams.where(F.col("n") <= CROWD).select("head", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 4)))) if parts > 1 else None
    splitters = np.array(heavy.approxQuantile("head", [i / parts for i in range(1, parts)], min(0.01, 0.2 / parts)) if parts > 1 else [], np.float64)
    known = spark.sparkContext.broadcast(_filter(grams, "gram"))
    crowded = spark.sparkContext.broadcast(_filter(grams.where(F.col("n") > CROWD), "gram") if sizes["crowded"] else None)

    def runs(batches):
        import pyarrow as pa

        def out(blobs):
            held, size = [], 0
            for blob in chain(blobs, [None]):
                if held and (blob is None or size >= OUT_BYTES):
                    part, run = zip(*held)
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(run, pa.binary())], names=["part", "run"])
                    held, size = [], 0
                if blob is not None:
                    held.append(blob)
                    size += len(blob[1])

        run = Run()
        for b in slices(batches):
            for texts, twice, found in _batches(b, length):
                keep = _in(known.value, found[4])
                if crowded.value is not None:
                    keep &= ~_in(crowded.value, found[4])
                run.gather(texts, twice, found, keep, length)
                if len(run.told) > RUN_PLACES:
                    yield from out(run.places())
            if run.size > RUN_BYTES:
                yield from out(chain(run.blobs(splitters), run.places()))
                run = Run()
        yield from out(chain(run.blobs(splitters), run.places()))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(pdf) and pdf["part"].iloc[0] < 0:
            for blob in pdf["run"]:
                rows.extend(pickle.loads(blob))
        else:
            group = Group(length)
            for suffix, shared, before, owner in LoserTree([decode_run(r) for r in pdf["run"]]):
                if shared < GRAM:
                    group.resolve(rows)
                    group = Group(length)
                group.add(suffix, shared, before, owner, rows)
            group.resolve(rows)
        return pd.DataFrame(rows, columns=["key", "lo", "hi"]).astype({"lo": "int64", "hi": "int64"})

    exchanged = docs.select("text").mapInArrow(runs, "part int, run binary")
    spans = exchanged.groupBy("part").applyInPandas(merge, "key binary, lo long, hi long")
    if sizes["crowded"]:
        spans = spans.union(crowded_spans(docs, length, crowded.value))
    spans = materialise(spans, "spans")
    discard(grams)
    return spans


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes removed, maximal removed runs)."""
    kept, at, removed, runs = [], 0, 0, 0
    end = -1
    for lo, hi in sorted(spans):
        if lo > end:
            kept.append(text[at:lo])
            removed, runs = removed + hi - lo, runs + 1
            at = end = hi
        elif hi > end:
            removed += hi - end
            at = end = hi
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def remove_repeats(docs: DataFrame, length: int, text: str = "text", as_text: bool = False) -> DataFrame:
    """``docs`` with kept (the remaining bytes; ``as_text``: without halves of characters that were cut), n_bytes,
    n_removed, n_spans.

    Each byte goes that a ``length``-byte string covers which also starts anywhere else in ``docs``, the same text
    included; nulls are empty texts and lose nothing, repeated rows repeat all their strings, an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    added = {"kept": T.StringType() if as_text else T.BinaryType(), "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType()}
    if clash := {*added, "_key", "_spans"} & set(docs.columns):
        raise ValueError(f"columns already present: {sorted(clash)}")
    spans = repeated_spans(docs.select(F.col(text).alias("text")), length)
    listed = spans.groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("_spans")).withColumnRenamed("key", "_key")
    keyed = docs.withColumn("_key", F.when(F.octet_length(text) >= length, F.unhex(F.md5(F.encode(text, "UTF-8")))))
    joined = keyed.join(listed, "_key", "left").select(*[keyed[c] for c in docs.columns], "_spans")
    at, schema = docs.columns.index(text), T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in added.items()]])

    def cut(batches):
        import pyarrow as pa

        for b in slices(batches):
            found = b.column(b.num_columns - 1)
            rows = [cut_spans(t, [(s["lo"], s["hi"]) for s in (x or [])]) + (len(t),) for t, x in zip(utf8(b.column(at)), found.to_pylist())]
            kept, removed, runs, size = zip(*rows) if rows else ((), (), (), ())
            kept = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            new = [kept, *[pa.array(x, pa.int64()) for x in (size, removed, runs)]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=schema.names)

    return joined.mapInArrow(cut, schema)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 400-byte strings."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes of a repeated passage in the pipeline: a passage of fifty short words.
PASSAGE = 200


def cut_repeated_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, without the passages of 200 bytes or more that occur elsewhere too; a
    character that a cut would split goes.  ``n_chars`` follows the text; a null text stays null."""
    out = remove_repeats(docs, PASSAGE, as_text=True)
    cut = out.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)
