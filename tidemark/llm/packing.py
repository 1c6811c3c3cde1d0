"""Order-preserving packing of token streams into windows by dynamic programming.

Documents follow each other in corpus order as one token stream per input split.  Cuts may lie at document ends (free),
at sentence ends and, inside very long sentences, at fixed steps (both cost a penalty).  With c the cut positions,
``f[j] = penalty[j] + window - c[j] + min(f[i] + c[i])`` over cuts i at most a window before j, and the minimum slides in
a monotone queue, so the cost is linear in the number of cuts.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.common import chunked, slices, small_batches, table, utf8

WINDOW = 4096
END_OF_DOCUMENT = 2
#: Cost of a cut in padded tokens: at a document's end, at a sentence's end, inside a sentence.
PENALTY = (0, 4, 64)
#: Sentences longer than this get cuts inside, every so many tokens.
STEP = 256
#: Tokens that are packed at once; the last window of a stretch moves on to the next one.
STRETCH = 1_000_000
#: Words kept with their ids in a Python worker.
CACHE = 800_000
#: A special token of the vocabulary that separates words encoded together.
BETWEEN = "<|startoftext|>"
LONE_MARK = re.compile(rb"(?<=[a-z])([.,])(?=[ \n])")


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Positions of the cuts chosen among ``at`` (increasing, from 0 to the end, steps at most ``window``)."""
    c, pen = at.tolist(), penalty.tolist()
    back, cost = [0] * len(c), [0] * len(c)
    queue: deque = deque([(c[0], 0)])  # (f[i] + c[i], i), increasing
    for j in range(1, len(c)):
        low = c[j] - window
        while c[queue[0][1]] < low:
            queue.popleft()
        key, i = queue[0]
        back[j] = i
        value = pen[j] + window - c[j] + key
        cost[j] = value
        value += c[j]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    out, j = [], len(c) - 1
    while j:
        out.append(c[j])
        j = back[j]
    return out[::-1]


def cut_points(lengths: np.ndarray, sentence_ends: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties): ends of documents and of sentences, and steps inside longer gaps."""
    ends = np.cumsum(lengths)
    cost = np.full(int(ends[-1]) + 1, -1, np.int32)
    cost[sentence_ends] = PENALTY[1]
    cost[0] = cost[ends] = PENALTY[0]
    at = np.flatnonzero(cost >= 0)
    gap = np.diff(at)
    for a, g in zip(at[:-1][gap > step].tolist(), gap[gap > step].tolist()):
        cost[a + step : a + g : step] = PENALTY[2]
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


class WordIds:
    """Token ids per word; the tokenizer never looks across ASCII white space, so a text's ids are its words' ids."""

    def __init__(self, tokenizer_path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer, self.cache = Tokenizer.from_file(tokenizer_path), cache
        self.between = self.tokenizer.token_to_id(BETWEEN)
        self.number: dict[bytes, int] = {}
        self.used = 0  # of flat
        self.flat = np.empty(1 << 16, np.int32)
        self.first, self.count, self.stop = np.empty(1 << 15, np.int64), np.empty(1 << 15, np.int64), np.empty(1 << 15, bool)

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids per word); words are encoded many at a time, with a special token between them."""
        flat, counts = [], []
        for i in range(0, len(words), 2000):
            part = [w.decode() for w in words[i : i + 2000]]
            if any("<|" in w for w in part):
                for e in self.tokenizer.encode_batch(part, add_special_tokens=False):
                    flat.append(np.array(e.ids, np.int32))
                    counts.append(np.array([len(e.ids)]))
            else:
                ids = np.array(self.tokenizer.encode(BETWEEN.join(part), add_special_tokens=False).ids, np.int32)
                cut = np.concatenate(([-1], np.flatnonzero(ids == self.between), [len(ids)]))
                flat.append(ids[ids != self.between])
                counts.append(np.diff(cut) - 1)
        return np.concatenate(flat), np.concatenate(counts).astype(np.int64)

    def _learn(self, new: list[bytes]) -> None:
        ids, n = self._ids(new)
        base, total = len(self.number), len(ids)
        for name, need in (("flat", self.used + total), ("first", base + len(new)), ("count", base + len(new)), ("stop", base + len(new))):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate((old, np.empty(max(need, 2 * len(old)) - len(old), old.dtype))))
        self.flat[self.used : self.used + total] = ids
        at = slice(base, base + len(new))
        self.first[at], self.count[at] = self.used + np.cumsum(n) - n, n
        self.stop[at] = [w[-1:] in (b".", b"!", b"?") for w in new]
        self.used += total
        self.number.update(zip(new, range(base, base + len(new))))

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text (ids, positions after words that end a sentence)."""
        # lower-casing A-Z and parting a lone mark from the letter before it change no id; both make for fewer words
        split = [LONE_MARK.sub(rb" \1", t.lower()).split() for t in texts]
        words = list(chain.from_iterable(split))
        w = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        mark = len(self.number), self.used
        new: list[bytes] = []
        if len(miss := np.flatnonzero(w < 0)):
            new = sorted({words[i] for i in miss.tolist()})
            self._learn(new)
            w[miss] = [self.number[words[i]] for i in miss.tolist()]
        n = self.count[w]
        end = np.concatenate(([0], np.cumsum(n)))
        ids = self.flat[np.repeat(self.first[w] - end[:-1], n) + np.arange(end[-1])]
        stop = self.stop[w]
        if len(self.number) > self.cache:  # a full cache forgets what this call added
            for x in new:
                del self.number[x]
            self.used = mark[1]
        out, a = [], 0
        for text in split:
            b = a + len(text)
            out.append((ids[end[a] : end[b]], end[a + 1 : b + 1][stop[a:b]] - end[a]))
            a = b
        return out


def pack_stretch(items: list[tuple], window: int, last: bool) -> tuple[list[list[tuple]], list[tuple]]:
    """(windows of pieces, items left over).  Items: (doc_id, start, ids, doc_tokens, sentence ends within ids)."""
    lengths = np.array([len(x[2]) for x in items], np.int64)
    begin = np.cumsum(lengths) - lengths
    stops = np.concatenate([x[4] + b for x, b in zip(items, begin)] or [np.empty(0, np.int64)])
    at, penalty = cut_points(lengths, stops.astype(np.int64), min(STEP, window))
    cuts = best_cuts(at, penalty, window)
    if not last:
        cuts = cuts[:-1]
    windows, k, a = [], 0, 0
    for b in cuts:
        pieces = []
        while a < b:
            doc, start, ids, total, _ = items[k]
            stop = min(b, begin[k] + lengths[k])
            pieces.append((doc, start + int(a - begin[k]), ids[a - begin[k] : stop - begin[k]], total))
            a = stop
            if a == begin[k] + lengths[k]:
                k += 1
        windows.append(pieces)
    rest = []
    for i in range(k, len(items)):
        doc, start, ids, total, ends = items[i]
        skip = max(0, int(a - begin[i]))
        rest.append((doc, start + skip, ids[skip:], total, ends[ends > skip] - skip))
    return windows, rest


_word_ids: dict[tuple, WordIds] = {}


def word_ids(tokenizer_path: str, cache: int = CACHE) -> WordIds:
    """A worker's word cache, kept from task to task."""
    key = (tokenizer_path, cache)
    if key not in _word_ids:
        _word_ids.clear()
        _word_ids[key] = WordIds(*key)
    return _word_ids[key]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """Pieces of all documents (doc_id, text) in windows of at most ``window`` tokens.

    A document is its text's ids and then id 2; null and empty texts are that id alone.  Repeated rows are packed as
    often as they occur, a null doc_id stays null, an empty table has no pieces.  Windows never cross input splits (at
    most one short window a split); ``sequence_id`` is the split's number times 2**32 plus a count.  ``with_ids`` adds
    the ids themselves; ``cache`` bounds the words that a worker keeps with their ids.
    """
    small_batches(docs.sparkSession)
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        words = word_ids(tokenizer_path, cache)
        sequence = TaskContext.get().partitionId() << 32
        items: list[tuple] = []
        size = 0

        def emit(windows):
            nonlocal sequence
            rows = []
            for pieces in windows:
                offset = 0
                for doc, start, ids, total in pieces:
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    rows.append((doc, start, len(ids), crc, total, sequence, offset, *([ids] if with_ids else [])))
                    offset += len(ids)
                sequence += 1
            names = [x.split()[0] for x in schema.split(", ")]
            types = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            for i in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 1000]), types)], names=names)

        for batch in slices(batches):
            texts, ids_of = utf8(batch.column(1)), batch.column(0).to_pylist()
            for part in chunked(texts, 2 << 20):
                for doc, (ids, ends) in zip(ids_of[part], words.encode(texts[part])):
                    ids = np.append(ids, np.int32(END_OF_DOCUMENT))
                    items.append((doc, 0, ids, len(ids), ends))
                    size += len(ids)
                if size >= STRETCH:
                    windows, items = pack_stretch(items, window, last=False)
                    size = sum(len(x[2]) for x in items)
                    yield from emit(windows)
        if items:
            yield from emit(pack_stretch(items, window, last=True)[0])

    return docs.select("doc_id", "text").mapInArrow(pack, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
