"""Exact Jaccard join of word-shingle sets with a token-group matrix.

1. Equal sets become one node.  Each set's tokens have a global order, rare ones first; sets that reach the threshold
   share a token among their first ``n - ceil(t n) + 1`` (the prefix).  At high thresholds (``compound``) a set's tokens
   are dealt by hash into more parts than linked sets have differences, so that these agree in a whole part; each part's
   content is one token of the prefix.  Such tokens stay rare when the corpus grows, the single ones do not.
2. Similar sets that crowd the same prefix token form groups of a bounded size; every other set is a group of its own.
   The matrix has a row for each prefix token and group, with the bounds of its sets' sizes and of the token's place in
   them.  Groups meet where they share a row, if sizes and places leave room for the overlap that the threshold needs.
3. A group's token union is kept as a sketch of counted cells (the greatest count of its sets in each cell); a query's
   overlap with any of them is never above the sum of the lesser counts.  Only query and group pairs whose bound reaches
   the threshold are opened: first by the sketches of the single sets, then the texts left are read and compared exactly.
4. Links make components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import chunked, discard, materialise, mix, shingle_sets, slices, small_batches, table, utf8
from tidemark.llm.components import components

#: Tokens whose order is by frequency (the most frequent of all, at the end); others come first, by hash.
FREQUENT = 100_000
#: A stretch of so many tokens reports those that it has in so many sets at least; this shapes the order, never the result.
STRETCH, REPORT = 2_000_000, 3
#: Prefix tokens with more sets than this make groups; sets in a group at most (on average).
CROWD, GROUP = 128, 256
#: Bits of the filter for the second reading of the texts (a fixed 4 MB).
FILTER_BITS = 1 << 25
#: A sketch's count at which it stops; two such cells bound nothing.
FULL = 255
#: Sizes of sets whose parts are dealt alike: the largest is about so many times the least.
BAND = 1.3


def _node(tokens: np.ndarray) -> bytes:
    """128-bit identity of a set."""
    t = tokens.view(np.uint64)
    with np.errstate(over="ignore"):
        a = mix(t).sum(dtype=np.uint64)
        b = np.bitwise_xor.reduce(mix(t * np.uint64(0xD6E8FEB86659FD93) + np.uint64(len(t))))
    return a.tobytes() + b.tobytes()


def _sketch(tokens: np.ndarray) -> bytes:
    """Counted cells, a power of two of about one to two tokens each."""
    cells = 1 << max(6, len(tokens).bit_length() - 1)
    return np.minimum(np.bincount(tokens & (cells - 1), minlength=cells), FULL).astype(np.uint8).tobytes()


def _fold(sketches: np.ndarray, cells: int) -> np.ndarray:
    """Rows of sketches with fewer cells."""
    if sketches.shape[1] == cells:
        return sketches
    return np.minimum(sketches.reshape(len(sketches), -1, cells).sum(axis=1, dtype=np.int64), FULL).astype(np.uint8)


def _most(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bounds of the overlaps of rows of sketches with equal cells."""
    least = np.minimum(a, b)
    return np.where((least == FULL).any(axis=-1), np.int64(1) << 40, least.sum(axis=-1, dtype=np.int64))


def _slot(node: bytes) -> int:
    return int.from_bytes(node[:8], "little") % FILTER_BITS


def _sets(batch, k: int):
    texts = utf8(batch.column("text"))
    for part in chunked(texts):
        yield texts[part], shingle_sets(texts[part], k)


def frequent_tokens(docs: DataFrame, k: int) -> np.ndarray:
    """Tokens in many sets, rising by estimated frequency; at most ``FREQUENT``, whatever the input's size."""

    def count(batches):
        import pyarrow as pa

        def report(held):
            tokens = np.concatenate(held)
            held.clear()
            tokens.sort()
            often = np.unique(tokens[: len(tokens) - REPORT + 1][tokens[: len(tokens) - REPORT + 1] == tokens[REPORT - 1 :]])
            n = np.searchsorted(tokens, often, side="right") - np.searchsorted(tokens, often)
            return pa.RecordBatch.from_arrays([pa.array(often), pa.array(n)], names=["token", "n"])

        held, size, seen = [], 0, set()  # copies in a stretch count once
        for b in slices(batches):
            for _, sets in _sets(b, k):
                for s in sets:
                    if len(s) and (x := s[:8].tobytes() + s[-8:].tobytes()) not in seen:
                        seen.add(x)
                        held.append(s)
                        size += len(s)
            if size >= STRETCH:
                yield report(held)
                held, size, seen = [], 0, set()
        if held:
            yield report(held)

    counts = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = materialise(counts.withColumn("bin", F.floor(F.log2("n") * 16).cast("int")), "frequent")
    # the least bin from which on all tokens fit; a few hundred bins, then at most FREQUENT tokens, reach the driver
    cut, total = 1 << 30, 0
    for r in sorted(counts.groupBy("bin").count().collect(), reverse=True):
        total += r["count"]
        if total > FREQUENT:
            break
        cut = r["bin"]
    top = counts.where(F.col("bin") >= cut).collect()
    discard(counts)
    return np.array([r["token"] for r in sorted(top, key=lambda r: (r["n"], -r["token"]))], np.int64)


def compound(num: int, den: int) -> bool:
    """Whether prefixes hold whole parts: at 8/9 and above, where a part has six tokens or more."""
    return 9 * num >= 8 * den


def bands(num: int, den: int) -> np.ndarray:
    """Least sizes of the bands; linked sets lie in one band or in two that are next to each other."""
    least = [1]
    while least[-1] < 1 << 40:
        least.append(max(-(-least[-1] * den // num), int(least[-1] * BAND) + 1))
    return np.array(least)


def part_tokens(tokens: np.ndarray, frequent: np.ndarray, least: np.ndarray, num: int, den: int) -> np.ndarray:
    """Compound tokens of a set (sorted hashes); linked sets with different tokens share one at least.

    A set deals with its own band's number of parts and, if it may link into the band below, with that band's.  Linked
    sets of which the lesser lies in the band differ by ``d`` tokens at most.  With ``d + 1 + spare`` parts they agree in
    ``1 + spare``, so a set with up to ``spare`` weak parts (nothing but frequent tokens, or none) need not tell those.
    """
    n, band, out = len(tokens), int(np.searchsorted(least, len(tokens), side="right")) - 1, [np.empty(0, np.uint64)]
    rare = np.ones(n, bool)
    if len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] != tokens
    with np.errstate(over="ignore"):
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens.view(np.uint64)), dtype=np.uint64)))
        rares = np.concatenate(([0], np.cumsum(rare)))
        for b in (band, band - 1):
            if b < 0 or (b < band and n * num > int(least[band] - 1) * den):
                continue
            d = int(least[b + 1] - 1) * (den - num) // num
            if not d:  # only equal sets link
                continue
            spare = 1 + d // 16
            parts = d + 1 + spare
            edges = np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts)
            at = np.concatenate(([0], np.searchsorted(tokens, (edges ^ np.uint64(1 << 63)).view(np.int64)), [n]))
            place = np.arange(parts, dtype=np.uint64) + np.uint64(b << 44)
            names = mix(mix(upto[at[1:]] - upto[at[:-1]]) + place * np.uint64(0x9E3779B97F4A7C15))
            strong = rares[at[1:]] > rares[at[:-1]]
            out.append(names if parts - strong.sum() > spare else names[strong])
    return np.concatenate(out).view(np.int64)


def signatures(docs: DataFrame, k: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """(doc_id, key, n, node, prefix) per row; a set repeated in a batch has its prefix once, empty sets have no node."""
    by_token = np.argsort(frequent, kind="stable")
    known = frequent[by_token]
    least = bands(num, den) if compound(num, den) else None

    def sign(batches):
        import pyarrow as pa

        for b in slices(batches):
            n, nodes, prefixes, seen = [], [], [], set()
            for _, sets in _sets(b, k):
                for s in sets:
                    n.append(len(s))
                    node = _node(s) if len(s) else None
                    nodes.append(node)
                    if node is None or node in seen:
                        prefixes.append(None)
                        continue
                    seen.add(node)
                    if least is not None:
                        prefixes.append(part_tokens(s, known, least, num, den))
                        continue
                    rank = np.zeros(len(s), np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        rank = np.where(known[at] == s, by_token[at] + 1, 0)
                    first = len(s) - -(-num * len(s) // den) + 1
                    prefixes.append(s[np.argsort(rank, kind="stable")[:first]])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["doc_id", "key", "n", "node", "prefix"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "key", "text").mapInArrow(sign, "doc_id long, key string, n long, node binary, prefix array<long>")


def read_sets(docs: DataFrame, k: int, nodes: DataFrame, what: str) -> DataFrame:
    """(node, n, text or sketch) once for each node of ``nodes``: the texts are read again, and a fixed-size filter keeps
    most of the others from being shuffled."""

    def positions(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_slot(x) for x in b.column(0).to_pylist()], pa.int64())], names=["slot"])

    slots = nodes.select("node").mapInArrow(positions, "slot long")
    words = slots.groupBy(F.shiftright("slot", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("w")).collect()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[[r["i"] for r in words]] = [r["w"] for r in words]
    wanted = docs.sparkSession.sparkContext.broadcast(bits)

    def gather(batches):
        import pyarrow as pa

        for b in slices(batches):
            rows, seen = [], set()
            for texts, sets in _sets(b, k):
                for t, s in zip(texts, sets):
                    if len(s) and (node := _node(s)) not in seen:
                        seen.add(node)
                        at = _slot(node)
                        if int(wanted.value[at >> 6]) >> (at & 63) & 1:
                            rows.append((node, len(s), t if what == "text" else _sketch(s)))
            cols = list(zip(*rows)) or [[]] * 3
            types = [pa.binary(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["node", "n", what])

    found = docs.select("text").mapInArrow(gather, f"node binary, n long, {what} binary")
    return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _bounded(num: int, den: int):
    """Keeps the (query, group) pairs whose sketches' bound reaches the overlap that the threshold needs."""

    def keep(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            n, lo = (b.column(i).to_numpy() for i in (2, 3))
            mine, union = (b.column(i).to_pylist() for i in (4, 5))
            bound, sizes = np.zeros(len(n), np.int64), np.array([(len(x), len(y)) for x, y in zip(mine, union)])
            for pair in np.unique(sizes, axis=0):
                at = np.flatnonzero((sizes == pair).all(axis=1))
                x, y = (_fold(np.frombuffer(b"".join([side[i] for i in at]), np.uint8).reshape(len(at), -1), pair.min()) for side in (mine, union))
                bound[at] = _most(x, y)
            yield b.select([0, 1]).filter(pa.array((num + den) * bound >= num * (n + lo)))

    return keep


def _union(members: pd.DataFrame) -> pd.DataFrame:
    """A group's sketch and least size; its sets have equally many cells."""
    cells = np.frombuffer(b"".join(members["sketch"]), np.uint8).reshape(len(members), -1).max(axis=0)
    return pd.DataFrame({"gid": [members["gid"].iloc[0]], "lo": [int(members["n"].min())], "union": [cells.tobytes()]})


def _partners(num: int, den: int):
    """Of a group's queries and members, those whose own sketches leave them a partner: (gid, node, asks)."""

    def keep(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        rows, wanted = [], np.zeros(len(members), bool)
        if len(queries) and len(members):
            sketches, sizes = np.frombuffer(b"".join(members["sketch"]), np.uint8).reshape(len(members), -1), members["n"].to_numpy()
            folded, names = {}, members["node"].to_numpy()
            for node, n, sketch in zip(queries["node"], queries["n"], queries["sketch"]):
                q = np.frombuffer(sketch, np.uint8)[None, :]
                cells = min(q.shape[1], sketches.shape[1])
                if cells not in folded:
                    folded[cells] = _fold(sketches, cells)
                ok = ((num + den) * _most(folded[cells], _fold(q, cells)) >= num * (n + sizes)) & (names != node)
                if ok.any():
                    rows.append((queries["gid"].iloc[0], node, True))
                    wanted |= ok
            rows.extend((members["gid"].iloc[0], x, False) for x in names[wanted])
        return pd.DataFrame(rows, columns=["gid", "node", "asks"])

    return keep


def _exact(k: int, num: int, den: int):
    """Links among pairs of texts (u, v, text, other)."""

    def compare(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            a, z = (b.column(i).to_pylist() for i in (2, 3))
            texts = list(dict.fromkeys([*a, *z]))
            sets = dict(zip(texts, (s for part in chunked(texts) for s in shingle_sets(texts[part], k))))
            ok = [(num + den) * len(np.intersect1d(sets[x], sets[y], assume_unique=True)) >= num * (len(sets[x]) + len(sets[y])) for x, y in zip(a, z)]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return compare


def _forest(pairs: np.ndarray, size: int) -> list[tuple[int, int]]:
    """A spanning forest of the linked positions."""
    parent = list(range(size))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


def _open(k: int, num: int, den: int):
    """Compare queries with a group's members: bound by the group's token union first, then exact overlaps."""

    def compare(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"u": pd.Series([], dtype=object), "v": pd.Series([], dtype=object)})
        if not len(queries) or not len(members):
            return none
        for side in (queries, members):
            texts = side["text"].to_list()
            side["tokens"] = [s for part in chunked(texts) for s in shingle_sets(texts[part], k)]
        union = np.unique(np.concatenate(members["tokens"].to_list()))
        inside = [np.searchsorted(union, t[np.isin(t, union, assume_unique=True)]) for t in queries["tokens"]]
        low = int(members["n"].min())
        n = queries["n"].to_numpy()
        hits = np.array([len(x) for x in inside])
        q = np.flatnonzero((num + den) * np.minimum(hits, int(members["n"].max())) >= num * (n + low))
        if not len(q):
            return none
        rows = [inside[i] for i in q]
        cols = [np.searchsorted(union, t) for t in members["tokens"]]
        used = np.unique(np.concatenate(rows))
        overlap = np.zeros((len(q), len(members)), np.float32)
        for a in range(0, len(used), 8192):
            part = used[a : a + 8192]
            dense = []
            for group in (rows, cols):
                m = np.zeros((len(group), len(part)), np.float32)
                for i, x in enumerate(group):
                    x = x[(x >= part[0]) & (x <= part[-1])]
                    at = np.minimum(np.searchsorted(part, x), len(part) - 1)
                    m[i, at[part[at] == x]] = 1
                dense.append(m)
            overlap += dense[0] @ dense[1].T
        both = n[q][:, None] + members["n"].to_numpy()[None, :]
        names = [*queries["node"].iloc[q], *members["node"]]
        place: dict = {}
        number = [place.setdefault(x, len(place)) for x in names]
        linked = np.argwhere((num + den) * overlap.astype(np.int64) >= num * both)
        edges = _forest([(number[a], number[len(q) + b]) for a, b in linked if number[a] != number[len(q) + b]], len(place))
        back = list(place)
        return pd.DataFrame([(back[a], back[b]) for a, b in edges], columns=["u", "v"]) if edges else none

    return compare


def link_nodes(docs: DataFrame, prefixes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Edges (u, v) between nodes that connect exactly the linked sets; ``prefixes``: (node, n, prefix), rows may repeat."""
    tokens = prefixes.select(F.posexplode("prefix").alias("pos", "token"), "node", "n").repartition("token")
    once = tokens.groupBy("token", "node").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
    live = materialise(once.withColumn("m", F.count("*").over(Window.partitionBy("token"))).where("m > 1"), "matrix")
    top = live.where(F.col("m") > CROWD).groupBy("node").agg(F.max(F.struct("m", "token")).alias("top"), F.first("n").alias("n"))
    top = materialise(top.select("node", F.col("top.token").alias("token"), F.length(F.bin("n")).alias("bits")), "tops")
    # as many chunks as the sets that gather under the token need; most of its sets may gather under another
    sizes = top.groupBy("token", "bits").agg(F.ceil(F.count("*") / GROUP).alias("chunks"))
    name = F.concat_ws(":", *[c.cast("string") for c in (F.col("token"), F.pmod(F.xxhash64("node"), F.col("chunks")), F.col("bits"))])
    groups = materialise(top.join(sizes, ["token", "bits"]).select("node", F.encode(name, "UTF-8").alias("gid")), "groups")
    discard(top)

    def compatible(n, pos, lo_n, hi_n, lo_pos, hi_pos):
        """Sizes, and room for the overlap: some tokens before this one's place, this one, and what follows it in both.
        Compound tokens have no place."""
        sizes = (n * den >= lo_n * num) & (hi_n * den >= n * num)
        room = F.least(pos, hi_pos) + 1 + F.least(n - 1 - pos, hi_n - 1 - lo_pos)
        return sizes if compound(num, den) else sizes & ((num + den) * room >= num * (n + lo_n))

    # a token of few sets: pairs of sets; of two single sets or two groups one asks the other, of a set and a group the set
    few = live.where(F.col("m") <= CROWD).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("node", "n", "pos"))).alias("sets"))
    few = few.select("sets", F.posexplode("sets").alias("i", "a")).select("a", F.explode(F.slice("sets", F.col("i") + 2, F.size("sets"))).alias("b"))
    fits = compatible(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.n"), F.col("b.pos"), F.col("b.pos"))
    pairs = few.where(fits).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    for end in "uv":
        pairs = pairs.join(groups.select(F.col("node").alias(end), F.col("gid").alias(f"g{end}")), end, "left")
    gu, gv = F.coalesce("gu", "u"), F.coalesce("gv", "v")
    u_asks = F.when(F.col("gu").isNull() == F.col("gv").isNull(), gu < gv).otherwise(F.col("gu").isNull())
    asked = pairs.where(gu != gv).select(F.when(u_asks, F.col("u")).otherwise(F.col("v")).alias("node"), F.when(u_asks, gv).otherwise(gu).alias("gid"))
    # a crowded token: all its sets are in groups; a set that has it asks the groups that have it
    rows = materialise(live.where(F.col("m") > CROWD).join(groups, "node"), "crowded")
    matrix = rows.groupBy("token", "gid").agg(*[f(c).alias(n + c) for c in ("n", "pos") for n, f in (("lo_", F.min), ("hi_", F.max))])
    fits = compatible(*[F.col(c) for c in ("n", "pos", "lo_n", "hi_n", "lo_pos", "hi_pos")])
    crowd = rows.withColumnRenamed("gid", "mine").join(matrix, "token").where((F.col("mine") < F.col("gid")) & fits).select("node", "gid")
    asks = materialise(asked.union(crowd).distinct(), "asks")
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])
    nodes = asks.select("node").union(asks.select(F.col("gid").alias("node"))).union(groups.select("node")).distinct()  # group ids are no nodes
    short = materialise(read_sets(docs, k, nodes, "sketch"), "sketches")
    unions = fresh(groups.join(short, "node")).groupBy("gid").applyInPandas(_union, "gid binary, lo long, union binary")
    unions = materialise(unions.union(short.join(groups, "node", "left_anti").select(F.col("node").alias("gid"), F.col("n").alias("lo"), F.col("sketch").alias("union"))), "unions")
    bounded = asks.join(unions, "gid").join(fresh(short), "node").select("node", "gid", "n", "lo", "sketch", "union").mapInArrow(_bounded(num, den), "node binary, gid binary")
    kept = materialise(bounded, "bounded")
    discard(live, rows, asks)

    big = groups.select("gid").distinct()
    inside = groups.join(short, "node").select("gid", "node", "n", "sketch")
    query = kept.join(big, "gid", "left_semi").select("node", "gid").union(groups.select("node", "gid")).join(short, "node").select("gid", "node", "n", "sketch")
    parts = query.groupBy("gid").agg(F.ceil(F.count("*") / (4 * GROUP)).cast("int").alias("parts"))
    deal = lambda of, member: of.join(parts, "gid").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)) if member else F.pmod(F.hash("node"), F.col("parts")))
    ask, member = fresh(deal(query, False)), fresh(deal(inside, True))
    partners = ask.groupBy("gid", "part").cogroup(member.groupBy("gid", "part")).applyInPandas(_partners(num, den), "gid binary, node binary, asks boolean")
    partners = materialise(partners.distinct(), "partners")
    single = kept.join(big, "gid", "left_anti")
    wanted = single.select("node").union(single.select("gid")).union(partners.select("node")).distinct()
    full = materialise(read_sets(docs, k, wanted, "text"), "texts")
    discard(unions, short)
    t1, t2 = (full.select(F.col("node").alias(e), F.col("text").alias(t)) for e, t in (("node", "text"), ("gid", "other")))
    pairs = single.join(t2, "gid").join(t1, "node").select(F.col("node").alias("u"), F.col("gid").alias("v"), "text", "other").mapInArrow(_exact(k, num, den), "u binary, v binary")

    query, inside = partners.where("asks").select("gid", "node"), partners.where("not asks").select("gid", "node")
    parts = query.groupBy("gid").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    ask, member = (fresh(deal(x, m).join(full, "node")) for x, m in ((query, False), (inside, True)))
    opened = ask.groupBy("gid", "part").cogroup(member.groupBy("gid", "part")).applyInPandas(_open(k, num, den), "u binary, v binary")
    edges = materialise(pairs.union(opened), "links")
    discard(groups, kept, partners, full)
    return edges


def linked_rows(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, key, n, node, root) per row of ``docs`` (doc_id, key, text): the set's size and identity, and the least
    node linked with it; node and root are null where the text has no word."""
    small_batches(docs.sparkSession)
    signed = materialise(signatures(docs, k, num, den, frequent_tokens(docs, k)), "signatures")
    plain = materialise(signed.drop("prefix"), "nodes")
    edges = link_nodes(docs, signed.where(F.col("prefix").isNotNull()).select("node", "n", "prefix"), k, num, den)
    discard(signed)
    return plain.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text); links where den * overlap >= num * union.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer than k words make one shingle.  Null, empty and blank
    texts have no set and are components of their own; repeated rows are copies; a null doc_id is never a component's
    id unless all of its documents lack one.  An empty table gives an empty result.  Other columns are not read.
    """
    rows = linked_rows(docs.select("doc_id", F.lit("").alias("key"), "text"), k, num, den)
    least = rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("component_id"))
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one_per_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates (five words, 0.8) one row stays: the least doc_id (null last), of
    several texts with that id the least digest, of equal ones any.  Rows without words all stay.

    Rows are decided by id and text, so different texts under one id are judged apart.  Columns called ``_key`` are refused.
    """
    if "_key" in docs.columns:
        raise ValueError("columns already present: ['_key']")
    keyed = docs.withColumn("_key", F.md5("text"))
    rows = linked_rows(keyed.select("doc_id", F.col("_key").alias("key"), "text"), 5, 80, 100)
    best = rows.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best"))
    kept = materialise(best.select(F.col("best.doc_id").alias("i"), F.col("best.key").alias("k")), "kept")
    wordless = F.coalesce(F.trim(F.translate("text", "\t\n\x0b\x0c\r", " " * 5)) == "", F.lit(True))
    stay = keyed.where(~wordless).join(kept, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("_key") == F.col("k")), "left_semi")
    return stay.dropDuplicates(["doc_id", "_key"]).unionByName(keyed.where(wordless)).drop("_key")


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of all documents by three-word shingles at 0.9."""
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), lists AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM lists),
flat AS (SELECT doc_id, unnest(s) AS t FROM lists),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM flat a JOIN flat b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * k >= 90 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT a, v FROM reach JOIN links ON b = u
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, c AS component_id FROM sizes JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = doc_id
"""
