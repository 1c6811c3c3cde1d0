"""Near duplicates among embeddings by an epsilon grid order join.

Equal vectors become one node.  Unit vectors are rotated to their principal axes, laid on a grid with cells of width epsilon
on the leading axes and sorted by cell (the epsilon grid order).  The sorted sequence is cut into blocks, and blocks into
intervals that keep a box on the leading axes and a ball on all of them; a pair of blocks is opened only if some pair of their
intervals may be within epsilon.  Inside it, sequence intervals are halved recursively until they are small or provably too
far apart.  Cosine >= c is the same as a distance of sqrt(2 - 2c) at most between unit vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, table
from tidemark.llm.components import components

#: Leading axes that make the grid; vectors in a block; vectors of an interval that is not halved further.
AXES, BLOCK, LEAF = 8, 4096, 512
#: Axes of an interval's box; slack of its single-precision figures.
BOX, SLACK = 16, 1e-4
#: Cosines this close to the threshold are computed again, one by one.
DOUBT = 1e-9


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, x, dim): x is null where the vector is null, empty, zero or holds nulls or non-finite components."""
    x = F.col(vector).cast("array<double>")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    fine = (F.size(x) > 0) & ~F.exists(x, bad) & F.exists(x, lambda e: e != 0)
    return vectors.select(F.col(id_col).alias("id"), F.when(fine, x).alias("x")).withColumn("dim", F.size("x"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Columns: orthonormal axes by falling variance of the unit vectors; second moments are summed by Spark."""

    def moments(batches):
        import pyarrow as pa

        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            u = _unit(_matrix(b.column(0)))
            u = np.concatenate((np.ones((len(u), 1)), u), axis=1)
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    rows = vectors.select("x").mapInArrow(moments, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((dim + 1) ** 2)
    m[[r["i"] for r in rows]] = [r["v"] for r in rows]
    m = m.reshape(dim + 1, dim + 1)
    if not m[0, 0]:
        return np.eye(dim)
    mean = m[0, 1:] / m[0, 0]
    return np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))[1][:, ::-1].copy()


def grid_order(vectors: DataFrame, axes: np.ndarray, eps: float, block: int) -> DataFrame:
    """(rank, block, id, x, p): ranks gapless in epsilon grid order, blocks of ``block`` ranks, p the leading coordinates."""
    lead = min(AXES, axes.shape[1])

    def place(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                p = _unit(_matrix(b.column(1))) @ axes[:, :lead]
                cell = np.floor(p / eps).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(p), pa.list_(pa.float64())), pa.array(list(cell), pa.list_(pa.int64()))], names=["id", "x", "p", "cell"])

    placed = materialise(vectors.select("id", "x").mapInArrow(place, "id long, x array<double>, p array<double>, cell array<long>"), "cells")  # id: any key
    parts = max(1, min(2000, -(-placed.count() // block)))

    def number(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part)), pa.array(np.arange(at, at + n))], names=["id", "x", "p", "part", "at"])
            at += n

    # the coordinates and the id after the cells let a crowded cell fill many partitions
    ordered = placed.repartitionByRange(parts, "cell", "p", "id").sortWithinPartitions("cell", "p", "id")
    ordered = materialise(ordered.select("id", "x", "p").mapInArrow(number, "id long, x array<double>, p array<double>, part long, at long"), "grid")
    sizes = dict(ordered.groupBy("part").count().collect())
    first, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        first.append(total)
        total += sizes.get(p, 0)
    offset = F.get(F.array(*[F.lit(x) for x in first] or [F.lit(0)]), F.col("part").cast("int"))
    ranked = ordered.withColumn("rank", (offset + F.col("at")).cast("long"))
    return ranked.select("rank", F.floor(F.col("rank") / block).alias("block"), "id", "x", "p")


def near_blocks(ranked: DataFrame, eps: float) -> DataFrame:
    """(b1, b2), b1 <= b2: blocks whose boxes on the leading axes are within eps; found by the cells of the first axis."""
    lead = len(ranked.select("p").first()["p"])
    bounds = [f(F.col("p")[i]).alias(f"{n}{i}") for i in range(lead) for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = ranked.groupBy("block").agg(*bounds)
    cells = F.sequence(F.floor(F.col("lo0") / eps), F.floor(F.col("hi0") / eps))
    a = boxes.select(F.explode(cells).alias("cell"), *[F.col(c).alias("a_" + c) for c in boxes.columns])
    wide = F.sequence(F.floor(F.col("lo0") / eps) - 1, F.floor(F.col("hi0") / eps) + 1)
    b = boxes.select(F.explode(wide).alias("cell"), *[F.col(c).alias("b_" + c) for c in boxes.columns])
    gap = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"b_lo{i}") - F.col(f"a_hi{i}"), F.col(f"a_lo{i}") - F.col(f"b_hi{i}")), 2) for i in range(lead))
    close = a.join(b, "cell").where((F.col("a_block") <= F.col("b_block")) & (gap <= (eps + 1e-9) ** 2))
    return close.select(F.col("a_block").alias("b1"), F.col("b_block").alias("b2")).distinct()


def intervals(ranked: DataFrame, axes: np.ndarray) -> DataFrame:
    """(block, figures): of each ``LEAF`` ranks a box on the leading axes, then centre and radius of a ball, as float32."""
    lead = min(BOX, axes.shape[1])

    def figures(pdf: pd.DataFrame) -> pd.DataFrame:
        turned = _unit(np.array(pdf["x"].to_list(), np.float64)) @ axes
        centre = turned.mean(axis=0)
        radius = np.sqrt(((turned - centre) ** 2).sum(axis=1)).max()
        row = np.concatenate((turned[:, :lead].min(axis=0), turned[:, :lead].max(axis=0), centre, [radius])).astype("<f4")
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "figures": [row.tobytes()]})

    own = ranked.withColumn("interval", F.floor(F.col("rank") / LEAF)).select("block", "interval", "x")
    each = own.groupBy("block", "interval").applyInPandas(figures, "block long, figures binary")
    # at most a block's ranks over LEAF of them, and one more
    return each.groupBy("block").agg(F.array_join(F.collect_list(F.base64("figures")), " ").alias("figures"))


def open_pairs(pairs: DataFrame, summaries: DataFrame, dim: int, eps: float) -> DataFrame:
    """The pairs (b1, b2) of blocks with some pair of intervals whose boxes and balls are within eps."""
    lead = min(BOX, dim)

    def near(a: np.ndarray, b: np.ndarray) -> bool:
        gap = np.maximum(0, np.maximum(b[None, :, :lead] - a[:, None, lead : 2 * lead], a[:, None, :lead] - b[None, :, lead : 2 * lead]))
        boxes = (gap * gap).sum(axis=2) <= (eps + SLACK) ** 2
        apart = np.sqrt(((a[:, None, 2 * lead : -1] - b[None, :, 2 * lead : -1]) ** 2).sum(axis=2))
        return bool((boxes & (apart <= a[:, None, -1] + b[None, :, -1] + eps + SLACK)).any())

    def keep(batches):
        import base64

        read = lambda text: np.frombuffer(b"".join(base64.b64decode(x) for x in text.split()), "<f4").reshape(-1, 2 * lead + dim + 1)
        for pdf in batches:
            ok = [p == q or near(read(a), read(b)) for p, q, a, b in pdf[["b1", "b2", "f1", "f2"]].itertuples(index=False)]
            yield pdf.loc[np.array(ok, bool), ["b1", "b2"]]

    f1, f2 = (summaries.select(F.col("block").alias(f"b{i}"), F.col("figures").alias(f"f{i}")) for i in "12")
    return pairs.join(f1, "b1").join(f2, "b2").select("b1", "b2", "f1", "f2").mapInPandas(keep, "b1 long, b2 long")


class _Side:
    def __init__(self, pdf: pd.DataFrame, axes: np.ndarray, at: int):
        pdf = pdf.sort_values("rank")
        self.rank, self.raw, self.copies = pdf["rank"].to_numpy(), np.array(pdf["x"].to_list(), np.float64), pdf["copies"].to_numpy()
        self.at = at  # place of the first vector in the forest
        self.unit = _unit(self.raw)
        self.turned = self.unit @ axes
        self.links = np.zeros(len(self.rank), np.int64)


class _Forest:
    """Spanning links among numbered vectors."""

    def __init__(self, size: int):
        self.label, self.edges = np.arange(size), []

    def link(self, x: int, others: np.ndarray) -> None:
        found, first = np.unique(self.label[others], return_index=True)
        for root, i in zip(found, first):
            if root != (own := self.label[x]):
                self.edges.append((x, int(others[i])))
                self.label[self.label == root] = own


def _boxes_apart(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(b.min(axis=0) - a.max(axis=0), a.min(axis=0) - b.max(axis=0)))
    return float(gap @ gap) > (eps + 1e-9) ** 2


def _join(a: _Side, b: _Side, i: slice, j: slice, cosine: float, eps: float, forest: _Forest) -> None:
    """Recursive join of the intervals i of a and j of b; of one side with itself, each pair once."""
    n, m = i.stop - i.start, j.stop - j.start
    if not n or not m or (a is b and i.start > j.start) or _boxes_apart(a.turned[i], b.turned[j], eps):
        return
    if n > LEAF or m > LEAF:
        half = lambda s: (slice(s.start, (s.start + s.stop) // 2), slice((s.start + s.stop) // 2, s.stop))
        split = lambda s, k: half(s) if k > LEAF else (s,)
        for x in split(i, n):
            for y in split(j, m):
                _join(a, b, x, y, cosine, eps, forest)
        return
    sim = a.unit[i] @ b.unit[j].T
    if sim.max() < cosine - DOUBT:
        return
    hit = sim >= cosine
    for p, q in np.argwhere(np.abs(sim - cosine) <= DOUBT):
        x, y = a.raw[i.start + p], b.raw[j.start + q]
        hit[p, q] = np.dot(x, y) / (math.sqrt(np.dot(x, x)) * math.sqrt(np.dot(y, y))) >= cosine
    same = a is b and i.start == j.start
    if same:
        np.fill_diagonal(hit, False)
    a.links[i] += hit @ b.copies[j]
    if not same:
        b.links[j] += a.copies[i] @ hit
    for r in np.flatnonzero(hit.any(axis=1)):
        forest.link(a.at + i.start + int(r), b.at + j.start + np.flatnonzero(hit[r]))


def _worker(axes: np.ndarray, cosine: float, eps: float):
    """Join of two blocks, or of one with itself where the right side is empty: spanning links and counts of links."""

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a = _Side(left, axes, 0)
        b = _Side(right, axes, len(left)) if len(right) else a
        forest = _Forest(len(left) + len(right))
        _join(a, b, slice(0, len(a.rank)), slice(0, len(b.rank)), cosine, eps, forest)
        name = np.concatenate((a.rank, b.rank)) if len(right) else a.rank
        rows = [(int(name[u]), int(name[v]), 0) for u, v in forest.edges]
        for s in (a,) if a is b else (a, b):
            at = np.flatnonzero(s.links)
            rows.extend(zip(s.rank[at].tolist(), s.rank[at].tolist(), s.links[at].tolist()))
        return pd.DataFrame(rows, columns=["u", "v", "links"]).astype("int64")

    return work


def near_vectors(vectors: DataFrame, id_col: str, vector: str, cosine: float = 0.95, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``vectors``; links at a cosine of at least ``cosine``.

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths.  Equal vectors (by two 64-bit hashes) are joined once, as one node with a number of copies; repeated
    rows are vectors of their own and link with each other; a null id is never a component's id unless all of its vectors
    lack one.  Only counts and spanning links leave a pair of blocks.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    key = [F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(7), "x").alias("h2")]
    known = usable(vectors, id_col, vector)
    out = known.where("x is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    for dim in sorted(r["dim"] for r in known.where("x is not null").select("dim").distinct().collect()):
        mine = known.where((F.col("dim") == dim) & F.col("x").isNotNull())
        nodes = mine.select("id", "x", *key).groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("x").alias("x"))
        nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        axes = principal_axes(nodes, dim)
        order = materialise(grid_order(nodes.select(F.col("node").alias("id"), "x"), axes, eps, block), "ranked")
        ranked = order.join(nodes.select(F.col("node").alias("id"), "copies"), "id")
        pairs = open_pairs(near_blocks(order, eps), intervals(order, axes), dim, eps)
        pairs = materialise(pairs, "pairs")

        rows = ranked.select("rank", "block", "x", "copies")
        left = pairs.join(rows.withColumnRenamed("block", "b1"), "b1")
        other = rows.select(F.col("block").alias("c2"), *[F.col(c).alias(c) for c in ("rank", "x", "copies")])
        right = pairs.where("b1 < b2").select(F.col("b1").alias("c1"), F.col("b2").alias("c2")).join(other, "c2")
        found = left.groupBy("b1", "b2").cogroup(right.groupBy("c1", "c2")).applyInPandas(_worker(axes, cosine, eps), "u long, v long, links long")
        found = materialise(found, "vector_links")
        roots = components(found.where("u <> v").select("u", "v"))
        links = found.groupBy(F.col("u").alias("rank")).agg(F.sum("links").alias("others"))
        named = order.select("rank", F.col("id").alias("node")).join(links, "rank", "left").join(roots.select(F.col("node").alias("rank"), "root"), "rank", "left")
        named = nodes.drop("x").join(named, "node").withColumn("root", F.coalesce("root", "rank"))
        least = named.groupBy("root").agg(F.min("least").alias("component_id"))
        told = named.join(least, "root").select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
        out = out.union(mine.select("id", *key).join(told, ["h1", "h2"]).select("id", "n_links", "component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op7_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    """Links, component and representative of every vector at a cosine of 0.95."""
    return near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), fine AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT a, v FROM reach JOIN links ON b = u),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT u, count(*) AS k FROM links GROUP BY u)
SELECT v.vec_id, coalesce(k, 0) AS n_links, c AS component_id, v.vec_id = c AS kept
FROM v JOIN comp ON a = v.vec_id LEFT JOIN n ON n.u = v.vec_id
"""
