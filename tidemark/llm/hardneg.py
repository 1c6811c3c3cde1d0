"""Hard negatives by a vantage-point tree over norm-augmented vectors.

Components are whole numbers, so scores (inner products) are exact.  With M the largest norm, a row x becomes (x, sqrt(M^2 -
|x|^2)) and an anchor q becomes (q, 0); then d^2 = |q|^2 + M^2 - 2 score: a window of scores is an annulus of distances, and
the higher score is the nearer row.  A tree of vantage points, fitted on a bounded sample, sends every row to a leaf; leaves
keep the least and greatest distance of their rows to each vantage point above them.  The triangle inequality bounds an
anchor's distance to a leaf from both sides, and leaves are opened from the annulus' inner edge outwards: first the nearest
few, then those that may still hold something nearer than the k-th row found.  The bounds lose nothing, so results are exact.

Leaves of many rows are split by hash into cells of bounded size, and anchors that ask one leaf into slots of bounded size; a
task holds a cell and a slot.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, table

#: Rows (those with the least hash of their place and id) that the tree is fitted on.
SAMPLE = 8192
#: Rows that a leaf is meant to have (the sample bounds the number of leaves), rows of a cell, anchors of a slot.
LEAF, CELL, SLOT = 1024, 8192, 4096
#: Sample rows of a leaf at least; candidates for a vantage point.
LEAST, CANDIDATES = 8, 8
#: Leaves opened in the first increment, for each annulus.
FIRST = 4
#: Anchors scored at a time.
BLOCK = 256
#: Components may not be larger.
LARGEST = 1 << 26


@dataclass
class Tree:
    """Node i has a vantage point and a radius; children are nodes, or ~leaf.  ``paths``: the nodes above each leaf."""

    points: list = field(default_factory=list)
    radius: list = field(default_factory=list)
    child: list = field(default_factory=list)
    paths: list = field(default_factory=list)

    def distances(self, rows: np.ndarray, nodes: list[int]) -> np.ndarray:
        p = np.array([self.points[i] for i in nodes]).reshape(len(nodes), rows.shape[1])
        square = (rows * rows).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * rows @ p.T
        return np.sqrt(np.maximum(square, 0))

    def route(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The leaf of each row and its distances to the nodes above it."""
        leaf, far = np.zeros(len(rows), np.int64), [None] * len(rows)
        todo = [(0 if self.points else ~0, np.arange(len(rows)), np.zeros((len(rows), 0)))]
        while todo:
            node, at, above = todo.pop()
            if node < 0:
                leaf[at] = ~node
                for i, d in zip(at, above):
                    far[i] = d
                continue
            d = self.distances(rows[at], [node])
            near = d[:, 0] <= self.radius[node]
            for side, mine in ((0, near), (1, ~near)):
                if mine.any():
                    todo.append((self.child[node][side], at[mine], np.concatenate((above[mine], d[mine]), axis=1)))
        return leaf, far


def fit(rows: np.ndarray, least: int) -> Tree:
    """A tree over augmented sample rows; each vantage point is, of a few candidates, the one with the widest distances."""
    rng, tree = np.random.default_rng(11), Tree()

    def grow(at: np.ndarray, above: list[int]) -> int:
        if len(at) >= 2 * least:
            best, mine = -1.0, None
            for c in rng.choice(at, min(CANDIDATES, len(at)), replace=False):
                d = np.sqrt(((rows[at] - rows[c]) ** 2).sum(axis=1))
                if d.std() > best:
                    best, mine, far = d.std(), c, d
            radius = float(np.median(far))
            if far.max() > radius or (radius := (far.min() + far.max()) / 2) < far.max():
                node = len(tree.points)
                tree.points.append(rows[mine])
                tree.radius.append(radius)
                tree.child.append(None)
                near = far <= radius
                tree.child[node] = (grow(at[near], [*above, node]), grow(at[~near], [*above, node]))
                return node
        tree.paths.append(above)
        return ~(len(tree.paths) - 1)

    grow(np.arange(len(rows)), [])
    return tree


def whole_rows(vectors: DataFrame, id_col: str, vector: str, label: str, scale: int) -> DataFrame:
    """(row, id, label, x): rows that take part, with components floor(scale * component), shorter vectors filled with 0."""
    v = F.col(vector).cast("array<double>")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    fine = vectors.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & ~F.exists(v, bad))
    named = fine.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.transform(v, lambda e: F.floor(e * scale)).alias("x"), F.transform(v, lambda e: F.abs(e * scale)).alias("_size"))
    bound = named.agg(F.max(F.array_max("_size")).alias("most"), F.max(F.size("x")).alias("dim"), F.min(F.size("x")).alias("least")).first()
    if (bound["most"] or 0) > LARGEST:
        raise ValueError(f"components beyond {LARGEST} in size are refused: {bound['most']}")
    dim = max(1, bound["dim"] or 0)
    x = F.col("x") if bound["least"] == dim else F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("x")))
    return materialise(named.select(F.monotonically_increasing_id().alias("row"), "id", "label", x.alias("x")), "vectors")


def _matrix(column, dim: int) -> np.ndarray:
    return np.array(column.to_pylist() if hasattr(column, "to_pylist") else column.to_list(), np.float64).reshape(-1, dim)


def _augmented(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate((x, np.sqrt(np.maximum(0, most - (x * x).sum(axis=1)))[:, None]), axis=1)


@dataclass
class Leaves:
    """The tree and its leaves' bounds, whose size the sample bounds; they go with each task."""

    tree: Tree
    cells: list[int]  # of each leaf
    least: list[list[float]]  # distances of each leaf's rows to the nodes above it
    greatest: list[list[float]]
    most: float  # the largest squared norm
    dim: int

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible distance of each anchor to the rows of each leaf."""
        low, high = np.zeros((len(q), len(self.cells))), np.full((len(q), len(self.cells)), np.inf)
        whole = np.concatenate((q, np.zeros((len(q), 1))), axis=1)
        d = self.tree.distances(whole, list(range(len(self.tree.points))))
        for leaf, path in enumerate(self.tree.paths):
            if path:
                a, b, mine = np.array(self.least[leaf]), np.array(self.greatest[leaf]), d[:, path]
                low[:, leaf] = np.maximum(0, np.maximum(mine - b, a - mine).max(axis=1))
                high[:, leaf] = (mine + b).min(axis=1)
        return low, high

    def to_open(self, x: np.ndarray, lo: list, hi: list, reached: list | None) -> list[list[int]]:
        """For each anchor the leaves of this increment.

        ``lo``, ``hi``: each anchor's windows of scores; ``reached``: None for the first increment, else the k-th best score
        in each window so far (None where fewer were found).
        """
        slack, out = 1e-5 * math.sqrt(self.most) + 1e-9, []
        low, high = self.bounds(x)
        filled = np.array(self.cells) > 0
        for i, row in enumerate(x):
            square = float(row @ row) + self.most
            at = lambda score: math.sqrt(max(0.0, square - 2.0 * score))  # noqa: B023, E731
            first, later = set(), set()
            for w, (a, b) in enumerate(zip(lo[i], hi[i])):
                if a > b:
                    continue
                near, far = at(b) - slack, at(a) + slack
                meets = filled & (low[i] <= far) & (high[i] >= near)
                order = np.flatnonzero(meets)
                order = order[np.lexsort((high[i][order], np.maximum(low[i][order], near)))]
                first.update(order[:FIRST].tolist())
                if reached is not None:
                    kth = reached[i][w]
                    later.update(np.flatnonzero(meets & (low[i] <= (far if kth is None else min(far, at(kth) + slack)))).tolist())
            out.append(sorted(first) if reached is None else sorted(later - first))
        return out


@dataclass
class Index:
    rows: DataFrame  # row, id, label, x, leaf, cell
    leaves: Leaves

    @staticmethod
    def build(rows: DataFrame) -> Index:
        told = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("x", F.lit(0).cast("decimal(38,0)"), lambda a, e: (a + e * e).cast("decimal(38,0)"))).alias("most"), F.max(F.size("x")).alias("dim")).first()
        n, most, dim = told["n"], float(told["most"] or 0), told["dim"] or 1
        sample = rows.orderBy(F.xxhash64("id", "row"), "row").limit(SAMPLE).select("x").collect()
        taken = np.array([r["x"] for r in sample], np.float64).reshape(-1, dim)
        tree = fit(_augmented(taken, most), max(LEAST, math.ceil(LEAF * len(taken) / max(1, n))))

        def place(batches):
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    leaf, far = tree.route(_augmented(_matrix(b.column(3), dim), most))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32)), pa.array(far, pa.list_(pa.float64()))], names=["row", "id", "label", "x", "leaf", "far"])

        kind = rows.schema["label"].dataType.simpleString()
        placed = materialise(rows.mapInArrow(place, f"row long, id long, label {kind}, x array<long>, leaf int, far array<double>"), "placed")
        sizes = dict(placed.groupBy("leaf").count().collect())
        edges = placed.select("leaf", F.posexplode("far").alias("at", "d")).groupBy("leaf", "at").agg(F.min("d").alias("a"), F.max("d").alias("b")).collect()
        least, greatest = ([[empty] * len(path) for path in tree.paths] for empty in (math.inf, -math.inf))
        for r in edges:
            least[r["leaf"]][r["at"]], greatest[r["leaf"]][r["at"]] = r["a"], r["b"]
        cells = [-(-sizes.get(i, 0) // CELL) for i in range(len(tree.paths))]
        cell = F.pmod(F.xxhash64("row"), F.greatest(F.lit(1), F.get(F.array(*map(F.lit, cells)), F.col("leaf"))))
        return Index(placed.select("row", "id", "label", "x", "leaf", cell.cast("int").alias("cell")), Leaves(tree, cells, least, greatest, most, dim))

    def open(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """(row, w, id, at, score): the best k rows of each cell that an anchor opens, in each of its windows.

        ``anchors``: row, label, x, lo, hi and, after the first increment, reached.
        """
        leaves, later = self.leaves, "reached" in anchors.columns
        kind = anchors.schema["label"].dataType.simpleString()

        def ask(batches):
            import pyarrow as pa

            for b in batches:
                if not b.num_rows:
                    continue
                lo, hi = b.column("lo").to_pylist(), b.column("hi").to_pylist()
                opened = leaves.to_open(_matrix(b.column("x"), leaves.dim), lo, hi, b.column("reached").to_pylist() if later else None)
                pairs = [(i, leaf, cell) for i, found in enumerate(opened) for leaf in found for cell in range(leaves.cells[leaf])]
                for begin in range(0, len(pairs), 10_000):
                    part = pairs[begin : begin + 10_000]
                    taken = b.select(["row", "label", "x", "lo", "hi"]).take(pa.array([p[0] for p in part], pa.int64()))
                    yield pa.RecordBatch.from_arrays([*taken.columns, *[pa.array([p[c] for p in part], pa.int32()) for c in (1, 2)]], names=["row", "label", "x", "lo", "hi", "leaf", "cell"])

        asked = anchors.mapInArrow(ask, f"row long, label {kind}, x array<long>, lo array<long>, hi array<long>, leaf int, cell int")
        asked = materialise(asked, "asked")
        # anchors of a cell, and as many copies of the cell's rows as they fill slots
        slots = asked.groupBy("leaf", "cell").agg(F.ceil(F.count("*") / SLOT).cast("int").alias("slots"))
        left = asked.join(slots, ["leaf", "cell"]).withColumn("slot", F.pmod(F.xxhash64("row"), F.col("slots")).cast("int")).drop("slots")
        right = self.rows.join(slots, ["leaf", "cell"]).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).select("leaf", "cell", "slot", "row", "id", "label", "x")
        keys = ("leaf", "cell", "slot")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_score(leaves.dim, leaves.most, same, k), "row long, w int, id long, at long, score long")

    def search(self, anchors: DataFrame, same: bool, k: int) -> DataFrame:
        """(row, w, rank, id, score): in each window of each anchor the first k rows of its label, or of other labels.

        Higher scores come first, ties by smaller id; an anchor never finds its own row.
        """
        order = Window.partitionBy("row", "w").orderBy(F.col("score").desc(), F.col("id").asc(), F.col("at").asc())
        best = lambda hits: hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        near = materialise(best(self.open(anchors, same, k)), "near")
        kth = near.where(F.col("rank") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
        reached = F.transform("lo", lambda _, w: F.try_element_at("kth", w))
        more = self.open(anchors.join(kth, "row", "left").withColumn("reached", reached).drop("kth"), same, k)
        return best(near.drop("rank").unionByName(more))


def _score(dim: int, most: float, same: bool, k: int):
    exact = most * 2 < 1 << 53  # every partial sum of a product of two rows is a whole double

    def work(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(rows):
            rows = rows.sort_values(["id", "row"], ignore_index=True)
            kind = np.float64 if exact else np.int64
            x = np.array(rows["x"].to_list(), kind).reshape(-1, dim).T
            row, ids, label = rows["row"].to_numpy(), rows["id"].to_numpy(), rows["label"].to_numpy()
            for begin in range(0, len(asked), BLOCK):
                part = asked.iloc[begin : begin + BLOCK]
                scores = (np.array(part["x"].to_list(), kind).reshape(-1, dim) @ x).astype(np.int64)
                for s, own, mine, lo, hi in zip(scores, part["row"], part["label"], part["lo"], part["hi"]):
                    may = ((label == mine) == same) & (row != own)
                    for w, (a, b) in enumerate(zip(lo, hi)):
                        at = np.flatnonzero(may & (s >= a) & (s <= b))
                        if len(at) > k:
                            at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
                        at = at[np.argsort(-s[at], kind="stable")[:k]]  # places are in the order of ids
                        out.append((np.full(len(at), own), np.full(len(at), w), ids[at], row[at], s[at]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 5
        return pd.DataFrame(dict(zip(("row", "w", "id", "at", "score"), columns))).astype({"w": "int32"})

    return work


def hard_negatives(
    vectors: DataFrame, id_col: str, vector: str, label: str, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchor`` (a condition
    on the column ``id``) picks.

    A component counts as floor(scale * component).  An anchor's positives are the first ``positives`` other rows of its
    label, its negatives for each of them the first ``negatives`` rows of other labels whose score lies between ``low`` and
    ``high`` hundredths of the positive's.  Rows with a null id, label or vector or with a null or non-finite component take
    no part; shorter vectors count as filled with 0; components beyond 2^26 are refused.  Repeated rows are rows of their
    own, told apart after score and id by their place.  Positive scores below 0 have no window; without anchors, positives
    or rows nothing is returned.  Other columns are not read.
    """
    rows = whole_rows(vectors, id_col, vector, label, scale)
    index = Index.build(rows)
    every = lambda x: F.array(F.lit(x).cast("long")).alias("lo" if x < 0 else "hi")
    anchors = rows.where(anchor)
    found = index.search(anchors.select("row", "label", "x", every(-(1 << 62)), every(1 << 62)), True, positives)
    found = materialise(found.select("row", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    whole = lambda a: F.call_function("div", a - F.pmod(a, F.lit(100).cast("long")), F.lit(100).cast("long"))  # noqa: E731  floor(a / 100)
    window = F.struct("rank", (-whole(F.col("positive_score") * -low)).alias("lo"), whole(F.col("positive_score") * high).alias("hi"))
    windows = found.groupBy("row").agg(F.sort_array(F.collect_list(window)).alias("windows"))
    asking = anchors.join(windows, "row").select("row", "label", "x", F.col("windows.lo").alias("lo"), F.col("windows.hi").alias("hi"))
    hits = index.search(asking, False, negatives).select("row", (F.col("w") + 1).alias("p"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    told = hits.join(found.withColumnRenamed("rank", "p"), ["row", "p"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return told.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every embedding whose id is divisible by 100, against all of them."""
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", relabelled.alias("label"))
    return hard_negatives(vectors, "vec_id", "embedding", "label", F.col("id") % 100 == 0)


OP11_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
