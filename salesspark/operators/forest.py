"""A random forest for two classes, grown level by level for all trees at once.

* Training values are cut in at most ``BINS`` bins at exact ranks (the rows below a value times ``BINS`` over all rows; equal values share
  a bin), found by one distributed running total over the distinct values. A split's threshold lies halfway between two bins.
* Each tree weighs the rows by a Poisson(1) draw, the bootstrap without a fixed size, from the MD5 of seed, tree and key.
* One job per level: every task adds up its rows in an array of (tree, node, feature, bin, class), Spark sums these, and window functions
  over the at most ``BINS`` bins pick for each node the split with the largest decrease of Gini impurity, among ``subset`` features drawn by
  hash out of those that vary in the node. So the driver holds the trees (``trees * 2 ** (depth + 1)`` nodes at most) and never a row.
* Class counts are whole numbers. With the balanced weights ``n / (2 n_class)`` a count of class 0 weighs in proportion to the rows
  of class 1 and the other way round, so weighted counts are whole too. Leaf probabilities and decreases are whole ``UNIT``s, so their sums do not
  depend on any order: SQL, or another cluster, gets the same forest to the last digit.

Ties between splits go to the smaller feature number, then to the lower bin. A node with one class, or in which no feature varies, is a leaf.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesspark.plans.prefix import running_total

BINS = 64
UNIT = 10 ** 12
#: Trees that one MD5 serves, 16 bits each.
PER_HASH = 8
#: Training rows that a task has at least: what tasks add up is as large as their counts that are not zero.
ROWS_A_TASK = 4_000


def poisson_bounds() -> list[int]:
    """The 16-bit numbers at which the Poisson(1) draw becomes 1, 2, ...: its distribution function in 65,536ths."""
    bounds, total, k = [], 0.0, 0
    while not bounds or bounds[-1] < 65_535:
        total += math.exp(-1) / math.factorial(k)
        bounds.append(min(65_535, int(65_536 * total)))
        k += 1
    return bounds


@dataclass
class Node:
    tree: int
    node: int  # 1 is the root, 2 n and 2 n + 1 are the children of n
    c0: int  # rows of class 0, bootstrap repeats counted
    c1: int
    feature: int = -1  # -1: a leaf
    cut: int = -1  # last bin that goes left
    threshold: float = 0.0  # values up to it go left
    gain: int = 0  # decrease of the weighted impurity in UNITs of the root's weight


@dataclass
class Forest:
    features: list[str]
    trees: int
    depth: int
    n0: int
    n1: int
    nodes: dict[tuple[int, int], Node]

    def probability(self, node: Node | None) -> int:
        """Balanced share of class 1 in a node, in UNITs; a half for a tree that drew no row."""
        if node is None or not node.c0 + node.c1:
            return UNIT // 2
        a, b = float(node.c0 * self.n1), float(node.c1 * self.n0)
        return math.floor(b / (a + b) * UNIT + 0.5)

    def importance(self) -> list[float]:
        """Each tree's shares of the decrease by feature, averaged over the trees that split."""
        totals = [[0] * len(self.features) for _ in range(self.trees)]
        for n in self.nodes.values():
            if n.feature >= 0:
                totals[n.tree][n.feature] += n.gain
        shares = [[g * UNIT // sum(t) for g in t] for t in totals if sum(t) > 0]
        by_feature = [sum(s[i] for s in shares) for i in range(len(self.features))]
        return [float(x) / float(sum(by_feature)) if sum(by_feature) else 0.0 for x in by_feature]

    def arrays(self) -> dict[str, np.ndarray]:
        """feature, cut, threshold and probability by (tree, node)."""
        shape = (self.trees, 2 ** (self.depth + 1))
        out = {"feature": np.full(shape, -1), "cut": np.full(shape, -1), "threshold": np.zeros(shape),
               "probability": np.full(shape, UNIT // 2, np.int64)}
        for (t, n), node in self.nodes.items():
            out["feature"][t, n], out["cut"][t, n], out["threshold"][t, n] = node.feature, node.cut, node.threshold
            out["probability"][t, n] = self.probability(node)
        return out


def bin_edges(train: DataFrame, features: list[str], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Least and largest training value of each bin, by feature; at most ``BINS`` rows a feature reach the driver."""
    long = train.select(F.posexplode(F.array(*[F.col(c) for c in features])).alias("feature", "v"))
    counted = long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = running_total(counted, "n", [F.col("feature"), F.col("v")], out="upto")
    below = F.col("upto") - F.col("n") - F.col("feature") * F.lit(n)
    bins = placed.withColumn("below", below).withColumn("bin", F.expr(f"(below * {BINS}) div {n}"))
    rows = bins.groupBy("feature", "bin").agg(F.min("v").alias("low"), F.max("v").alias("high")).orderBy("feature", "bin").collect()
    of = [[r for r in rows if r["feature"] == i] for i in range(len(features))]
    return [(np.array([r["low"] for r in own]), np.array([r["high"] for r in own])) for own in of]


def bootstrap(seed: int, key: str, trees: int, bounds: np.ndarray) -> bytes:
    """How often each tree draws the row."""
    digits = "".join(hashlib.md5(f"{seed}|boot|{i}|{key}".encode()).hexdigest() for i in range(-(-trees // PER_HASH)))
    draws = np.frombuffer(bytes.fromhex(digits), ">u2")[:trees]
    return np.searchsorted(bounds, draws, "right").astype(np.uint8).tobytes()


def _prepared(train: DataFrame, key: str, features: list[str], label: str, edges: list, trees: int, seed: int) -> DataFrame:
    """One row per training row: its bins, its weight in each tree and its class, a byte each."""
    bounds = np.array(poisson_bounds())

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b[f"x{i}"].to_numpy(zero_copy_only=False) for i in range(len(features))]).astype(float)
            bins = np.column_stack([np.searchsorted(low, x[:, i], "right") - 1 for i, (low, _) in enumerate(edges)]).astype(np.uint8)
            weights = [bootstrap(seed, k, trees, bounds) for k in b["k"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), pa.array(weights, pa.binary()), b["y"]],
                                             ["bins", "weights", "y"])

    given = train.select(F.col(key).cast("string").alias("k"), *(F.col(c).alias(f"x{i}") for i, c in enumerate(features)),
                         F.col(label).cast("int").alias("y"))
    return given.mapInArrow(prepare, "bins binary, weights binary, y int")


def _histogram(rows: DataFrame, forest: Forest, level: int, active: np.ndarray) -> DataFrame:
    """c0 and c1 by (tree, node, feature, bin) over the active nodes of a level, each task's rows added up in place first."""
    width, n_features, trees = 2 ** level, len(forest.features), forest.trees
    shared = rows.sparkSession.sparkContext.broadcast({k: v for k, v in forest.arrays().items() if k in ("feature", "cut")} | {"active": active})
    schema = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("c0", pa.int64()), ("c1", pa.int64())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown, tree = shared.value, np.arange(trees)
        sums = np.zeros(trees * width * n_features * BINS * 2)  # whole numbers far below 2**53
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                bins = np.frombuffer(b"".join(part["bins"].to_pylist()), np.uint8).reshape(-1, n_features)
                weights = np.frombuffer(b"".join(part["weights"].to_pylist()), np.uint8).reshape(-1, trees)
                y = np.asarray(part["y"].to_pylist())
                node = np.ones(weights.shape, np.int64)
                for _ in range(level):
                    f = grown["feature"][tree, node]
                    right = np.take_along_axis(bins, np.maximum(f, 0), 1) > grown["cut"][tree, node]
                    node = np.where(f >= 0, 2 * node + right, 0)
                here = np.where(node >= width, node - width, 0)
                row, t = np.nonzero((node >= width) & (weights > 0) & grown["active"][tree, here])
                base, w = (t * width + here[row, t]) * n_features, weights[row, t]
                places = [((base + f) * BINS + bins[row, f]) * 2 + y[row] for f in range(n_features)]
                sums += np.bincount(np.concatenate(places), np.tile(w, n_features), len(sums))
        sums = sums.astype(np.int64).reshape(-1, 2)
        found = np.flatnonzero(sums.any(axis=1))
        rest, of_bin = np.divmod(found, BINS)
        rest, feature = np.divmod(rest, n_features)
        t, local = np.divmod(rest, width)
        for at in range(0, len(found), 100_000):
            s = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(
                (t[s], local[s] + width, feature[s], of_bin[s], sums[found[s], 0], sums[found[s], 1]), schema.types, strict=True)], schema=schema)

    parts = rows.mapInArrow(add_up, "tree int, node int, feature int, bin int, c0 long, c1 long")
    return parts.groupBy("tree", "node", "feature", "bin").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _weigh(c0: Column, c1: Column, n0: int, n1: int) -> Column:
    """(a^2 + b^2) / (a + b) of the weighted counts: the larger, the purer."""
    a, b = c0.cast("double") * F.lit(float(n1)), c1.cast("double") * F.lit(float(n0))
    return (a * a + b * b) / (a + b)


def _best_splits(histogram: DataFrame, forest: Forest, subset: int, seed: int) -> DataFrame:
    """The split of each node that can be split: its feature, last left bin, first right bin, and counts on both sides."""
    order = Window.partitionBy("tree", "node", "feature").orderBy("bin")
    so_far, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sides = histogram.select(
        "tree", "node", "feature", "bin", F.lead("bin").over(order).alias("next"), F.sum("c0").over(so_far).alias("l0"), F.sum("c1").over(so_far).alias("l1"),
        F.sum("c0").over(whole).alias("c0"), F.sum("c1").over(whole).alias("c1")).filter("next IS NOT NULL AND c0 > 0 AND c1 > 0")
    score = _weigh(F.col("l0"), F.col("l1"), forest.n0, forest.n1) + _weigh(F.col("c0") - F.col("l0"), F.col("c1") - F.col("l1"), forest.n0, forest.n1)
    per_feature = sides.groupBy("tree", "node", "feature").agg(
        F.max(F.struct(score.alias("score"), (-F.col("bin")).alias("before"), "bin", "next", "l0", "l1", "c0", "c1")).alias("s"))
    drawn = Window.partitionBy("tree", "node").orderBy(F.md5(F.concat_ws("|", F.lit(f"{seed}"), F.lit("feature"), "tree", "node", "feature")))
    few = per_feature.withColumn("nth", F.row_number().over(drawn)).filter(F.col("nth") <= subset)  # a row per feature and node
    best = few.groupBy("tree", "node").agg(F.max(F.struct(F.col("s.score").alias("score"), (-F.col("feature")).alias("f"), "s")).alias("b"))
    parent = _weigh(F.col("b.s.c0"), F.col("b.s.c1"), forest.n0, forest.n1)
    return best.select("tree", "node", (-F.col("b.f")).alias("feature"), "b.s.bin", "b.s.next", "b.s.l0", "b.s.l1", "b.s.c0", "b.s.c1",
                       (F.col("b.score") - parent).alias("decrease"))


def grow(train: DataFrame, features: list[str], label: str, key: str, counts: tuple[int, int], trees: int, depth: int, seed: int) -> Forest:
    """Fit on ``train``: numeric ``features``, a ``label`` of 0 or 1 with ``counts`` rows each, and a unique ``key``."""
    forest = Forest(list(features), int(trees), int(depth), counts[0], counts[1], {})
    edges = bin_edges(train, features, sum(counts))
    rows = _prepared(train, key, features, label, edges, forest.trees, seed).coalesce(max(1, sum(counts) // ROWS_A_TASK)).checkpoint(eager=True)
    subset = max(1, int(math.sqrt(len(features))))
    active = np.ones((forest.trees, 1), bool)
    for level in range(forest.depth):
        histogram = _histogram(rows, forest, level, active)
        if level == 0:
            histogram = histogram.checkpoint(eager=True)  # read for the roots too
            for r in histogram.filter("feature = 0").groupBy("tree").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).collect():
                forest.nodes[r["tree"], 1] = Node(r["tree"], 1, r["c0"], r["c1"])
        active = np.zeros((forest.trees, 2 ** (level + 1)), bool)
        for r in _best_splits(histogram, forest, subset, seed).collect():  # one row per node at most
            t, n, f = r["tree"], r["node"], r["feature"]
            low, high = edges[f]
            root = forest.nodes[t, 1]
            weight = float(root.c0 * forest.n1) + float(root.c1 * forest.n0)
            threshold = float((high[r["bin"]] + low[r["next"]]) / 2.0)
            forest.nodes[t, n] = Node(t, n, r["c0"], r["c1"], f, r["bin"], threshold, math.floor(r["decrease"] / weight * UNIT + 0.5))
            for side, (c0, c1) in enumerate(((r["l0"], r["l1"]), (r["c0"] - r["l0"], r["c1"] - r["l1"]))):
                forest.nodes[t, 2 * n + side] = Node(t, 2 * n + side, c0, c1)
                active[t, 2 * n + side - 2 ** (level + 1)] = c0 > 0 and c1 > 0
        if not active.any():
            break
    return forest


def summed_probability(df: DataFrame, forest: Forest, out: str) -> DataFrame:
    """Add ``out``: the sum of the trees' probabilities of class 1, in UNITs (``trees * UNIT`` is certain). Missing features count as 0."""
    shared = df.sparkSession.sparkContext.broadcast(forest.arrays())
    trees, depth = forest.trees, forest.depth

    @F.pandas_udf("long")
    def total(columns: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        grown, tree = shared.value, np.arange(trees)
        for frame in columns:
            sums = [np.zeros(0, np.int64)]
            for at in range(0, len(frame), 2048):
                x = frame.iloc[at:at + 2048].to_numpy(float)
                node = np.ones((len(x), trees), np.int64)
                for _ in range(depth):
                    f = grown["feature"][tree, node]
                    right = np.take_along_axis(x, np.maximum(f, 0), 1) > grown["threshold"][tree, node]
                    node = np.where(f >= 0, 2 * node + right, node)
                sums.append(grown["probability"][tree, node].sum(axis=1))
            yield pd.Series(np.concatenate(sums))

    return df.withColumn(out, total(F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in forest.features])))
