"""Isolation forest (Liu, Ting & Zhou, 2008) on four line-item measures.

All randomness is MD5 of (seed, purpose, ids), so any engine can rebuild the forest from the rows.

* identity: equal lines share a key; each of them is told apart by its number among them, so they enter a sample one by one;
* sampling: each tree takes, of all lines of the table, the ``psi = min(256, lines)`` with the smallest hash of (tree, key, number). One
  pass hashes each line for all trees, sixteen bits a tree, and only hits below a bound are kept; the bound leaves so many more
  than ``psi`` a tree that too few practically never happen, and if they do it is doubled. A hit begins with as many zeros as the bound
  does, so a digest without such a run of zeros is dropped before it is cut into the draws of its trees;
* growing: ``groupBy(tree).applyInPandas`` - one small numpy task per tree (random usable feature,
  uniform split, depth limit ``ceil(log2 psi)``); nodes are numbered as in a heap (1, 2i, 2i + 1);
* scoring: equal lines are scored once; the forest (at most ``trees * (2 psi - 1)`` nodes - a fixed bound) goes into a pandas function of the
  four measures. The splits of a tree cut each measure into intervals; the intervals of two measures make a class (which leaves remain),
  and two classes make a leaf, so a line finds its leaf by look-ups instead of a way down. Path lengths are added as whole numbers
  of 1e-9, so the order of the trees doesn't matter. Lines of a query meet their scores by the same function, without a join;
* threshold: the exact ``contamination`` quantile (linear between neighbours) of all scores, from the counts of
  distinct scores and a distributed running total.

``Anomaly_Score`` follows the reference's decision function: lower is more
anomalous, below 0 is flagged.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesspark.plans.prefix import running_total
from salesspark.session import ensure_checkpoint_dir, ship_package

FEATURES = ["Sales_Amount", "Discount_Amount", "Quantity", "Profit_Amount"]
ANOMALY_COLUMNS = ["Sales_Key", "Order_ID", "Product", "Category"] + FEATURES
SAMPLE_SIZE = 256
#: Trees that one MD5 serves, 16 bits each.
PER_HASH = 8
#: Copies of a line that one row stands for before they get numbers.
COPIES = 10_000
#: Pairs of classes up to which a tree is looked up; a tree with more is descended.
CELLS = 1 << 18
#: Lines that are scored together.
BATCH = 16_384
PATH_UNITS = 1_000_000_000
SCORE_PLACES = 9
EULER = 0.5772156649015329

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("size", T.LongType()), T.StructField("depth", T.IntegerType()),
])


def average_path_length(n):
    """c(n): mean path length of an unsuccessful search in a binary search tree of n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _uniform(*ids) -> float:
    """A number strictly between 0 and 1 from the first 32 bits of an MD5."""
    return (int(hashlib.md5("|".join(map(str, ids)).encode()).hexdigest()[:8], 16) + 0.5) / 2.0**32


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def _grow(tree: int, x: np.ndarray, seed: int, max_depth: int) -> list[tuple]:
    """(tree, node, feature or -1, threshold, rows, depth) of each node."""
    nodes, stack = [], [(1, np.arange(len(x)), 0)]
    while stack:
        node, idx, depth = stack.pop()
        lo, hi = x[idx].min(axis=0), x[idx].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= max_depth or len(idx) <= 1 or usable.size == 0:
            nodes.append((tree, node, -1, 0.0, len(idx), depth))
            continue
        f = int(usable[int(_uniform(seed, tree, node, "feature") * usable.size)])
        threshold = float(lo[f] + _uniform(seed, tree, node, "split") * (hi[f] - lo[f]))
        nodes.append((tree, node, f, threshold, len(idx), depth))
        left = x[idx, f] < threshold
        stack += [(2 * node, idx[left], depth + 1), (2 * node + 1, idx[~left], depth + 1)]
    return nodes


def distinct_lines(measures: DataFrame) -> DataFrame:
    """The different rows of (_key, measures) and ``_n``, how often each occurs."""
    return measures.groupBy("_key", *FEATURES).agg(F.count(F.lit(1)).alias("_n"))


def numbered_lines(distinct: DataFrame) -> DataFrame:
    """Every line again, with ``_nth``, its number (from 1) among equal ones. Lines of very many copies are dealt out anew in parts."""
    few = distinct.filter(F.col("_n") <= COPIES).withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    parts = distinct.filter(F.col("_n") > COPIES).withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"), F.lit(COPIES).cast("long"))))
    last = F.least(F.col("_from") + COPIES - 1, F.col("_n"))
    many = parts.repartition("_key", "_from").withColumn("_nth", F.explode(F.sequence(F.col("_from"), last))).drop("_from")
    return few.unionByName(many).drop("_n")


def draw_bound(psi: int, lines: int) -> int:
    """Sixteen-bit hashes up to this take part: psi lines and eight standard deviations more are expected."""
    return min(65_535, math.ceil((psi + 8 * math.sqrt(psi) + 8) / max(lines, 1) * 65_536))


def tree_samples(distinct: DataFrame, lines: int, trees: int, seed: int, sample_size: int) -> DataFrame:
    """tree, measures: for each tree the lines with the smallest (16-bit hash, MD5)."""
    psi, bound = min(int(sample_size), lines), draw_bound(min(int(sample_size), lines), lines)
    own = F.concat_ws("|", F.col("_key").cast("string"), F.col("_nth").cast("string"))
    starts = F.array(*[F.lit(f"{seed}|draw|{i}|") for i in range(-(-trees // PER_HASH))])
    hashes = numbered_lines(distinct).select("_key", "_nth", *FEATURES, own.alias("_own"), F.posexplode(starts).alias("_i", "_start"))
    hashed = hashes.withColumn("_digest", F.md5(F.concat("_start", "_own")))
    while True:
        zeros = F.lit("0" * (4 - len(f"{bound:x}")))
        places = hashed.filter(F.col("_digest").contains(zeros)).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(PER_HASH - 1))))
        hits = places.select("_key", "_nth", *FEATURES, (F.col("_i") * PER_HASH + F.col("_j")).alias("tree"),
                             F.substring("_digest", F.col("_j") * 4 + 1, F.lit(4)).alias("draw")) \
            .filter((F.col("tree") < trees) & (F.col("draw") <= F.lit(f"{bound:04x}")))
        order = Window.partitionBy("tree").orderBy("draw", _hash(F.lit(seed), F.col("tree"), F.col("_key"), F.col("_nth")))
        ranked = hits.withColumn("_k", F.row_number().over(order))
        chosen = ranked.filter(F.col("_k") <= psi).select("tree", *FEATURES).checkpoint(eager=True)
        if bound == 65_535 or chosen.count() == trees * psi:
            return chosen
        bound = min(65_535, 2 * bound)


def fit_forest(distinct: DataFrame, lines: int, trees: int = 200, seed: int = 42, sample_size: int = SAMPLE_SIZE) -> tuple[list, int]:
    """(node tuples of all trees, psi). ``distinct`` comes from ``distinct_lines``, ``lines`` is the sum of its ``_n``."""
    psi = min(int(sample_size), lines)
    if psi == 0:
        return [], 0
    assigned = tree_samples(distinct, lines, int(trees), seed, sample_size)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_grow(int(pdf["tree"].iloc[0]), pdf[FEATURES].to_numpy(float), seed, max_depth),
                            columns=NODE_SCHEMA.fieldNames())

    # Bounded by trees * (2 * psi - 1) rows whatever the table size.
    return [tuple(r) for r in assigned.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).collect()], psi


def _flatten(nodes: list) -> dict:
    """All trees in one set of arrays: child places, leaf paths in PATH_UNITS and each tree's root."""
    nodes = sorted(nodes)
    place = {(r[0], r[1]): i for i, r in enumerate(nodes)}
    size, depth = np.array([r[4] for r in nodes], float), np.array([r[5] for r in nodes], float)
    return {"feat": np.array([r[2] for r in nodes]), "thr": np.array([r[3] for r in nodes]),
            "left": np.array([place.get((r[0], 2 * r[1]), -1) for r in nodes]),
            "right": np.array([place.get((r[0], 2 * r[1] + 1), -1) for r in nodes]),
            "leaf_path": np.round((depth + average_path_length(size)) * PATH_UNITS).astype(np.int64),
            "roots": np.array([i for i, r in enumerate(nodes) if r[1] == 1])}


def _descend(x: np.ndarray, forest: dict) -> np.ndarray:
    """Vectorised over rows and trees: a (rows x trees) matrix of node places descends together."""
    node = np.broadcast_to(forest["roots"], (len(x), len(forest["roots"]))).copy()
    rows = np.arange(len(x))[:, None]
    while True:
        f = forest["feat"][node]
        inner = f >= 0
        if not inner.any():
            return forest["leaf_path"][node].sum(axis=1)
        value = x[rows, np.where(inner, f, 0)]
        node = np.where(inner, np.where(value < forest["thr"][node], forest["left"][node], forest["right"][node]), node)


def _boxes(tree: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower (inclusive) and upper (exclusive) bounds of each leaf by measure, and its path in PATH_UNITS."""
    split, boxes, todo = {r[1]: r for r in tree}, [], [(1, [-np.inf] * len(FEATURES), [np.inf] * len(FEATURES))]
    while todo:
        node, low, high = todo.pop()
        _, _, f, threshold, size, depth = split[node]
        if f < 0:
            boxes.append((low, high, depth, size))
        else:
            cut = [threshold if i == f else None for i in range(len(FEATURES))]
            todo += [(2 * node, low, [h if c is None else c for h, c in zip(high, cut, strict=True)]),
                     (2 * node + 1, [b if c is None else c for b, c in zip(low, cut, strict=True)], high)]
    low, high, depth, size = (np.array(c, float) for c in zip(*boxes, strict=True))
    return low, high, np.round((depth + average_path_length(size)) * PATH_UNITS).astype(np.int64)


def _classes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different sets of leaves that an interval of one measure and one of another leave over, and the set of each pair of intervals."""
    sets = np.packbits((a[:, None, :] & b[None, :, :]).reshape(len(a) * len(b), -1), axis=1)
    kept, place = np.unique(sets.view(f"V{sets.shape[1]}").ravel(), return_inverse=True)
    return np.unpackbits(kept.view(np.uint8).reshape(len(kept), -1), axis=1, count=a.shape[1]).astype(bool), place


def _lookups(nodes: list) -> tuple[list, list, dict | None]:
    """All splits by measure in order, the look-ups of each tree with at most CELLS pairs of classes, and the other trees as ``_flatten`` has them."""
    splits = [np.unique([r[3] for r in nodes if r[2] == f]) for f in range(len(FEATURES))]
    trees, looked, large = {}, [], []
    for r in nodes:
        trees.setdefault(r[0], []).append(r)
    for tree in trees.values():
        low, high, path = _boxes(tree)
        own = [np.unique([r[3] for r in tree if r[2] == f]) for f in range(len(FEATURES))]
        few, some, more, most = sorted(range(len(FEATURES)), key=lambda f: len(own[f]))
        order = (few, most, some, more)
        within = [(low[:, f] <= np.append(-np.inf, own[f])[:, None]) & (high[:, f] >= np.append(own[f], np.inf)[:, None]) for f in order]
        (left, left_of), (right, right_of) = _classes(*within[:2]), _classes(*within[2:])
        if len(left) * len(right) > CELLS:
            large += tree
            continue
        leaf = np.concatenate([np.argmax(one & right, axis=1) for one in left])
        step = [len(within[1]), 1, len(within[3]), 1]
        interval = [np.append(0, np.searchsorted(own[f], splits[f], side="right")) * s for f, s in zip(order, step, strict=True)]
        looked.append((order, [c.astype(np.int32) for c in interval], (left_of * len(right)).astype(np.int32), right_of.astype(np.int32),
                       leaf.astype(np.min_scalar_type(len(path))), path))
    return splits, looked, _flatten(large) if large else None


def _total_paths(x: np.ndarray, splits: list, looked: list, large: dict | None) -> np.ndarray:
    """The path lengths of all trees, summed, for the rows of ``x``."""
    total = np.zeros(len(x), np.int64)
    places = [np.searchsorted(splits[f], x[:, f], side="right") for f in range(len(FEATURES))]
    for order, interval, left_of, right_of, leaf, path in looked:
        a, b, c, d = (i.take(places[f]) for f, i in zip(order, interval, strict=True))
        total += path.take(leaf.take(left_of.take(a + b) + right_of.take(c + d)))
    if large:
        for i in range(0, len(x), 2048):
            total[i:i + 2048] += _descend(x[i:i + 2048], large)
    return total


def score(rows: DataFrame, nodes: list, psi: int, trees: int) -> DataFrame:
    """Adds ``_raw_score`` (the reference's ``score_samples``: minus the anomaly score)."""
    if not nodes:
        return rows.withColumn("_raw_score", F.lit(0.0))
    shared = rows.sparkSession.sparkContext.broadcast(_lookups(nodes))

    @F.pandas_udf("long")
    def paths(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        splits, looked, large = shared.value
        # numpy takes by its own index type fastest
        looked = [(o, [c.astype(np.intp) for c in i], a.astype(np.intp), b.astype(np.intp), leaf, path) for o, i, a, b, leaf, path in looked]
        for batch in batches:
            x = np.column_stack(batch).astype(float)
            yield pd.Series(np.concatenate([_total_paths(x[i:i + BATCH], splits, looked, large) for i in range(0, max(len(x), 1), BATCH)]))

    mean = paths(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES]) / F.lit(float(PATH_UNITS) * trees)
    typical = float(average_path_length([psi])[0]) or 1.0
    return rows.withColumn("_raw_score", F.round(-F.pow(F.lit(2.0), -mean / F.lit(typical)), SCORE_PLACES))


def exact_quantile(values: DataFrame, col: str, q: float, weight: str | None = None) -> float | None:
    """The q-quantile of ``col`` (each value ``weight`` times), linear between neighbours: counts of distinct values, their running total over
    ranges, and the two values at which it passes the place of the quantile."""
    counted = values.groupBy(F.col(col).alias("v")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    ranked = running_total(counted, "n", [F.col("v")], out="upto", total="rows")
    place = (F.col("rows") - 1) * F.lit(float(q))
    at = ranked.select(
        F.min(F.when(F.col("upto") >= F.floor(place) + 1, F.col("v"))).alias("low"),
        F.min(F.when(F.col("upto") >= F.least(F.floor(place) + 2, F.col("rows")), F.col("v"))).alias("high"),
        F.max(place - F.floor(place)).alias("part")).first()
    return None if at["low"] is None else at["low"] + (at["high"] - at["low"]) * at["part"]


def _fitted(lines: DataFrame, contamination: float, trees: int, seed: int, key: str) -> tuple[DataFrame, list, int, float | None]:
    """The different lines with ``_n`` and ``_raw_score``, the forest's nodes, psi and the threshold."""
    ship_package(lines.sparkSession)  # the pandas functions run on the executors
    ensure_checkpoint_dir(lines.sparkSession)
    measures = lines.select(F.col(key).alias("_key"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES])
    distinct = distinct_lines(measures).checkpoint(eager=True)
    nodes, psi = fit_forest(distinct, distinct.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0], trees, seed)
    scored = score(distinct, nodes, psi, trees).checkpoint(eager=True)
    return scored, nodes, psi, exact_quantile(scored, "_raw_score", contamination, "_n")


def _judged(scored: DataFrame, offset: float | None) -> DataFrame:
    """Anomaly_Score and Is_Anomaly in place of ``_raw_score``."""
    return (scored.withColumn("Anomaly_Score", F.col("_raw_score") - F.lit(offset).cast("double"))
            .withColumn("Is_Anomaly", F.col("Anomaly_Score") < 0).drop("_raw_score"))


def scored_lines(lines: DataFrame, contamination: float = 0.02, trees: int = 200, seed: int = 42, key: str = "Sales_Key") -> DataFrame:
    """One row per different line: _key, measures, _n (how often it occurs), Anomaly_Score (lower = more anomalous) and Is_Anomaly.

    ``key`` names a column that is equal for equal lines only. Missing measures count as 0. The lines are read once; their different
    rows and then these rows' scores stand in the checkpoint folder.
    """
    scored, _, _, offset = _fitted(lines, contamination, trees, seed, key)
    return _judged(scored, offset)


def detect_anomalies(lines: DataFrame, contamination: float = 0.02, trees: int = 200, seed: int = 42, key: str = "Sales_Key",
                     flagged_only: bool = False) -> DataFrame:
    """Input columns plus Anomaly_Score (lower = more anomalous) and Is_Anomaly, for the lines with a key.

    The score depends on the measures alone, so the lines are scored where they are read: no shuffle by key, and of the flagged ones only
    these go on into the joins that the view's other columns need.
    """
    _, nodes, psi, offset = _fitted(lines, contamination, trees, seed, key)
    typed = lines.select(*[F.col(c).cast("double").alias(c) if c in FEATURES else F.col(c) for c in lines.columns]).filter(F.col(key).isNotNull())
    judged = _judged(score(typed, nodes, psi, trees), offset)
    return judged.filter("Is_Anomaly") if flagged_only else judged


def anomaly_summary(scored: DataFrame) -> DataFrame:
    """Flagged lines and their share of all lines, from ``scored_lines``."""
    return scored.agg(F.coalesce(F.sum(F.when(F.col("Is_Anomaly"), F.col("_n"))), F.lit(0)).alias("Flagged"), F.sum("_n").alias("Lines")) \
        .withColumn("Flagged_Pct", F.lit(100.0) * F.col("Flagged") / F.col("Lines"))
