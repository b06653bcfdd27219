"""RFM k-means segments with ranked labels.

Z-scores are clustered as whole numbers of a millionth, so sums, distances and centres are exact and don't depend on the
order of tasks (or on the engine: SQL can rebuild them). All restarts advance in one pass per round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesspark.session import ensure_checkpoint_dir, ship_package

UNITS, SHIFT = 1_000_000, 1_000
NEAR = 1_750_000_000  # three squares of it fit in 64 bits

# Segment labels, best mean composite score first.
SEGMENT_LABELS = ["Champions", "Loyal Customers", "At Risk", "Lost / Dormant"]
RFM = ["Recency_Days", "Frequency", "Monetary"]
Z = ["Z_Recency", "Z_Frequency", "Z_Monetary"]


def rfm_scores(features: DataFrame) -> DataFrame:
    """Adds Z_Recency (of -Recency), Z_Frequency, Z_Monetary and Composite_Score."""
    base = features.fillna(0, RFM).withColumn("_neg_recency", -F.col("Recency_Days").cast("double"))
    axes = {"Z_Recency": "_neg_recency", "Z_Frequency": "Frequency", "Z_Monetary": "Monetary"}
    # One scalar subquery returning a struct: the statistics are computed in a single pass.
    stats = base.select(F.struct(*[agg for src in axes.values() for agg in (
        F.avg(F.col(src).cast("double")).alias("m_" + src),
        F.stddev_pop(F.col(src).cast("double")).alias("s_" + src))]).alias("s")).scalar()
    out = base
    for z, src in axes.items():
        mean, std = stats.getField("m_" + src), stats.getField("s_" + src)
        scale = F.when(std.isNull() | (std == 0), F.lit(1.0)).otherwise(std)
        out = out.withColumn(z, (F.col(src).cast("double") - mean) / scale)
    return out.withColumn("Composite_Score", (F.col(Z[0]) + F.col(Z[1]) + F.col(Z[2])) / 3).drop("_neg_recency")


def _points(scored: DataFrame) -> DataFrame:
    """Customer_Key and the z-scores as whole numbers of 1 / UNITS above -SHIFT, so that sums and distances are exact."""
    return scored.select("Customer_Key", *[(F.round(F.col(z) * UNITS).cast("long") + SHIFT * UNITS).alias(z) for z in Z])


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre and squared distance (Python integers). Rows that are not within NEAR of any centre go by Python integers."""
    diff = x[:, None, :] - centres[None, :, :]
    far = np.abs(diff).max(axis=2) > NEAR
    d = np.where(far, np.iinfo(np.int64).max, (np.where(far[:, :, None], 0, diff) ** 2).sum(axis=2))
    at = d.argmin(axis=1)
    least = d[np.arange(len(x)), at]
    beyond = np.flatnonzero(far.any(axis=1) & (least > NEAR ** 2))
    least = least.astype(object)
    for i in beyond:
        whole = [sum(v * v for v in row) for row in diff[i].tolist()]
        at[i] = min(range(len(whole)), key=whole.__getitem__)
        least[i] = whole[at[i]]
    return at, least


def _squared(units: list[Column], centre: np.ndarray) -> Column:
    """Squared distance as a decimal: z-scores of a few thousand square beyond 64 bits."""
    apart = [(u - F.lit(int(v))).cast("decimal(19,0)") for u, v in zip(units, centre, strict=True)]
    return sum((a * a for a in apart), F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)")


def _lloyd(points: DataFrame, centres: np.ndarray, max_iter: int) -> tuple[np.ndarray, list[int]]:
    """All restarts in one pass per round: a restart that has not moved rests. (Restarts, k, 3) centres and their costs."""
    sc, active, cost = points.sparkSession.sparkContext, list(range(len(centres))), [0] * len(centres)
    for _ in range(max_iter + 1):
        shared = sc.broadcast((active, centres))

        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows: dict[tuple[int, int], list[int]] = {}
            for f in frames:
                x = f[Z].to_numpy(np.int64)
                for r in shared.value[0]:
                    at, d = _nearest(x, shared.value[1][r])
                    for c in np.unique(at):
                        own = at == c
                        add = [int(own.sum()), *x[own].sum(axis=0).tolist(), int(d[own].sum())]
                        rows[r, int(c)] = [a + b for a, b in zip(rows.get((r, int(c)), [0] * 5), add, strict=True)]
            yield pd.DataFrame([(*k, *v[:4], Decimal(v[4])) for k, v in rows.items()], columns=["r", "c", "n", "x", "y", "z", "d"])

        parts = points.mapInPandas(sums, "r int, c int, n long, x long, y long, z long, d decimal(38,0)")
        found = parts.groupBy("r", "c").agg(*[F.sum(v).alias(v) for v in ("n", "x", "y", "z", "d")]).collect()  # restarts * k rows
        moved = centres.copy()
        for r in active:
            cost[r] = sum(int(f["d"]) for f in found if f["r"] == r)
        for f in found:
            moved[f["r"], f["c"]] = [(2 * f[v] + f["n"]) // (2 * f["n"]) for v in ("x", "y", "z")]
        active = [r for r in active if (moved[r] != centres[r]).any()]
        centres = moved
        if not active:
            break
    return centres, cost


def _draw(seed: int, restart: int, step: int, total: int) -> int:
    """A whole number below ``total`` from 52 bits of an MD5."""
    return (int(hashlib.md5(f"{seed}|{restart}|{step}".encode()).hexdigest()[:13], 16) * total) >> 52


def _starts(points: DataFrame, k: int, restarts: int, seed: int) -> np.ndarray:
    """(restarts, k, 3) centres by k-means++: the first is the customer with the smallest MD5 of (seed, restart, key), each other one is drawn with
    a probability in proportion to the squared distance from the nearest centre so far.

    Customers stand in ranges of their key. A step adds up the exact distances per range and restart in one pass; the draw then falls in
    one range, and only there is the running total taken. What the driver sees are the sums of the ranges and the chosen rows.
    """
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = points.repartitionByRange(n, "Customer_Key").withColumn("_range", F.spark_partition_id()).checkpoint(eager=True)
    every = F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("r")
    smallest = F.min_by(F.struct(*Z), F.struct(F.md5(F.concat_ws("|", F.lit(seed), "r", "Customer_Key")), "Customer_Key")).alias("at")
    first = ranged.select(every, "Customer_Key", *Z).groupBy("r").agg(smallest).collect()
    if not first:
        return np.zeros((restarts, 0, 3), np.int64)
    centres = {r["r"]: [[r["at"][z] for z in Z]] for r in first}
    units = [F.col(z) for z in Z]
    for step in range(1, min(k, ranged.limit(k).count())):
        apart = {r: F.least(*d) if len(d := [_squared(units, np.array(c)) for c in own]) > 1 else d[0] for r, own in centres.items()}
        sums = ranged.groupBy("_range").agg(*(F.sum(d).cast("decimal(38,0)").alias(f"d{r}") for r, d in apart.items())).orderBy("_range").collect()
        wanted = {}
        for r in centres:
            left = _draw(seed, r, step, sum(int(s[f"d{r}"]) for s in sums))
            for s in sums:
                if left < int(s[f"d{r}"]):
                    wanted[r] = (s["_range"], left)
                    break
                left -= int(s[f"d{r}"])
        upto = Window.partitionBy("r").orderBy("Customer_Key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        chosen = {}
        if wanted:
            own = F.array_compact(F.array(*[F.when(F.col("_range") == at, F.struct(F.lit(r).alias("r"), F.lit(str(left)).cast("decimal(38,0)").alias("left"),
                                                                                   apart[r].alias("d"))) for r, (at, left) in wanted.items()]))
            rows = ranged.filter(F.col("_range").isin(sorted({at for at, _ in wanted.values()}))) \
                .select("Customer_Key", *Z, F.explode(own).alias("o")).select("Customer_Key", *Z, "o.*")
            hits = rows.withColumn("upto", F.sum("d").over(upto)).filter("upto > left").groupBy("r").agg(F.min_by(F.struct(*Z), "Customer_Key").alias("at"))
            chosen = {h["r"]: [h["at"][z] for z in Z] for h in hits.collect()}
        for r in centres:
            centres[r].append(chosen.get(r, centres[r][0]))  # no distance left: all customers stand on centres
    return np.array([centres[r] for r in range(restarts)], np.int64)


def segment_customers(features: DataFrame, k: int = 4, restarts: int = 10, seed: int = 42, max_iter: int = 300) -> DataFrame:
    """Adds Cluster (0 = best) and RFM_Segment (label by rank of mean composite score).

    k-means (Lloyd) from ``restarts`` starts seeded by squared distance (``_starts``); the
    restart with the least cost counts. An empty cluster keeps its centre.
    """
    if not 1 <= int(k) <= len(SEGMENT_LABELS):
        raise ValueError(f"k must be between 1 and {len(SEGMENT_LABELS)}")
    ensure_checkpoint_dir(features.sparkSession)
    ship_package(features.sparkSession)
    scored = rfm_scores(features).checkpoint(eager=True)
    points = _points(scored)
    starts = _starts(points, int(k), int(restarts), seed)
    if not starts.size:
        return scored.select("*", F.lit(0).alias("Cluster"), F.lit("").alias("RFM_Segment"))
    centres, cost = _lloyd(points, starts, max_iter)
    best = centres[min(range(len(cost)), key=lambda r: (cost[r], r))]
    units = [F.round(F.col(z) * UNITS).cast("long") + SHIFT * UNITS for z in Z]
    far = F.array(*[_squared(units, c) for c in best])
    clustered = scored.withColumn("_d", far).withColumn("_c", F.array_position("_d", F.array_min("_d"))).drop("_d")
    means = {r["_c"]: r["m"] for r in clustered.groupBy("_c").agg(F.avg("Composite_Score").alias("m")).collect()}  # k rows
    ranked = sorted(means, key=lambda c: (-means[c], c))
    place = F.array_position(F.array(*[F.lit(int(c)) for c in ranked]), F.col("_c").cast("int"))
    labels = F.array(*[F.lit(x) for x in SEGMENT_LABELS])
    return clustered.withColumn("Cluster", (place - 1).cast("int")) \
        .withColumn("RFM_Segment", F.element_at(labels, place.cast("int"))).drop("_c")


def segment_profile(segmented: DataFrame) -> DataFrame:
    """Customers and mean RFM values per segment (1 dp)."""
    return (segmented.groupBy("RFM_Segment")
            .agg(F.count("Customer_Key").alias("Customers"),
                 F.round(F.avg("Recency_Days"), 1).alias("Avg_Recency_Days"),
                 F.round(F.avg("Frequency"), 1).alias("Avg_Frequency"),
                 F.round(F.avg("Monetary"), 1).alias("Avg_Monetary"))
            .orderBy("RFM_Segment"))
