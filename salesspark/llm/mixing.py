"""Operator 5: mixing sources to target weights by pivotal dependent rounding.

Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share ``share`` times all sizes; a source stops at
``cap`` times its own size and the excess goes to the others by weight (water-filling, in closed form over one row per source). A
document of a source with target / size = r is taken floor(r) times and once more with probability r - floor(r).

Those probabilities are rounded so that their sum per source stays whole: two documents meet, and mass moves at random
from one to the other until one of them is 0 or 1; the other one meets the next document. Documents meet in order of size within
leaves of about ``leaf_rows`` rows (a hash of ``doc_id``, size and the row's number among equal ones deals them out, so a source with a third
of all rows has proportionally many leaves, and rows without id or with one id spread, too). Each leaf leaves at most one document undecided; those meet in the next level of a tree, ``FAN_IN``
leaves at a time, until one per source is left, which a last draw decides. All draws are seeded by source, level and leaf:
reruns agree, however Spark deals out the rows.

Defined results: a null text has size 0; documents of size 0 take 0 words. A null ``doc_id`` is a value like any other. Rows
that repeat others are rows of their own. A table without words has targets of 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesspark.llm.common import hash128, settled, word_count
from salesspark.llm.ordered import running_by_key

WEIGHTS = (3, 1, 2)
FAN_IN = 512
NEAR = 1e-9
#: Copies of a row that are made at once.
PART = 10_000


def source_targets(sized: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """One row per source: source, s_idx, source_size, n_rows, target."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s_idx") % len(weights) + 1).cast("int"))
    s = per.withColumn("s_idx", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(cap))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "s_idx")
    every = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(every))
    return s.select("source", "s_idx", "source_size", "n_rows",
                    F.coalesce(F.least("cap", F.col("w") * F.col("level")), F.col("cap")).alias("target"))


def pair_off(p: np.ndarray, seed: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """Round ``p`` in its order; the index of the one that stays fractional, or -1. The sum stays the same."""
    p, draw, held = p.copy(), np.random.default_rng(seed).random(len(p)).tolist(), -1
    for i in range(len(p)):
        if not NEAR < p[i] < 1 - NEAR:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = p[held], p[i]
        both = a + b
        if both <= 1:
            first = draw[i] * both < a
            p[held], p[i] = (both, 0.0) if first else (0.0, both)
        else:
            first = draw[i] * (2 - both) < 1 - b
            p[held], p[i] = (1.0, both - 1) if first else (both - 1, 1.0)
        pair, held = (held, i), -1
        for k in pair:
            if NEAR < p[k] < 1 - NEAR:
                held = k
            else:
                p[k] = round(p[k])
    return p, held


def _level(rows: DataFrame, seed: int, level: int, last: bool) -> DataFrame:
    """Pair off the rows of each (s_idx, leaf); in the last level a draw decides the one left over."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id"], kind="stable", ignore_index=True)
        at = (seed, level, int(pdf["s_idx"].iloc[0]), int(pdf["leaf"].iloc[0]))
        p, left = pair_off(pdf["p"].to_numpy(float), at)
        if last and left >= 0:
            p[left] = float(np.random.default_rng((*at, 1)).random() < p[left])
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        return pdf.assign(p=p)

    return rows.groupBy("s_idx", "leaf").applyInPandas(run, rows.schema)


def round_copies(rows: DataFrame, seed: int = 7, leaf_rows: int = 1024) -> DataFrame:
    """``rows`` (doc_id long, s_idx int, n_rows long, size long, nth long, p double) with p rounded to 0 or 1 per source; ``nth`` is the
    row's number among those that agree in doc_id, source and size."""
    n_leaf = F.ceil(F.col("n_rows") / leaf_rows).cast("long")
    leaf = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "size", "nth"), n_leaf)
    level, done = rows.select("doc_id", "s_idx", "size", "p", leaf.alias("leaf")), []
    most = rows.agg(F.max(n_leaf)).first()[0] or 1
    open_ = ~F.col("p").isin(0.0, 1.0)
    for k in range(64):
        last = most == 1
        now = settled(_level(level, seed, k, last))
        done.append(now.filter(~open_))
        if last:
            break
        level = now.filter(open_).withColumn("leaf", F.floor(F.col("leaf") / FAN_IN))
        most = -(-most // FAN_IN)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "s_idx", "size", "p")


def mix(docs: DataFrame, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source",
        text_col: str = "text", share: float = 1.5, cap: float = 2.0, seed: int = 7, leaf_rows: int = 1024) -> DataFrame:
    """doc_id, source, size, source_size, target and ``copies`` (how often the mix takes it) of each row."""
    size = word_count(F.col(text_col)) if size is None else size
    slim = settled(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"),
                               size.cast("long").alias("size"))).withColumn("at", F.monotonically_increasing_id())
    sized = numbered(slim, ["doc_id", "source", "size"])
    targets = settled(source_targets(sized, share, cap))
    t = targets.withColumnRenamed("source", "t_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = sized.join(t, sized["source"].eqNullSafe(t["t_source"])).withColumn("rate", rate)
    whole = F.floor("rate")
    dealt = round_copies(rated.withColumn("p", F.col("rate") - whole), seed, leaf_rows)
    return (dealt.join(targets.withColumn("rate", rate).withColumn("whole", whole), "s_idx")
            .select("doc_id", "source", "size", "source_size", "target",
                    (F.col("whole") + F.col("p").cast("long")).alias("copies")))


def numbered(rows: DataFrame, alike: list[str]) -> DataFrame:
    """``rows`` with ``nth``, their number (from 1) among the rows that agree in ``alike``, in the order of ``at``; a group of any size spreads
    over ranges."""
    keyed = rows.withColumn("alike", F.struct(*hash128(F.struct(*alike), "m1", "m2")))
    return settled(running_by_key(keyed, "alike", [F.col("at")], {}, place="nth").drop("alike"))


def take_copies(docs: DataFrame, **rule) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, with the same columns.

    Rows that agree in ``doc_id``, source and size have the same rate, so of the copies that their group takes each row gets the whole part, and
    the first ones, in a fixed order of their contents, one more. Groups are counted by content first, so neither a group of many rows nor
    many rows of one content meet in a task.
    """
    id_col, source_col, text_col = (rule.get(k, d) for k, d in (("id_col", "doc_id"), ("source_col", "source"), ("text_col", "text")))

    def key(doc: Column, source: Column, size: Column) -> Column:
        return F.struct(*hash128(F.struct(doc.cast("long"), source, size.cast("long")), "m1", "m2")).alias("m")

    taken = mix(docs, **rule).select(key(F.col("doc_id"), F.col("source"), F.col("size")), "copies").groupBy("m").agg(
        F.min("copies").alias("each"), (F.sum("copies") - F.min("copies") * F.count(F.lit(1))).alias("more"))
    size = word_count(F.col(text_col)) if rule.get("size") is None else rule["size"]
    rows = docs.select(F.struct("*").alias("row"), key(F.col(id_col), F.col(source_col), size), *hash128(F.struct("*"), "r1", "r2"))
    contents = rows.groupBy("m", "r1", "r2").agg(F.count(F.lit(1)).alias("n"))
    placed = running_by_key(contents, "m", [F.col("r1"), F.col("r2")], {"upto": "n"}).join(taken, "m")
    extra = F.greatest(F.lit(0), F.least(F.col("n"), F.col("more") - F.col("upto") + F.col("n")))
    counts = settled(placed.select("r1", "r2", "n", "each", extra.alias("extra")))
    every = F.col("each") + F.when(F.col("extra") == F.col("n"), 1).otherwise(0)
    whole = rows.join(counts, ["r1", "r2"]).select("row", F.explode(F.array_repeat(F.lit(0), every.cast("int"))))
    partly = rows.join(counts.filter("extra > 0 AND extra < n"), ["r1", "r2"]).dropDuplicates(["r1", "r2"]) \
        .select("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("extra") - 1, F.lit(PART).cast("long"))).alias("at"), "extra")
    more = partly.select("row", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(PART), F.col("extra") - F.col("at")).cast("int"))))
    return whole.select("row").unionByName(more.select("row")).select("row.*")
