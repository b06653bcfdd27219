"""Churn classifier on the leakage-free table, held-out metrics, risk tiers.

A forest of 200 trees of depth 6 with balanced class weights (``operators/forest.py``), trained on the stratified split's training side.
Every figure is exact in the sense that no order of summation and no approximation of a curve enters it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesspark.operators.customers import holdout_split
from salesspark.operators.forest import UNIT, Forest, grow, summed_probability
from salesspark.plans.prefix import running_total
from salesspark.session import ensure_checkpoint_dir, ship_package

FEATURES = ["Frequency", "Monetary", "Avg_Order_Value", "Tenure_Days", "Customer_Rating"]
# Right-closed risk tiers on the churn probability.
RISK_TIERS = ((0.33, "Low Risk"), (0.66, "Medium Risk"), (1.0, "High Risk"))


@dataclass
class ChurnModel:
    model: Forest
    metrics: DataFrame
    importance: DataFrame


def _prepare(labeled: DataFrame) -> DataFrame:
    data = labeled.fillna(0, FEATURES)
    return data.select(*[F.col(c).cast("double").alias(c) if c in FEATURES else F.col(c) for c in data.columns])


def roc_auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """M9: one row with ``roc_auc``, the share of (positive, negative) pairs that ``score`` puts in order, ties for a half; NaN if a class
    is missing. Rows meet by distinct score, and a running total over ranges counts the negatives below each: exact, and no task sorts all."""
    classes = scored.groupBy(F.col(score).alias("s")).agg(
        F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    ranked = running_total(classes, "q", [F.col("s")], out="upto")
    whole = F.col("p").cast("decimal(19,0)") * (2 * F.col("upto") - F.col("q")).cast("decimal(19,0)")
    pairs = ranked.agg(F.sum(whole).cast("double").alias("twice"), F.sum("p").cast("double").alias("p"), F.sum("q").cast("double").alias("q"))
    both = F.col("p") * F.col("q") > 0
    return pairs.select(F.when(both, F.try_divide(F.col("twice"), 2.0 * F.col("p") * F.col("q"))).otherwise(float("nan")).alias("roc_auc"))


def train_churn(labeled: DataFrame, trees: int = 200, depth: int = 6, seed: int = 42,
                test_pct: int = 25) -> ChurnModel:
    spark = labeled.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    split = holdout_split(_prepare(labeled), test_pct=test_pct)  # stands on a checkpoint already
    counts = {(r["Split"], r["Churned"]): r["n"] for r in
              split.groupBy("Split", "Churned").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not all(counts.get((side, c)) for side in ("train", "test") for c in (0, 1)):
        raise ValueError(f"both classes are needed on either side of the split, got {counts}")
    forest = grow(split.filter(F.col("Split") == "train"), FEATURES, "Churned", "Customer_Key", (counts["train", 0], counts["train", 1]),
                  trees, depth, seed)

    test = summed_probability(split.filter(F.col("Split") == "test"), forest, "_sum").select("_sum", "Churned").checkpoint(eager=True)
    said, true = F.col("_sum") * 2 > F.lit(forest.trees * UNIT), F.col("Churned") == 1
    conf = test.agg(
        F.count(F.lit(1)).alias("n"), F.sum((said & true).cast("long")).alias("tp"), F.sum((said & ~true).cast("long")).alias("fp"),
        F.sum((~said & true).cast("long")).alias("fn"), F.sum((~said & ~true).cast("long")).alias("tn"))
    rows, positive = sum(counts.values()), counts["train", 1] + counts["test", 1]
    metrics = conf.select(
        ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"),
        F.when(F.col("tp") + F.col("fp") > 0, F.try_divide("tp", F.col("tp") + F.col("fp"))).otherwise(0.0).alias("precision"),
        F.when(F.col("tp") + F.col("fn") > 0, F.try_divide("tp", F.col("tp") + F.col("fn"))).otherwise(0.0).alias("recall"),
        roc_auc(test, "_sum", "Churned").scalar().alias("roc_auc"),
        F.lit(100.0 * positive / rows).alias("churn_rate_actual"))
    importance = spark.createDataFrame(list(zip(FEATURES, forest.importance(), strict=True)), "Feature string, Importance double") \
        .orderBy(F.col("Importance").desc(), "Feature")
    return ChurnModel(forest, metrics, importance)


def predict_risk(model: ChurnModel, labeled: DataFrame) -> DataFrame:
    """Churn probability and tier for every customer, highest risk first."""
    whole = summed_probability(labeled, model.model, "_sum")
    scored = whole.withColumn("Churn_Probability", F.col("_sum").cast("double") / F.lit(float(model.model.trees * UNIT)))
    tier, lo = None, -0.01
    for hi, label in RISK_TIERS:
        cond = (F.col("Churn_Probability") > lo) & (F.col("Churn_Probability") <= hi)
        tier = F.when(cond, F.lit(label)) if tier is None else tier.when(cond, F.lit(label))
        lo = hi
    return (scored.select(*labeled.columns, "Churn_Probability", tier.alias("Risk_Tier"))
            .orderBy(F.col("Churn_Probability").desc(), F.col("Customer_Key")))


def risk_tier_counts(risk: DataFrame) -> DataFrame:
    """A15."""
    return risk.groupBy("Risk_Tier").agg(F.count(F.lit(1)).alias("Customers")).orderBy("Risk_Tier")
