"""Seasonal trend forecast per series, without a solver.

The reference fits ``y ~ trend + 12 month dummies`` by least squares (minimum-norm
solution, intercept fitted). With month dummies the slope is the within-month
regression, and every seen month's level is its own mean:

* some calendar month seen twice:  b = S_xy / S_xx over month-demeaned t and y,
  prediction ``ybar_m + b (t - tbar_m)``; an unseen month gets the mean level of
  the seen months, ``mean_m(ybar_m - b tbar_m) + b t`` (the minimum-norm choice);
* every month seen once (exactly 12 rows, the only other case the 12-month guard
  lets through): minimum norm gives ``b = S_xy / (1 + S_xx)`` on the series-demeaned
  t and y, and the same ``ybar_m + b (t - tbar_m)``.

All of it is grouped aggregation and windows partitioned by series, so one job
serves any number of series. Missing months are not filled; the trend index is
calendar based, so gaps stay gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesspark.functions.scalars import clip_at_zero
from salesspark.functions.filters import apply_filters

SERIES_COLUMNS = ["Year", "Month", "Net_Revenue"]
# Minimum months of history before a series is forecast.
MIN_MONTHS = 12
# Machine epsilon used as the MAPE floor (float64).
EPS = 2.220446049250313e-16


def monthly_series(view: DataFrame, series: str | None = None, filters: dict | None = None) -> DataFrame:
    """(Series, Year, Month, Net_Revenue) - one row per series and calendar month with sales."""
    key = F.col(series).cast("string") if series else F.lit("All")
    return (apply_filters(view, filters)
            .groupBy(key.alias("Series"), "Year", "Month")
            .agg(F.sum("Net_Revenue").cast("double").alias("Net_Revenue")))


def _fit(monthly: DataFrame, min_months: int):
    s = Window.partitionBy("Series")
    sm = Window.partitionBy("Series", "Month")
    base = (monthly
            .withColumn("_rows", F.count(F.lit(1)).over(s))
            .filter(F.col("_rows") >= int(min_months))
            .withColumn("_first_year", F.min("Year").over(s))
            .withColumn("_t", (F.col("Year") - F.col("_first_year")) * 12 + F.col("Month"))
            .withColumn("_tm", F.avg("_t").over(sm))
            .withColumn("_ym", F.avg("Net_Revenue").over(sm))
            .withColumn("_tbar", F.avg("_t").over(s))
            .withColumn("_ybar", F.avg("Net_Revenue").over(s)))
    y, t = F.col("Net_Revenue"), F.col("_t")
    series = (base.groupBy("Series")
              .agg(F.sum((t - F.col("_tm")) * (y - F.col("_ym"))).alias("_sxy_m"),
                   F.sum((t - F.col("_tm")) * (t - F.col("_tm"))).alias("_sxx_m"),
                   F.sum((t - F.col("_tbar")) * (y - F.col("_ybar"))).alias("_sxy"),
                   F.sum((t - F.col("_tbar")) * (t - F.col("_tbar"))).alias("_sxx"),
                   F.min("_first_year").alias("_first_year"),
                   F.max("_t").alias("_last_t"))
              .withColumn("Slope", F.when(F.col("_sxx_m") > 0, F.col("_sxy_m") / F.col("_sxx_m"))
                          .otherwise(F.col("_sxy") / (F.lit(1.0) + F.col("_sxx"))))
              .select("Series", "Slope", "_first_year", "_last_t"))
    levels = (base.groupBy("Series", "Month").agg(F.first("_tm").alias("_tm"), F.first("_ym").alias("_ym"))
              .join(series.select("Series", "Slope"), "Series")
              .select("Series", "Month", (F.col("_ym") - F.col("Slope") * F.col("_tm")).alias("_level")))
    mean_level = levels.groupBy("Series").agg(F.avg("_level").alias("_mean_level"))
    return base, series.join(mean_level, "Series"), levels


def forecast(monthly: DataFrame, horizon: int = 6, min_months: int = MIN_MONTHS):
    """Returns ``(history_and_forecast, errors)``.

    ``history_and_forecast``: (Series, Year, Month, Period, Net_Revenue, Type) with
    Type 'Actual' for history and 'Forecast' for the next ``horizon`` months
    (clipped at 0). ``errors``: in-sample MAE and MAPE % per series.
    """
    base, series, levels = _fit(monthly, min_months)
    fitted = (base.join(levels, ["Series", "Month"]).join(series.select("Series", "Slope"), "Series")
              .withColumn("_fit", F.col("_level") + F.col("Slope") * F.col("_t")))
    err = F.abs(F.col("Net_Revenue") - F.col("_fit"))
    errors = (fitted.groupBy("Series")
              .agg(F.count(F.lit(1)).alias("Months"),
                   F.first("Slope").alias("Slope"),
                   F.avg(err).alias("MAE"),
                   (F.avg(err / F.greatest(F.abs(F.col("Net_Revenue")), F.lit(EPS))) * F.lit(100.0)).alias("MAPE"))
              .select("Series", "Months", "Slope", "MAE", "MAPE"))

    future = (series.select("Series", "Slope", "_first_year", "_mean_level",
                            F.explode(F.sequence(F.col("_last_t") + 1, F.col("_last_t") + int(horizon))).alias("_t"))
              .withColumn("Month", ((F.col("_t") - 1) % 12 + 1).cast("int"))
              .withColumn("Year", (F.col("_first_year") + F.floor((F.col("_t") - F.col("Month")) / 12)).cast("int"))
              .join(levels, ["Series", "Month"], "left")
              .select("Series", "Year", "Month",
                      clip_at_zero(F.coalesce(F.col("_level"), F.col("_mean_level"))
                                   + F.col("Slope") * F.col("_t")).alias("Net_Revenue"),
                      F.lit("Forecast").alias("Type")))
    history = base.select("Series", "Year", "Month", "Net_Revenue", F.lit("Actual").alias("Type"))
    combined = history.unionByName(future).withColumn(
        "Period", F.concat_ws("-", F.col("Year").cast("string"), F.lpad(F.col("Month").cast("string"), 2, "0")))
    return combined.select("Series", "Year", "Month", "Period", "Net_Revenue", "Type"), errors
