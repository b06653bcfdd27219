"""The closed-form forecast against minimum-norm least squares (what an intercept
linear regression on trend + 12 month dummies computes)."""

import numpy as np
import pytest

from salesspark.operators.forecast import forecast


def lstsq_forecast(rows, horizon):
    rows = sorted(rows)
    years = np.array([r[0] for r in rows])
    months = np.array([r[1] for r in rows])
    y = np.array([r[2] for r in rows], dtype=float)
    first = years[0]
    t = (years - first) * 12 + months

    def design(tt, mm):
        d = np.zeros((len(mm), 12))
        d[np.arange(len(mm)), mm - 1] = 1.0
        return np.hstack([tt.reshape(-1, 1).astype(float), d])

    x = design(t, months)
    xm, ym = x.mean(axis=0), y.mean()
    beta = np.linalg.lstsq(x - xm, y - ym, rcond=None)[0]
    icpt = ym - xm @ beta
    fitted = x @ beta + icpt
    fut = np.arange(t[-1] + 1, t[-1] + 1 + horizon)
    fm = (fut - 1) % 12 + 1
    pred = np.clip(design(fut, fm) @ beta + icpt, 0, None)
    fy = first + (fut - fm) // 12
    mae = np.mean(np.abs(y - fitted))
    mape = np.mean(np.abs(y - fitted) / np.maximum(np.abs(y), np.finfo(float).eps)) * 100
    return list(zip(fy.tolist(), fm.tolist(), pred.tolist())), mae, mape


def run(spark, rows, horizon=6):
    df = spark.createDataFrame([("S", y, m, float(v)) for y, m, v in rows], "Series string, Year int, Month int, Net_Revenue double")
    combined, errors = forecast(df, horizon)
    fc = sorted((r["Year"], r["Month"], r["Net_Revenue"]) for r in combined.filter("Type = 'Forecast'").collect())
    err = errors.collect()
    return fc, err


CASES = {
    "40_months_with_gap": [(2020 + (i - 1) // 12, (i - 1) % 12 + 1, 1000 + 37 * i + 200 * ((i % 12) in (11, 0)) + (i * 7919) % 97)
                           for i in range(1, 45) if i not in (5, 17)],
    "exactly_12_months": [(2021 + (i + 2) // 12, (i + 2) % 12 + 1, 500.0 + 13 * i + (i * 31) % 17) for i in range(12)],
    "unseen_month": [(2019 + (i - 1) // 12, (i - 1) % 12 + 1, 800.0 + 5 * i + (i * 13) % 29)
                     for i in range(1, 30) if (i - 1) % 12 + 1 != 7],
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_closed_form_matches_least_squares(spark, case):
    rows = CASES[case]
    got, err = run(spark, rows, 6)
    want, mae, mape = lstsq_forecast(rows, 6)
    assert [(y, m) for y, m, _ in got] == [(y, m) for y, m, _ in want]
    for (_, _, g), (_, _, w) in zip(got, want):
        assert g == pytest.approx(round(w, 2), abs=0.011)
    assert err[0]["MAE"] == pytest.approx(mae, abs=0.01)
    assert err[0]["MAPE"] == pytest.approx(mape, abs=1e-3)


def test_december_year_label(spark):
    rows = [(2022, m, 100.0 + m) for m in range(1, 13)] + [(2023, m, 110.0 + m) for m in range(1, 12)]
    got, _ = run(spark, rows, 3)
    assert [(y, m) for y, m, _ in got] == [(2023, 12), (2024, 1), (2024, 2)]


def test_short_history_gets_no_forecast(spark):
    got, err = run(spark, [(2022, m, 10.0 * m) for m in range(1, 12)])
    assert got == [] and err == []


def test_forecast_clipped_at_zero(spark):
    rows = [(2020 + (i - 1) // 12, (i - 1) % 12 + 1, max(0.0, 5000 - 150.0 * i)) for i in range(1, 37)]
    got, _ = run(spark, rows, 6)
    assert all(v >= 0 for _, _, v in got)
