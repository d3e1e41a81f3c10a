"""The trend's mode against brute force, intervals, dates and odd series."""

from datetime import date, timedelta

import numpy as np
import pytest

from trendloom.operators import forecast
from trendloom.operators.forecast import Trend


def design(t, at):
    return np.column_stack([np.ones(len(t)), t, np.maximum(t[:, None] - at[None], 0)])


@pytest.mark.parametrize("seed", range(6))
def test_fit_is_a_mode(seed):
    """No coordinate, no pair of them and no random step from the fit makes the cost less."""
    draw = np.random.default_rng(seed)
    n = int(draw.integers(6, 11))
    t = np.linspace(0, 1, n)
    values = 1 + draw.normal(0, 0.15, n) + (2 * np.maximum(t - 0.5, 0) if seed % 2 else 0)
    how = Trend()
    m = forecast.fit(t, values, how)
    x, y = design(t, m.at), values / m.scale
    beta = np.concatenate([[m.level, m.slope], m.bends])
    best = forecast.cost(x, y, beta, m.noise, how)
    for step in (1e-1, 1e-2, 1e-3):
        for j in range(len(beta)):
            for s in (-step, step):
                assert forecast.cost(x, y, beta + s * np.eye(len(beta))[j], m.noise, how) >= best - 1e-7
        for _ in range(300):
            assert forecast.cost(x, y, beta + step * draw.normal(0, 1, len(beta)), m.noise, how) >= best - 1e-7
        for s in (-step, step):
            assert forecast.cost(x, y, beta, m.noise * (1 + s), how) >= best - 1e-7


def test_lines_stay_lines():
    t = np.linspace(0, 1, 10)
    m = forecast.fit(t, 2 + t, Trend())
    assert np.allclose(m.trend(np.array([0.0, 1.0, 1.5])) * m.scale, [2, 3, 3.5], atol=0.02)
    flat = forecast.fit(t, np.full(10, 0.7), Trend())
    assert np.allclose(flat.trend(t) * flat.scale, 0.7) and flat.noise < 1e-6
    assert len(forecast.change_points(t, Trend())) == 7 and np.allclose(forecast.change_points(t, Trend()), t[1:8])


def test_bends_are_found():
    t = np.linspace(0, 1, 40)
    m = forecast.fit(t, np.where(t < 0.5, 1.0, 1.0 + 6 * (t - 0.5)) + 0.02 * np.sin(np.arange(40) * 7), Trend())
    inside = (m.at > 0.4) & (m.at < 0.6)
    assert inside[np.argsort(-np.abs(m.bends))[:2]].all() and 1.2 < m.bends[inside].sum() < 1.6  # of 6 / 4, as values are scaled


def test_interval_covers():
    """Four fifths of what the model itself makes lies within; futures widen it."""
    t = np.concatenate([np.linspace(0, 1, 10), 1 + np.arange(1, 5) / 9])
    m = forecast.Fitted(1.0, 0.2, np.linspace(0.1, 0.8, 7), np.full(7, 0.3), 0.1, 1.0)
    low, high = forecast.interval(m, t, Trend(futures=4000), 1)
    draw = np.random.default_rng(9)
    seen = m.trend(t)[:10] + draw.normal(0, 0.1, (4000, 10))
    assert abs(((seen >= low[:10]) & (seen <= high[:10])).mean() - 0.8) < 0.02
    widths = high - low
    assert widths[-1] > widths[10] > widths[:10].mean() * 0.95 and np.all((low < m.trend(t)) & (m.trend(t) < high))


def test_series(spark):
    monday = date(2024, 1, 1)
    week = lambda k: monday + timedelta(days=7 * k)
    rows = [("a", week(k), 1.0 + 0.05 * k) for k in range(14)] + [("short", week(k), 1.0) for k in range(5)] + [("odd", week(k), v) for k, v in enumerate([None, 50.0, 0.0, 1.0, 1.1, 0.9, 1.0, 1.2, 1.0, float("nan"), 1.1])]
    rows += [("few", week(k), 1.0 if k < 5 else None) for k in range(12)] + [(None, week(k), 1.0) for k in range(12)]
    got = forecast.trend_forecast(spark.createDataFrame(rows, "category string, week date, spike_ww double")).collect()
    by = {c: sorted((r for r in got if r["category"] == c), key=lambda r: r["ds"]) for c in {r["category"] for r in got}}
    assert set(by) == {"a", "odd"}
    a = by["a"]
    assert [r["ds"] for r in a] == [*(week(k) for k in range(4, 14)), *(date(2024, 4, 7) + timedelta(days=7 * k) for k in range(4))]
    assert [r["actual"] for r in a] == [*(1.0 + 0.05 * k for k in range(4, 14)), *[None] * 4]
    assert all(r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"] for r in a) and a[-1]["yhat"] > 1.6
    assert sum(r["actual"] is not None for r in by["odd"]) == 7
    again = forecast.trend_forecast(spark.createDataFrame(rows, "category string, week date, spike_ww double")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert forecast.trend_forecast(spark.createDataFrame([], "category string, week date, spike_ww double")).count() == 0
