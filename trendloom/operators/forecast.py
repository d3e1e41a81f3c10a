"""Forecasts of short series: a piecewise-linear trend with penalised change points and simulated intervals.

The trend bends at points laid evenly over the first four fifths of a series. Slopes and level have a normal prior, bends a
Laplace prior (most become zero), the noise a half-normal one; the fit is the mode found by turns: noise by its closed
form, the rest by coordinate descent. Ahead of the series, bends come at the rate and size of those before, and the
interval is that of many such futures with noise. A series' simulation is seeded by its name, so a task that runs again
gives the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Trend:
    bends: int = 25  #: change points at most
    bend_range: float = 0.8  #: of the series, where they may be
    bend_scale: float = 0.2  #: of the Laplace prior
    slope_scale: float = 5.0
    noise_scale: float = 0.5
    width: float = 0.8  #: of the interval
    futures: int = 1000
    rounds: int = 200


@dataclass
class Fitted:
    level: float
    slope: float
    at: np.ndarray  #: change points, on the scale where the series takes 0 to 1
    bends: np.ndarray
    noise: float
    scale: float  #: of the values

    def trend(self, t: np.ndarray) -> np.ndarray:
        return self.level + self.slope * t + np.maximum(t[:, None] - self.at[None], 0) @ self.bends


def change_points(t: np.ndarray, how: Trend) -> np.ndarray:
    held = int(len(t) * how.bend_range)
    n = min(how.bends, held - 1)
    return t[np.round(np.linspace(0, held - 1, n + 1)).astype(int)][1:] if n > 0 else np.empty(0)


def cost(x: np.ndarray, y: np.ndarray, beta: np.ndarray, noise: float, how: Trend) -> float:
    """What the fit makes least: minus the logarithm of the posterior. ``beta`` is level, slope, bends."""
    left = y - x @ beta
    return float(left @ left / (2 * noise**2) + len(y) * np.log(noise) + beta[:2] @ beta[:2] / (2 * how.slope_scale**2) + np.abs(beta[2:]).sum() / how.bend_scale + noise**2 / (2 * how.noise_scale**2))


def fit(t: np.ndarray, values: np.ndarray, how: Trend) -> Fitted:
    """``t`` from 0 to 1, ascending; at least two values."""
    scale = float(np.abs(values).max()) or 1.0
    y, at = values / scale, change_points(t, how)
    if np.ptp(values) == 0:
        return Fitted(float(y[0]), 0.0, at, np.zeros(len(at)), 1e-9, scale)
    x = np.column_stack([np.ones(len(t)), t, np.maximum(t[:, None] - at[None], 0)])
    slope = (y[-1] - y[0]) / (t[-1] - t[0])
    beta = np.concatenate([[y[0] - slope * t[0], slope], np.zeros(len(at))])
    gram, target = x.T @ x, x.T @ y
    noise, before = 1.0, np.inf
    for _ in range(how.rounds):
        ridge = noise**2 / how.slope_scale**2
        least = noise**2 / how.bend_scale
        for _ in range(500):
            moved = 0.0
            for j in range(len(beta)):
                pull = target[j] - gram[j] @ beta + gram[j, j] * beta[j]
                new = pull / (gram[j, j] + ridge) if j < 2 else np.sign(pull) * max(abs(pull) - least, 0.0) / gram[j, j]
                moved = max(moved, abs(new - beta[j]))
                beta[j] = new
            if moved < 1e-9:
                break
        left = y - x @ beta
        rss, n, p = float(left @ left), len(y), 1 / how.noise_scale**2
        noise = max(1e-6, float(np.sqrt((-n + np.sqrt(n * n + 4 * p * rss)) / (2 * p))))
        now = cost(x, y, beta, noise, how)
        if before - now < 1e-10:
            break
        before = now
    return Fitted(float(beta[0]), float(beta[1]), at, beta[2:], noise, scale)


def interval(model: Fitted, t: np.ndarray, how: Trend, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of simulated values at ``t``; bends come beyond 1 only."""
    draw = np.random.default_rng(seed)
    told, last = model.trend(t), float(t[-1])
    sums = np.tile(told, (how.futures, 1))
    if last > 1 and len(model.at):
        size = float(np.abs(model.bends).mean()) + 1e-8
        number = draw.poisson(len(model.at) * (last - 1), how.futures)
        for k in range(int(number.max(initial=0))):
            where = draw.uniform(1, last, how.futures)
            bend = draw.laplace(0, size, how.futures) * (number > k)
            sums += bend[:, None] * np.maximum(t[None] - where[:, None], 0)
    sums += draw.normal(0, model.noise, sums.shape)
    low = (1 - how.width) / 2
    return tuple(np.quantile(sums, [low, 1 - low], axis=0))


def carried_on(name: str | None, days: list[date], values: list[float], steps: int, how: Trend) -> list[tuple]:
    """``ds, yhat, yhat_lower, yhat_upper, actual`` of the series and of the Sundays after it."""
    first, last = days[0], days[-1]
    sunday = last + timedelta(days=(6 - last.weekday() - 1) % 7 + 1)
    ahead = [sunday + timedelta(days=7 * k) for k in range(steps)]
    span = (last - first).days
    t = np.array([(d - first).days / span for d in [*days, *ahead]])
    model = fit(t[: len(days)], np.array(values, dtype=np.float64), how)
    low, high = interval(model, t, how, zlib.crc32((name or "").encode()))
    clip = lambda v: [round(max(0.0, float(u) * model.scale), 3) for u in v]
    return list(zip([*days, *ahead], clip(model.trend(t)), clip(low), clip(high), [*values, *[None] * steps], strict=True))


def trend_forecast(rows: DataFrame, value: str = "spike_ww", last: int = 10, least: int = 6, steps: int = 4, least_weeks: int = 10, how: Trend | None = None) -> DataFrame:
    """``category, ds, yhat, yhat_lower, yhat_upper, actual``: history and what comes after it.

    From ``category, week`` (a date, each once) and the value; the last points in [0.01, 10] of categories with
    ``least_weeks`` rows. Nulls and values outside are left out; a category with fewer than ``least`` points, or all of them
    on one day, has no forecast. A series has at most ``last`` points, so what travels for it is bounded.
    """
    how = how or Trend()
    newest = Window.partitionBy("category").orderBy(F.col("week").desc())
    many = rows.groupBy("category").agg(F.count("*").alias("n")).where(F.col("n") >= least_weeks).select("category")
    held = rows.where(F.col(value).between(0.01, 10)).withColumn("__back", F.row_number().over(newest)).where(F.col("__back") <= last)
    series = held.groupBy("category").agg(F.array_sort(F.collect_list(F.struct(F.col("week").cast("date").alias("week"), F.col(value).cast("double").alias("y")))).alias("own")).where((F.size("own") >= least) & (F.col("own")[0]["week"] < F.element_at("own", -1)["week"])).join(many, "category")
    kinds = (pa.date32(), pa.float64(), pa.float64(), pa.float64(), pa.float64())
    names = ["ds", "yhat", "yhat_lower", "yhat_upper", "actual"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = carried_on(name, [p["week"] for p in own], [p["y"] for p in own], steps, how)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(made), pa.string()), *(pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds))], names=["category", *names])

    return series.select(F.col("category").cast("string").alias("category"), "own").mapInArrow(run, "category string, ds date, yhat double, yhat_lower double, yhat_upper double, actual double")
