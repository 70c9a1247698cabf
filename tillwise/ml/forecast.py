"""Weekly revenue series and their seasonal forecast.

The trend is a line with bends at given places, few of which are used: bends carry an L1 penalty and are
fitted by coordinate descent, so most of them are exactly zero.  Seasons are waves with a small ridge.
The future may bend as often and as sharply as the history did; the interval is taken from draws of such
futures.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions import as_date, cents, money, ratio_round
from tillwise.operators.grain import paid_orders
from tillwise.params import DEFAULTS

# fixed values: seasonal periods in days with the number of waves fitted for each
SEASONS = {365.25: 10, 7.0: 3}
# fixed values: possible bends, the scale of their prior, and the part of the history that may bend
BENDS, BEND_SCALE, BEND_RANGE = 25, 0.05, 0.8
WAVE_PENALTY = 0.01
ROUNDS = 8
DRAWS = 2000
LEAST_NOISE = 0.03**2  # of the level: without noise, bends would stand for waves


def weekly_revenue(
    orders: DataFrame, payments: DataFrame, keys: DataFrame | None = None
) -> DataFrame:
    """Revenue per week (its Monday) as (ds, y).

    ``keys`` maps order_id to further columns; there is one series per value of those.
    """
    paid = paid_orders(orders, payments)
    by = []
    if keys is not None:
        by = [c for c in keys.columns if c != "order_id"]
        paid = paid.join(keys, "order_id")
    week = F.trunc("order_purchase_timestamp", "week").alias("ds")
    return paid.groupBy(*by, week).agg(money(F.sum("pay")).alias("y"))


def bend_places(span: float, bends: int) -> np.ndarray:
    """Days on which the trend may bend, evenly over the first part of the history."""
    return np.linspace(0, BEND_RANGE * span, bends + 1)[1:]


def _trend(days: np.ndarray, span: float, bends: int) -> np.ndarray:
    """Level, slope, and a further slope from each of the places where the trend may bend."""
    turns = [np.maximum(days - p, 0) / span for p in bend_places(span, bends)]
    return np.column_stack([np.ones(len(days)), days / span, *turns])


def _waves(days: np.ndarray, seasons: Mapping[float, int]) -> np.ndarray:
    angles = [2 * np.pi * w * days / period for period, n in seasons.items() for w in range(1, n + 1)]
    return np.column_stack([f(a) for a in angles for f in (np.sin, np.cos)] or [np.zeros(len(days))])


def sparse_fit(
    free: np.ndarray, ridge: np.ndarray, sparse: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray
):
    """Coefficients of least squares with a ridge on ``free`` and an L1 penalty on ``sparse``.

    The free part is projected out, then coordinate descent goes over the sparse part, from ``start`` on:
    each coefficient is the shrunken fit to what the others leave.  Sweeps over all alternate with sweeps
    over those that are not zero.
    """
    gram = free.T @ free + np.diag(ridge)
    both = np.linalg.solve(gram, free.T @ np.column_stack([sparse, y]))
    cross = sparse.T @ sparse - sparse.T @ free @ both[:, :-1]
    beta, size = start.copy(), np.maximum(np.diag(cross), 1e-12)
    left = sparse.T @ y - sparse.T @ free @ both[:, -1] - cross @ beta

    def sweep(places) -> float:
        moved = 0.0
        for j in places:
            pull = left[j] + size[j] * beta[j]
            step = np.sign(pull) * max(abs(pull) - penalty, 0.0) / size[j] - beta[j]
            if step:
                beta[j] += step
                left[:] -= cross[:, j] * step
                moved = max(moved, abs(step))
        return moved

    for _ in range(50):
        if sweep(range(len(beta))) < 1e-5:
            break
        for _ in range(100):
            if sweep(np.flatnonzero(beta)) < 1e-5:
                break
    return both[:, -1] - both[:, :-1] @ beta, beta


def refitted(free: np.ndarray, ridge: np.ndarray, sparse: np.ndarray, y: np.ndarray):
    """Coefficients of the bends in use without their penalty, and the covariance of all per unit of noise."""
    both = np.column_stack([free, sparse])
    spread = np.linalg.inv(both.T @ both + np.diag([*ridge, *np.full(sparse.shape[1], 1e-4)]))
    return (spread @ (both.T @ y))[free.shape[1] :], spread, float(np.trace(spread @ (both.T @ both)))


def future_bends(ahead: np.ndarray, rate: float, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Draws x days: how far futures leave the trend that bend ``rate`` times a unit of time.

    Changes of slope are Laplace draws, as the penalty on the bends of the history assumes.
    """
    times = rng.poisson(rate * max(ahead.max(initial=0.0), 0.0), DRAWS)
    out = np.zeros((DRAWS, len(ahead)))
    for n in range(1, times.max(initial=0) + 1):
        some = np.flatnonzero(times >= n)
        place = rng.random(len(some)) * ahead.max()
        turn = rng.laplace(0.0, scale, len(some))
        out[some] += turn[:, None] * np.maximum(ahead[None, :] - place[:, None], 0.0)
    return out


def _fit_one(
    ds: pd.Series,
    y: np.ndarray,
    future: pd.DatetimeIndex,
    level: float,
    seasons: Mapping[float, int],
    multiplicative: bool,
    bends: int,
) -> pd.DataFrame:
    """trend * (1 + waves) or trend + waves, by least squares with few bends and small waves.

    The penalties, not a rule on the length of the series, keep what the data cannot tell apart small.
    """
    start = ds.iloc[0]
    days = (ds - start).dt.days.to_numpy(dtype=float)
    every = ds.tolist() + list(future)
    all_days = np.array([(d - start).days for d in every], dtype=float)
    n, span = len(days), max(days[-1], 1.0)
    size = np.abs(y).mean() or 1.0
    target = y / size
    t, w = _trend(days, span, bends), _waves(days, seasons)
    rest = w.mean(axis=0)  # waves leave the level to the trend
    w = w - rest
    ridge = np.concatenate([[1e-9, 1e-6], np.full(w.shape[1], WAVE_PENALTY)])
    trend, bend = np.full(n, target.mean()), np.zeros(bends)
    # from one step to the next a series differs by its noise, whatever its trend
    penalty = max(np.diff(target).var() / 2 if n > 2 else target.var(), LEAST_NOISE) / BEND_SCALE
    for _ in range(ROUNDS):
        factor = trend[:, None] if multiplicative else 1.0
        free = np.column_stack([t[:, :2], w * factor])
        coef, bend = sparse_fit(free, ridge, t[:, 2:], target, penalty, bend)
        # where the trend nears zero there is no level for waves to multiply
        trend = np.maximum(t[:, :2] @ coef[:2] + t[:, 2:] @ bend, target.mean() / 10)
    all_t, all_w = _trend(all_days, span, bends), _waves(all_days, seasons) - rest
    line, wave = all_t[:, :2] @ coef[:2] + all_t[:, 2:] @ bend, all_w @ coef[2:]
    lift = 1 + wave if multiplicative else np.ones(len(wave))
    middle = line * lift if multiplicative else line + wave
    rng = np.random.default_rng(DEFAULTS.seed)
    noise = ((target - middle[:n]) ** 2).sum() / max(n - 2, 1)
    used = np.flatnonzero(bend)
    sharp, spread, taken = refitted(free, ridge, t[:, 2:][:, used], target)
    scale = np.abs(sharp).sum() / max(bends, 1)
    noise *= max(n - 2, 1) / max(n - taken, 1.0)
    # what the history leaves open about the coefficients
    known = np.column_stack([all_t[:, :2], all_w * (line[:, None] if multiplicative else 1.0), all_t[:, 2:][:, used]])
    root = np.linalg.cholesky(noise * spread + 1e-12 * np.eye(len(spread)))
    doubt = rng.standard_normal((DRAWS, len(root))) @ root.T @ known.T
    # bends of the history's last part were not looked for: there, too, the line may have left the trend
    since = np.maximum(all_days - BEND_RANGE * days[-1], 0) / span
    ahead = np.where(all_days > days[-1], since, 0)
    # the noise of a draw is one for all days, so the interval grows as smoothly as the bends do
    drawn = rng.normal(0.0, np.sqrt(noise), DRAWS)[:, None] + future_bends(
        ahead, bends / BEND_RANGE, scale, rng
    ) * lift + doubt
    low, high = np.quantile(drawn, [0.5 - level / 2, 0.5 + level / 2], axis=0)
    return pd.DataFrame(
        {
            "ds": [d.date() for d in every],
            "yhat": middle * size,
            "yhat_lower": (middle + np.minimum(low, 0)) * size,
            "yhat_upper": (middle + np.maximum(high, 0)) * size,
        }
    )


def forecast_revenue(
    series: DataFrame,
    keys: list[str] | None = None,
    horizon_days: int = DEFAULTS.horizon_days,
    step_days: int = 7,
    level: float = DEFAULTS.interval_level,
    seasons: Mapping[float, int] = SEASONS,
    multiplicative: bool = True,
    bends: int = BENDS,
) -> DataFrame:
    """Fitted history and forecast of every series (keys, ds, y) with its interval.

    A series is one row per week, so a group is bounded by the calendar whatever
    the number of orders; series run side by side.  The horizon moves in steps
    of the series itself; ``step_days=1`` predicts a weekly level for every day.
    All ``seasons`` are fitted whatever the length of the series, and seasons multiply the trend
    unless ``multiplicative`` is off, whatever its values.  The trend bends at few places, and the
    interval, a quantile of drawn futures that bend like the history, widens with the horizon.
    """
    keys = keys or []
    frame = series if keys else series.withColumn("_all", F.lit(1))
    group = keys or ["_all"]
    out = [f"`{k}` {series.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*out, "ds date, yhat double, yhat_lower double, yhat_upper double"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(ds=pd.to_datetime(pdf["ds"])).sort_values("ds")
        future = pd.date_range(
            pdf["ds"].iloc[-1], periods=-(-horizon_days // step_days) + 1, freq=f"{step_days}D"
        )[1:]
        fitted = _fit_one(
            pdf["ds"], pdf["y"].to_numpy(dtype=float), future, level, seasons, multiplicative, bends
        )
        for k in reversed(keys):
            fitted.insert(0, k, pdf[k].iloc[0])
        return fitted

    return frame.groupBy(*group).applyInPandas(one, schema)


def forecast_summary(forecast: DataFrame, after: Column | dt.date | str) -> DataFrame:
    """Total, weekly mean, best and worst week (by their Sunday) of the days after a date.

    The week grid has no holes: a week without rows counts 0.
    """
    week = F.next_day(F.date_sub("ds", 1), "SUN")
    c = F.rint(F.col("yhat") * 100).cast("bigint")
    weekly = forecast.filter(F.col("ds") > as_date(after)).groupBy(week.alias("w")).agg(F.sum(c).alias("c"))
    held = weekly.agg(
        F.min("w").alias("a"),
        F.max("w").alias("b"),
        F.map_from_entries(F.collect_list(F.struct("w", "c"))).alias("m"),
    )
    grid = held.select(F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("w"), "m").select(
        "w", F.coalesce(F.element_at("m", F.col("w")), F.lit(0)).alias("c")
    )
    return grid.agg(
        money(F.sum("c")).alias("total"),
        money(ratio_round(F.sum("c"), F.count(F.lit(1)))).alias("avg_week"),
        F.min_by("w", F.struct(-F.col("c"), F.col("w"))).alias("peak_week"),
        F.min_by("w", F.struct("c", "w")).alias("low_week"),
    )
