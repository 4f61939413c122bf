"""Univariate forecasts of one series, in numpy. Each takes the history and a horizon and gives ``horizon`` values."""

from __future__ import annotations

import numpy as np


def seasonal_parts(x: np.ndarray, period: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, remainder) of the additive decomposition by a centred moving average; trend is NaN at the ends."""
    n, half = len(x), period // 2
    w = np.ones(period + 1 if period % 2 == 0 else period)
    if period % 2 == 0:
        w[[0, -1]] = 0.5
    trend = np.full(n, np.nan)
    trend[half : n - half] = np.convolve(x, w / w.sum(), "valid")[: max(n - 2 * half, 0)]
    rest = x - trend
    mean = np.array([np.nanmean(rest[i::period]) if (~np.isnan(rest[i::period])).any() else 0.0 for i in range(period)])
    seasonal = np.resize(mean - mean.mean(), n)
    return trend, seasonal, x - trend - seasonal


def seasonal_strength(x: np.ndarray, period: int = 12) -> float:
    """Variance of the seasonal part over that of the series; 0 for fewer than two periods or a constant."""
    if len(x) < 2 * period or x.var() == 0:
        return 0.0
    return float(seasonal_parts(x, period)[1].var() / x.var())


def linear(x: np.ndarray, horizon: int) -> np.ndarray:
    t = np.arange(len(x))
    if len(x) < 2:
        return np.full(horizon, x[-1])
    b, a = np.polyfit(t, x, 1)
    return a + b * (len(x) + np.arange(horizon))


def last_mean(x: np.ndarray, horizon: int, window: int = 3) -> np.ndarray:
    return np.full(horizon, x[-window:].mean())


def croston(x: np.ndarray, horizon: int, alpha: float = 0.1, variant: str = "classic") -> np.ndarray:
    """Smoothed size over smoothed interval of positive months; fewer than two of them give the mean."""
    seen = np.flatnonzero(x > 0)
    if len(seen) < 2:
        return np.full(horizon, x.mean())
    size, interval, since = x[seen[0]], float(seen[0] + 1), 0
    for v in x[seen[0] + 1 :]:
        since += 1
        if v > 0:
            size += alpha * (v - size)
            interval += alpha * (since - interval)
            since = 0
    return np.full(horizon, size / interval * (1 - alpha / 2 if variant == "sba" else 1))


def croston_tsb(x: np.ndarray, horizon: int, alpha: float = 0.1, beta: float = 0.1) -> np.ndarray:
    """Smoothed size times smoothed probability of a positive month, which decays in every month without one."""
    seen = np.flatnonzero(x > 0)
    if len(seen) < 2:
        return np.full(horizon, x.mean())
    size, chance = x[seen[0]], 1.0 / (seen[0] + 1)
    for v in x[seen[0] + 1 :]:
        chance += beta * ((v > 0) - chance)
        if v > 0:
            size += alpha * (v - size)
    return np.full(horizon, size * chance)


def _holt_winters(x: np.ndarray, horizon: int, a: float, b: float, g: float, period: int) -> tuple[float, np.ndarray]:
    level, trend = x[: max(period, 2)].mean(), 0.0
    if period and len(x) >= 2 * period:
        trend = (x[period : 2 * period].mean() - x[:period].mean()) / period
        season = list(x[:period] - level)
    else:
        season = []
        trend = x[1] - x[0] if len(x) > 1 else 0.0
        level = x[0]
    if b == 0:
        trend = 0.0
    error = 0.0
    for i, v in enumerate(x):
        s = season[i % period] if season else 0.0
        error += (v - level - trend - s) ** 2
        old = level
        level = a * (v - s) + (1 - a) * (level + trend)
        trend = b * (level - old) + (1 - b) * trend if b else 0.0
        if season:
            season[i % period] = g * (v - level) + (1 - g) * s
    h = np.arange(1, horizon + 1)
    out = level + trend * h
    if season:
        out = out + np.array([season[(len(x) + i) % period] for i in range(horizon)])
    return error, out


def exponential_smoothing(x: np.ndarray, horizon: int, threshold: float = 0.1, period: int = 12, trend: bool = True, seasonal: bool | None = None) -> np.ndarray:
    """Additive Holt-Winters; seasonal where the season is strong enough; parameters by a grid on one-step errors."""
    if len(x) < 4:
        return np.full(horizon, x[-1])
    if seasonal is None:
        seasonal = seasonal_strength(x, period) > threshold
    p = period if seasonal and len(x) >= 2 * period else 0
    grid = (0.1, 0.3, 0.5, 0.8)
    tries = [(a, b, g) for a in grid for b in ((0.05, 0.2) if trend else (0.0,)) for g in ((0.1, 0.3) if p else (0.0,))]
    return min((_holt_winters(x, horizon, a, b, g, p) for a, b, g in tries), key=lambda e: e[0])[1]


def _difference(x: np.ndarray, d: int, seasonal: int, period: int) -> tuple[np.ndarray, list[np.ndarray]]:
    kept = []
    for _ in range(seasonal):
        kept.append(x)
        x = x[period:] - x[:-period]
    for _ in range(d):
        kept.append(x)
        x = np.diff(x)
    return x, kept


def arima(x: np.ndarray, horizon: int, order: tuple[int, int, int] = (1, 1, 1), seasonal: tuple[int, int, int] = (0, 0, 0), period: int = 12, exog: np.ndarray | None = None, future: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(forecast, AIC) of an ARIMA with optional regressors by Hannan-Rissanen: a long autoregression gives the innovations, one regression the rest.

    The AIC is that for small samples, per month that is left and times all months, as orders use up different numbers of them.
    """
    (p, d, q), (sp, sd, sq) = order, seasonal
    beta = None
    if exog is not None and exog.shape[1]:
        beta = ols_with_constant(exog, x)
        x = x - exog @ beta[1:] - beta[0]
    w, kept = _difference(x, d, sd, period)
    mean = w.mean() if not (d or sd) else 0.0
    w = w - mean
    lags_ar = [*range(1, p + 1), *(period * i for i in range(1, sp + 1))]
    lags_ma = [*range(1, q + 1), *(period * i for i in range(1, sq + 1))]
    m = max([*lags_ar, *lags_ma, 1])
    k = len(lags_ar) + len(lags_ma)
    if len(w) < m + k + 3:
        raise ValueError("too few months for this order")
    long = max(1, min(len(w) // 4, m + 2))
    e = np.zeros(len(w))
    if lags_ma:
        z = np.column_stack([w[long - i : len(w) - i] for i in range(1, long + 1)])
        e[long:] = w[long:] - z @ np.linalg.lstsq(z, w[long:], rcond=None)[0]
    phi = np.zeros(k)
    if k:
        z = np.column_stack([w[m - i : len(w) - i] for i in lags_ar] + [e[m - i : len(w) - i] for i in lags_ma])
        phi = np.linalg.lstsq(np.vstack([z, 1e-3 * w.std() * np.eye(k) + 1e-9 * np.eye(k)]), np.concatenate([w[m:], np.zeros(k)]), rcond=None)[0]
        phi = np.clip(phi, -0.98, 0.98)
    e = np.zeros(len(w))
    for t in range(m, len(w)):
        e[t] = w[t] - phi[: len(lags_ar)] @ w[[t - i for i in lags_ar]] - phi[len(lags_ar) :] @ e[[t - i for i in lags_ma]] if k else w[t]
    n = len(w) - m
    terms = 2 * (k + 1) * n / (n - k - 2)
    aic = len(x) * (np.log(max((e[m:] ** 2).mean(), 1e-12)) + terms / n)
    ws, es = list(w), list(e)
    for _ in range(horizon):
        ws.append(sum(f * ws[-i] for f, i in zip(phi, lags_ar)) + sum(f * es[-i] for f, i in zip(phi[len(lags_ar) :], lags_ma)))
        es.append(0.0)
    out = np.array(ws[len(w) :]) + mean
    for base, s in zip(reversed(kept), reversed([period] * sd + [1] * d)):
        full = list(base)
        for v in out:
            full.append(full[-s] + v)
        out = np.array(full[len(base) :])
    if beta is not None:
        out = out + (future[:horizon] @ beta[1:] + beta[0])
    if not np.isfinite(out).all():
        raise ValueError("the fit diverged")
    return out, float(aic)


def ols_with_constant(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]


def arima_default(x: np.ndarray, horizon: int, threshold: float = 0.1, period: int = 12) -> np.ndarray:
    """(1,1,1), with a seasonal autoregression where the season is strong; falls back to (1,1,0), then to the last value."""
    s = (1, 0, 0) if seasonal_strength(x, period) > threshold else (0, 0, 0)
    for order, seasonal in (((1, 1, 1), s), ((1, 1, 0), (0, 0, 0))):
        try:
            return arima(x, horizon, order, seasonal, period)[0]
        except (ValueError, np.linalg.LinAlgError):
            continue
    return np.full(horizon, x[-1])


def auto_arima(x: np.ndarray, horizon: int, p: int = 5, d: int = 2, q: int = 5, sp: int = 2, sd: int = 1, sq: int = 2, period: int = 12, exog: np.ndarray | None = None, future: np.ndarray | None = None) -> np.ndarray:
    """The order with the least AIC of a grid; seasonal orders only with two periods of data."""
    best = (np.inf, np.full(horizon, x[-1]))
    long = len(x) >= 3 * period
    for i in range(p + 1):
        for j in range(q + 1):
            for k in range(d + 1):
                for s in [(a, b, c) for a in range(sp + 1) for b in range(sd + 1) for c in range(sq + 1)] if long else [(0, 0, 0)]:
                    try:
                        out, aic = arima(x, horizon, (i, k, j), s, period, exog, future)
                    except (ValueError, np.linalg.LinAlgError):
                        continue
                    if aic < best[0]:
                        best = (aic, out)
    return best[1]


def varma(x: np.ndarray, horizon: int, others: np.ndarray | None = None) -> np.ndarray:
    """A first-order vector autoregression with moving-average innovations; alone it is an ARMA(1,1). On failure the mean."""
    if others is None or not others.shape[1]:
        try:
            return arima(x, horizon, (1, 0, 1))[0]
        except (ValueError, np.linalg.LinAlgError):
            return np.full(horizon, x.mean())
    z = np.column_stack([x, others])
    mean = z.mean(axis=0)
    c = z - mean
    a = np.linalg.lstsq(c[:-1], c[1:], rcond=None)[0]
    out, now = [], c[-1]
    for _ in range(horizon):
        now = now @ a
        out.append(now[0] + mean[0])
    return np.array(out)


def trend_fourier(x: np.ndarray, horizon: int, knots: int = 8, waves: int = 4, period: int = 12, penalty: float = 1.0, exog: np.ndarray | None = None, future: np.ndarray | None = None) -> np.ndarray:
    """A decomposable model: piecewise-linear trend with penalised changes, and Fourier terms of the year."""
    n = len(x)
    t = np.arange(n + horizon) / max(n, 1)
    where = np.linspace(0, 0.8, knots + 1)[1:]
    cols = [np.ones_like(t), t] + [np.maximum(t - k, 0) for k in where]
    for k in range(1, waves + 1):
        a = 2 * np.pi * k * np.arange(n + horizon) / period
        cols += [np.sin(a), np.cos(a)]
    weights = [1e-6, 1e-6, *[penalty] * knots, *[0.01] * (2 * waves)]
    z = np.column_stack(cols)
    if exog is not None and exog.shape[1]:
        both = np.vstack([exog, future[:horizon]])
        both = (both - exog.mean(axis=0)) / np.where(exog.std(axis=0) > 0, exog.std(axis=0), 1)
        z, weights = np.hstack([z, both]), weights + [0.1] * both.shape[1]
    scale = x.std() or 1.0
    b = np.linalg.solve(z[:n].T @ z[:n] + np.diag(weights), z[:n].T @ ((x - x.mean()) / scale))
    return z[n:] @ b * scale + x.mean()


def trigonometric(x: np.ndarray, horizon: int, period: int = 12, waves: int = 3) -> np.ndarray:
    """Trigonometric seasonality with smoothed level, trend and ARMA remainder; needs two seasons."""
    if len(x) < 2 * period:
        raise ValueError("needs two seasons")
    n = len(x)
    a = 2 * np.pi * np.arange(1, waves + 1)[None, :] * np.arange(n + horizon)[:, None] / period
    f = np.hstack([np.sin(a), np.cos(a)])
    t = np.arange(n)
    b = ols_with_constant(np.column_stack([t, f[:n]]), x)
    season = f @ b[2:]
    return exponential_smoothing(x - season[:n], horizon, seasonal=False) + season[n:]


def lag_features(x: np.ndarray, lags: int, month0: int) -> np.ndarray:
    """For each point from ``lags`` on: the last values, rolling mean and deviation of 3, 6 and 12, index and month of the year."""
    rows = []
    for t in range(lags, len(x) + 1):
        h = x[:t]
        roll = [f(h[-w:]) for w in (3, 6, 12) for f in (np.mean, np.std)]
        m = 2 * np.pi * ((month0 + t) % 12) / 12
        rows.append([*h[-lags:][::-1], *roll, t, np.sin(m), np.cos(m)])
    return np.array(rows)


def boosted_lags(x: np.ndarray, horizon: int, lags: int = 12, month0: int = 0, trees: int = 100, early: bool = False) -> np.ndarray:
    """Boosted trees on lag features, one step ahead, fed back. ``early`` predicts from the features of the last observed point."""
    from tallyspring.functions.models import Boosted

    lags = min(lags, max(1, len(x) // 3))
    f = lag_features(x, lags, month0)
    model = Boosted(trees).fit(f[:-1], x[lags:])
    now = list(x)
    for _ in range(horizon):
        rows = lag_features(np.array(now), lags, month0)
        now.append(float(model.predict(rows[-2:-1] if early else rows[-1:])[0]))
    return np.array(now[len(x) :])


#: Methods for drivers.
METHODS = {
    "linear_regression": linear,
    "moving_average": last_mean,
    "croston": croston,
    "croston_tsb": croston_tsb,
    "exponential_smoothing": exponential_smoothing,
    "arima": arima_default,
    "auto_arima": auto_arima,
    "varima": varma,
    "prophet": trend_fourier,
    "tbats": trigonometric,
    "xgboost": boosted_lags,
}
