"""Numpy kernels over many series at once: robust seasonal-trend decomposition, generalised ESD, runs.

Series come as one padded matrix, a row per series, values first and NaN behind them.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from statistics import NormalDist

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

#: Of a normal distribution: standard deviation over median absolute deviation.
MAD = 1.4826
#: Days of a year.
YEAR = 365.25


_NORMAL = NormalDist()


def normal_quantile(tail: np.ndarray) -> np.ndarray:
    """The point beyond which ``tail`` of a standard normal distribution lies."""
    q = np.asarray(tail, float)
    return -np.array([_NORMAL.inv_cdf(v) for v in np.clip(q, 1e-300, 0.5).ravel().tolist()]).reshape(q.shape)


def t_quantile(tail: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Student's t point for an upper tail from the normal one by the Cornish-Fisher expansion (good to 3 digits for df >= 8)."""
    z, v = normal_quantile(tail), np.maximum(np.asarray(df, float), 3.0)
    return (
        z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v**3)
    )


def esd_limits(n: np.ndarray, k: int, alpha: float) -> np.ndarray:
    """Critical values of the generalised extreme studentised deviate test: row per n, column i for the (i+1)-th outlier."""
    sizes, back = np.unique(np.asarray(n), return_inverse=True)
    m = sizes.astype(float)[:, None]
    i = np.arange(1, k + 1)[None, :]
    left = np.maximum(m - i - 1, 3.0)
    t = t_quantile(alpha / (2 * np.maximum(m - i + 1, 2.0)), left)
    return ((m - i) * t / np.sqrt((left + t * t) * np.maximum(m - i + 1, 2.0)))[back]


def esd_flags(score: np.ndarray, n: np.ndarray, alpha: float, share: float = 0.2, whole: np.ndarray | None = None) -> np.ndarray:
    """Generalised ESD on absolute robust scores (median and MAD stand for mean and deviation): all entries up to the last that exceeds its limit.

    At most ``share`` of the entries can be outliers. ``whole`` has the sizes of the sources where only parts are at hand; limits
    fall so slowly with the number of outliers that counting those of the part changes nothing in sources that need parts.
    """
    s = np.where(np.isnan(score), -1.0, np.abs(score))
    k = max(1, int(np.ceil(share * s.shape[1])))
    if k < s.shape[1]:
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    else:
        top = np.broadcast_to(np.arange(s.shape[1]), s.shape)
    held = np.take_along_axis(s, top, axis=1)
    order = np.argsort(-held, axis=1, kind="stable")
    held, top = np.take_along_axis(held, order, axis=1), np.take_along_axis(top, order, axis=1)
    over = (held > esd_limits(n if whole is None else whole, held.shape[1], alpha)) & (np.arange(held.shape[1])[None, :] < np.ceil(share * n)[:, None])
    many = np.where(over.any(axis=1), over.shape[1] - np.argmax(over[:, ::-1], axis=1), 0)
    flags = np.zeros(s.shape, bool)
    np.put_along_axis(flags, top, np.arange(held.shape[1])[None, :] < many[:, None], axis=1)
    return flags


def running_median(x: np.ndarray, n: np.ndarray, half: int) -> np.ndarray:
    """Median of 2*half+1 neighbours, near an end of the nearest whole window; only the first n entries of a row mean something."""
    width, span = x.shape[1], 2 * half + 1
    if width <= span:
        m = row_median(np.where(np.arange(width)[None, :] < n[:, None], x, np.nan))
        return np.broadcast_to(np.nan_to_num(m)[:, None], x.shape)
    med = np.median(sliding_window_view(x, span, axis=1), axis=-1)
    j = np.clip(np.arange(width)[None, :] - half, 0, np.maximum(n[:, None] - span, 0))
    out = np.take_along_axis(med, np.clip(j, 0, med.shape[1] - 1), axis=1)
    short = n < span
    if short.any():
        live = np.arange(width)[None, :] < n[short, None]
        out[short] = np.nan_to_num(row_median(np.where(live, x[short], np.nan)))[:, None]
    return out


def row_median(x: np.ndarray) -> np.ndarray:
    """Median over each row, NaN left out; NaN where nothing is left."""
    s = np.sort(x, axis=1)
    n = (~np.isnan(s)).sum(axis=1)
    r = np.arange(len(s))
    lo, hi = s[r, np.maximum((n - 1) // 2, 0)], s[r, np.maximum(n // 2, 0).clip(max=s.shape[1] - 1)]
    return np.where(n > 0, (lo + hi) / 2, np.nan)


def run_lengths(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a matrix that says whether an entry continues the one before: number of its run within the row, and that run's length, per entry."""
    run = np.cumsum(~same, axis=1) - 1
    width = same.shape[1]
    flat = run + np.arange(len(same))[:, None] * width
    sizes = np.bincount(flat.ravel(), minlength=len(same) * width)
    return run, sizes[flat]


def fits_digits(x: np.ndarray, d: int) -> np.ndarray:
    """Whether ``d`` decimals are enough for a value."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.abs(np.round(x, d) - x) <= 1e-9 * np.maximum(1.0, np.abs(x))


def resolution(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Unit of the last digit in which a series is written: the largest power of ten that fits 98 % of its values."""
    live = np.arange(x.shape[1])[None, :] < n[:, None]
    q = np.full(len(x), 1e-6)
    for d in range(6, -1, -1):
        q = np.where((fits_digits(x, d) & live).sum(axis=1) >= 0.98 * n, 10.0**-d, q)
    return q


def stepped(x: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether a source always moves in steps: at least half of its neighbours are alike."""
    live = np.arange(x.shape[1])[None, 1:] < n[:, None]
    alike = (np.abs(np.diff(x, axis=1)) <= q[:, None] / 2) & live
    return alike.sum(axis=1) >= 0.5 * np.maximum(n - 1, 1)


def seasonal_by_class(x: np.ndarray, n: np.ndarray, cls: np.ndarray, classes: int, half: int, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Robust seasonal component: per class of the calendar the median of what the trend (a running median) leaves.

    Also how far the classes before and after lie from an entry's own.
    """
    live = np.arange(x.shape[1])[None, :] < n[:, None]
    season = np.zeros_like(x)
    for _ in range(rounds):
        rest = np.where(live, x - running_median(np.where(live, x - season, 0.0), n, half), np.nan)
        per = np.zeros((len(x), classes))
        for k in range(classes):
            here = live & (cls == k)
            m = row_median(np.where(here, rest, np.nan))
            per[:, k] = np.where((here.sum(axis=1) >= 3) & ~np.isnan(m), m, 0.0)
        season = np.where(live, np.take_along_axis(per, np.where(live, cls, 0), axis=1), 0.0)
    around = [np.take_along_axis(np.roll(per, s, axis=1), np.where(live, cls, 0), axis=1) - season for s in (1, -1)]
    return season, np.stack(around, axis=-1)


#: Calendar classes of irregular readings: days of the week, and twelfths of the year.
WEEK, TWELFTHS = 7, 12
#: Part of the usual remainder that a seasonal component must take away to be there at all.
EXPLAINS = 0.1


def calendar_classes(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Day of the week and twelfth of the year of times in days."""
    week = np.floor(t).astype(np.int64) % WEEK
    return week, np.minimum((np.mod(t, YEAR) * (TWELFTHS / YEAR)).astype(np.int64), TWELFTHS - 1)


def class_medians(x: np.ndarray, n: np.ndarray, t: np.ndarray, half: int) -> np.ndarray:
    """Sources by classes (of the week, then of the year): the median of what the trend, a running median, leaves; 0 for classes of
    fewer than 3 rows, and for those of the year in sources of less than two years."""
    live = np.arange(x.shape[1])[None, :] < n[:, None]
    rest = np.where(live, x - running_median(np.where(live, x, 0.0), n, half), np.nan)
    src = np.broadcast_to(np.arange(len(x))[:, None], x.shape)[live]
    out = []
    for cls, many in zip(calendar_classes(t), (WEEK, TWELFTHS)):
        key = src * many + cls[live]
        v = rest[live]
        order = np.lexsort((v, key))
        key, v = key[order], v[order]
        size = np.bincount(key, minlength=len(x) * many)
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        lo, hi = first + np.maximum(size - 1, 0) // 2, first + size // 2
        end = max(len(v) - 1, 0)
        middle = (v[np.minimum(lo, end)] + v[np.minimum(hi, end)]) / 2 if len(v) else np.zeros(len(size))
        out.append(np.where(size >= 3, middle, 0.0).reshape(len(x), many))
    span = np.take_along_axis(t, np.maximum(n - 1, 0)[:, None], axis=1)[:, 0] - t[:, 0]
    out[1][span < 2 * YEAR] = 0
    return np.hstack(out)


def season_of(medians: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Seasonal component at each time, from ``class_medians``."""
    week, twelfth = calendar_classes(t)
    return np.take_along_axis(medians[:, :WEEK], week, axis=1) + np.take_along_axis(medians[:, WEEK:], twelfth, axis=1)


def seasonal_by_calendar(x: np.ndarray, n: np.ndarray, t: np.ndarray, half: int) -> np.ndarray:
    """Seasonal component of irregular readings, by time: day of the week plus twelfth of the year; 0 in sources whose remainders it doesn't clearly lessen."""
    live = np.arange(x.shape[1])[None, :] < n[:, None]
    season = np.where(live, season_of(class_medians(x, n, t, half), t), 0.0)
    left = lambda s: row_median(np.where(live, np.abs(x - s - running_median(np.where(live, x - s, 0.0), n, half)), np.nan))
    explains = np.nan_to_num(left(season)) < (1 - EXPLAINS) * np.nan_to_num(left(0.0))
    return np.where(explains[:, None], season, 0.0)


#: Relative widths of the classes in which sizes are counted: fine, and coarse.
FINE, COARSE = 0.002, 0.01
_MIDDLE = 400_000


def size_class(v: np.ndarray, width: float) -> np.ndarray:
    """Number of the class of like size and sign: counts per class add up over parts of a source, and their order is that of the values."""
    with np.errstate(divide="ignore"):
        size = np.rint(np.log(np.maximum(np.abs(v), 1e-300)) / width).astype(np.int64) + _MIDDLE
    return np.where(np.abs(v) < 1e-300, 0, np.sign(v).astype(np.int64) * size)


def class_value(k: np.ndarray, width: float) -> np.ndarray:
    k = np.asarray(k)
    return np.where(k == 0, 0.0, np.sign(k) * np.exp((np.abs(k) - _MIDDLE) * width))


def counted_median(k: np.ndarray, times: np.ndarray, width: float) -> float:
    """Median of values of which only the classes' counts are known; NaN of none."""
    if not len(k):
        return np.nan
    order = np.argsort(k)
    upto = np.cumsum(times[order])
    return float(class_value(k[order][np.searchsorted(upto, (upto[-1] + 1) // 2)], width))


def neighbours(x: np.ndarray, t: np.ndarray, n: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(near, fresh): whether an entry is within two last digits of the one before, and whether it is of a new moment."""
    live = np.arange(x.shape[1])[None, :] < n[:, None]
    near = np.zeros(x.shape, bool)
    near[:, 1:] = (np.abs(np.diff(np.where(live, x, 0.0), axis=1)) <= 2.01 * q[:, None]) & live[:, 1:]
    fresh = np.ones(x.shape, bool)
    fresh[:, 1:] = np.diff(np.where(live, t, 0), axis=1) != 0
    return near, fresh & live


@dataclass
class Usual:
    """What is usual in whole sources, an entry per source, for those of which only a part is at hand."""

    n: np.ndarray  # rows
    digit: np.ndarray  # unit of the last digit
    scale: np.ndarray  # scatter around the course
    days: np.ndarray  # from the first to the last row
    pairs: np.ndarray  # of neighbouring moments
    alike: np.ndarray  # of these, how many within two last digits
    rests: np.ndarray  # of these, how many at the most frequent value
    level: np.ndarray  # that value

    def pick(self, rows: np.ndarray) -> Usual:
        return Usual(*[getattr(self, f.name)[rows] for f in fields(self)])


def stuck_flags(x: np.ndarray, t: np.ndarray, n: np.ndarray, q: np.ndarray, chance: float, least: int, usual: Usual | None = None) -> np.ndarray:
    """Rows of stretches that stay within two last digits for longer than the source's own habit explains.

    Rows of one moment count once. Were neighbours alike with the probability p seen in the rest of the
    source, a stretch of L would turn up by chance n * p**(L-1) times; below ``chance`` it is flagged. Where the
    source rests at one value again and again (a closure), neighbours at that value don't speak for stretches elsewhere.
    """
    flags = np.zeros(x.shape, bool)
    width = x.shape[1]
    live = np.arange(width)[None, :] < n[:, None]
    near, fresh = neighbours(x, t, n, q)
    run, size = run_lengths(near)
    for i in np.nonzero((np.where(live, size, 0)).max(axis=1) >= least)[0]:
        m = n[i]
        xs, new = x[i, :m], fresh[i, :m]
        if usual is None:
            pairs, alike = max(int(new.sum()) - 1, 1), int((near[i, :m] & new).sum())
            at_rest, level = 0, np.nan
            if alike:
                held, often = np.unique(xs[near[i, :m] & new], return_counts=True)
                at_rest, level = int(often.max()), held[int(often.argmax())]
        else:
            pairs, alike, at_rest, level = max(usual.pairs[i], 1), usual.alike[i], usual.rests[i], usual.level[i]
        starts = np.nonzero(~near[i, :m])[0]
        ends = np.append(starts[1:], m)
        for a, b in zip(starts, ends):
            if b - a < least:
                continue
            # within the chain of small steps: maximal stretches whose range stays within two last digits
            j = a
            while j < b:
                lo = hi = xs[j]
                k = j + 1
                while k < b and max(hi, xs[k]) - min(lo, xs[k]) <= 2.01 * q[i]:
                    lo, hi = min(lo, xs[k]), max(hi, xs[k])
                    k += 1
                length = int(new[j:k].sum()) + (0 if new[j] else 1)
                if length >= least:
                    off = at_rest if abs(lo - level) > 2.01 * q[i] else 0
                    rest = max(pairs - off - (length - 1), 1)
                    p = min(max((alike - off - (length - 1)) / rest, 0.02), 1.0)
                    if pairs * p ** (length - 1) < chance:
                        flags[i, j:k] = True
                j = k
    return flags


#: Part of the scatter nearby that stands against the usual one.
NEARBY = 0.6


#: Days before and after the same time of another year, and the share of all deviations of like sign and size that must lie
#: there (a fifteenth would by chance, so that a source that often deviates alike isn't taken to do so yearly).
WINDOW, YEARLY_SHARE = 12.0, 0.25
#: Parts of a day in which moments of deviations are told apart.
PARTS = 4


def returns_yearly(days: np.ndarray, rest: np.ndarray, at: float, size: float, years: int = 2) -> bool:
    """Whether deviations of like sign and size are there at the same time of at least ``years`` other years, and not at all times."""
    like = np.flatnonzero(np.abs(rest - size) < 0.3 * abs(size))
    gap = days[like] - at
    k = np.rint(gap / YEAR)
    same = np.abs(gap - k * YEAR) <= WINDOW
    if len(np.unique(k[same & (k != 0)])) < years:
        return False
    moments = np.floor(days[like] * PARTS)
    return len(np.unique(moments[same])) >= YEARLY_SHARE * len(np.unique(moments))


def at_rest(x: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Entries alike to a neighbour (closures, repeated rows), which say nothing about the scatter."""
    live = np.arange(x.shape[1])[None, :] < n[:, None]
    rests = np.zeros(x.shape, bool)
    rests[:, 1:] = (np.abs(np.diff(x, axis=1)) <= q[:, None] / 2) & live[:, 1:]
    rests[:, :-1] |= rests[:, 1:]
    return rests


def usual_scale(moving: np.ndarray, many: np.ndarray, every: np.ndarray, jump: np.ndarray, steps: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Scatter of a source, from the medians of its deviations where it moves (if ``many`` rows do) or everywhere, and of its
    jumps: where it moves in steps, the usual size of a step stands for the scatter."""
    scale = np.where(many >= 12, moving, every) * MAD
    scale = np.where(steps, np.fmax(scale, np.nan_to_num(jump) / 2), scale)
    return np.maximum(np.nan_to_num(scale), q / 2)


def spike_flags(
    x: np.ndarray, t: np.ndarray, n: np.ndarray, season: np.ndarray, q: np.ndarray, *, half: int, alpha: float, margin: float, longest: int,
    days_per_t: float, steps: np.ndarray | None = None, wide: int = 20, share: float = 0.2, usual: Usual | None = None, pending: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flags, remainder, band): one or a few neighbouring rows beyond the limits, after which the source returns.

    The band is how far the first limit lies from the course. The limits are those of the generalised ESD test times ``margin``, as real scatter has heavier tails than
    a normal one. What comes again at the same time of other years isn't flagged, nor is a month that behaves as
    the month before or after it usually does (a season that comes early, late or not at all); ``steps`` are the
    differences of the seasonal component to those two neighbours.

    Where ``x`` holds only parts of sources, ``usual`` has what is known of the whole, and whether a spike comes again in other
    years is left open: ``pending`` gets, at each flagged entry, the size that would have to come again (NaN: none).
    """
    width = x.shape[1]
    live = np.arange(width)[None, :] < n[:, None]
    y = np.where(live, x - season, 0.0)
    rest = np.where(live, y - running_median(y, n, half), np.nan)
    dev = np.abs(rest)
    if usual is None:
        rests = at_rest(x, n, q)
        jump = np.where(live[:, 1:], np.abs(np.diff(np.where(live, x, 0.0), axis=1)), np.nan)
        jump = np.where(jump > q[:, None] / 2, jump, np.nan)
        scale = usual_scale(row_median(np.where(rests, np.nan, dev)), (~rests & live).sum(axis=1), row_median(dev), row_median(jump), stepped(x, n, q), q)
    else:
        scale = usual.scale
    # the scatter nearby counts where it is clearly larger than the source's usual one (that of few rows varies by itself)
    # on either side of a row, so that the first rows of a noisier phase are held against that phase
    near = running_median(np.nan_to_num(dev), n, wide // 2)
    j, last = np.arange(width)[None, :], np.maximum(n[:, None] - 1, 0)
    sides = [np.take_along_axis(near, np.clip(j + s * (wide // 2 + 1), 0, last), axis=1) for s in (-1, 1)]
    around = np.maximum(*sides) * MAD * NEARBY
    local = np.maximum(scale[:, None], around)
    score = np.where(live, rest / local, np.nan)
    whole = n if usual is None else usual.n
    hit = esd_flags(score / margin, n, alpha, share, whole)
    flags = np.zeros(x.shape, bool)
    limit = margin * esd_limits(whole, 1, alpha)[:, 0]
    for i in np.nonzero(hit.any(axis=1))[0]:
        m = n[i]
        h, ys, ts = hit[i, :m], y[i, :m], t[i, :m]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], h, [False])).astype(np.int8)))
        clear = np.flatnonzero(~h)
        days = ts * days_per_t
        yearly = (days[-1] - days[0] if usual is None else usual.days[i]) > 1.5 * YEAR
        for a, b in zip(edge[::2], edge[1::2]):
            if len(np.unique(ts[a:b])) > longest:
                continue
            at = np.searchsorted(clear, a)
            before, after = ys[clear[max(0, at - 8) : at]], ys[clear[at : at + 8]]
            v = np.median(ys[a:b])
            need = 0.6 * limit[i] * local[i, a]
            sides = [v - np.median(s) for s in (before, after) if len(s) >= 2]
            if len(sides) == 2:
                ok = min(map(abs, sides)) > need and sides[0] * sides[1] > 0
            else:  # at an end nothing shows whether it returns: only a row or two, and twice as far
                ok = bool(sides) and len(np.unique(ts[a:b])) <= 2 and abs(sides[0]) > 2 * limit[i] * local[i, a]
            if ok and yearly:
                size = np.median(rest[i, a:b])
                if pending is not None:
                    pending[i, a:b] = size
                elif returns_yearly(days, rest[i, :m], days[a], size):
                    continue
                near = max(0.25 * abs(size), 3 * local[i, a])
                if steps is not None and any(abs(e) > 0.5 * abs(size) and abs(size - e) < near for e in np.median(steps[i, a:b], axis=0)):
                    continue
            flags[i, a:b] = ok
    return flags, rest, limit[:, None] * local
