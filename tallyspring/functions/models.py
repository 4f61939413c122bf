"""Small-sample regression, selection and clustering kernels in numpy. Rows are months in order, columns drivers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def split(n: int, test: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-th seeded random split: (train rows, test rows)."""
    p = np.random.RandomState(k).permutation(n)
    cut = int(n * test)
    return p[cut:], p[:cut]


def standardize(x: np.ndarray) -> np.ndarray:
    s = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(s > 0, s, 1.0)


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    a = np.column_stack([np.ones(len(x)), x])
    b = np.linalg.lstsq(a, y, rcond=None)[0]
    return b[1:], float(b[0])


def project_rows(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Projection of a vector onto the space that the rows of ``basis`` span."""
    q = np.linalg.lstsq(basis.T, v, rcond=None)[0]
    return basis.T @ q


def principal(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(components, singular values) of rows brought to zero mean and unit deviation."""
    _, s, v = np.linalg.svd(standardize(rows.T).T, full_matrices=False)
    return v, s


def ridge(x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Centred normal equations, solved on the smaller side (months or drivers)."""
    mx, my = x.mean(axis=0), y.mean()
    xc, yc = x - mx, y - my
    if x.shape[1] <= x.shape[0]:
        b = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    else:
        b = xc.T @ np.linalg.solve(xc @ xc.T + alpha * np.eye(len(x)), yc)
    return b, float(my - mx @ b)


def lasso(x: np.ndarray, y: np.ndarray, alpha: float = 1.0, iterations: int = 1000, tol: float = 1e-4) -> tuple[np.ndarray, float]:
    """Cyclic soft thresholding on centred columns of unit population deviation; coefficients in original units."""
    mx, my, sx = x.mean(axis=0), y.mean(), x.std(axis=0)
    usable = sx > 0
    z = (x - mx) / np.where(usable, sx, 1.0)
    n, b, r = len(y), np.zeros(x.shape[1]), y - my
    for _ in range(iterations):
        most = 0.0
        for j in np.flatnonzero(usable):
            rho = z[:, j] @ r / n + b[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0)
            if new != b[j]:
                r = r - z[:, j] * (new - b[j])
                most = max(most, abs(new - b[j]))
                b[j] = new
        if most < tol:
            break
    b = b / np.where(usable, sx, 1.0)
    return b, float(my - mx @ b)


def lasso_cv(x: np.ndarray, y: np.ndarray, alphas: int = 100, folds: int = 5) -> tuple[np.ndarray, float, float]:
    """(coefficients, intercept, alpha): the penalty with the least error over contiguous folds."""
    z = standardize(x)
    top = max(np.abs(z.T @ (y - y.mean())).max() / len(y), 1e-12)
    path = np.geomspace(top, top * 1e-3, alphas)
    cuts = np.array_split(np.arange(len(y)), min(folds, len(y)))
    error = np.zeros(alphas)
    for hold in cuts:
        keep = np.setdiff1d(np.arange(len(y)), hold)
        for i, a in enumerate(path):
            b, c = lasso(x[keep], y[keep], a, 200)
            error[i] += ((y[hold] - x[hold] @ b - c) ** 2).sum()
    best = float(path[int(error.argmin())])
    return (*lasso(x, y, best), best)


class Tree:
    """A regression tree by variance reduction."""

    def __init__(self, depth: int = 6, leaf: int = 1, columns: float = 1.0, shrink: float = 0.0, rng: np.random.Generator | None = None):
        self.depth, self.leaf, self.columns, self.shrink = depth, leaf, columns, shrink
        self.rng = rng or np.random.default_rng(0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self.gain = np.zeros(x.shape[1])
        self.nodes: list[tuple] = []
        self._grow(x, y, 0)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1, float(y.sum() / (len(y) + self.shrink))))
        if depth >= self.depth or len(y) < 2 * self.leaf or np.ptp(y) == 0:
            return at
        d = x.shape[1]
        pick = self.rng.choice(d, max(1, int(round(d * self.columns))), replace=False) if self.columns < 1 else np.arange(d)
        best, cols, n, total = (1e-12, -1, 0.0), np.sort(pick), len(y), y.sum()
        o = np.argsort(x[:, cols], axis=0, kind="stable")
        xs, cs = np.take_along_axis(x[:, cols], o, axis=0), np.cumsum(y[o], axis=0)[:-1]
        k = np.arange(1, n)[:, None]
        ok = (xs[1:] > xs[:-1]) & (k >= self.leaf) & (n - k >= self.leaf)
        gain = np.where(ok, cs**2 / k + (total - cs) ** 2 / (n - k) - total**2 / n, -np.inf)
        most = gain.argmax(axis=0)
        top = gain[most, np.arange(len(cols))]
        j = int(top.argmax())
        if top[j] > best[0]:
            i = int(most[j])
            best = (float(top[j]), int(cols[j]), float((xs[i, j] + xs[i + 1, j]) / 2))
        if best[1] < 0:
            return at
        self.gain[best[1]] += best[0]
        left = x[:, best[1]] <= best[2]
        lo, hi = self._grow(x[left], y[left], depth + 1), self._grow(x[~left], y[~left], depth + 1)
        self.nodes[at] = (best[1], best[2], lo, hi, self.nodes[at][4])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        j, cut, lo, hi, v = (np.array(c) for c in zip(*self.nodes))
        at, rows = np.zeros(len(x), int), np.arange(len(x))
        while len(rows := rows[j[at[rows]] >= 0]):
            now = at[rows]
            at[rows] = np.where(x[rows, j[now]] <= cut[now], lo[now], hi[now])
        return v[at]


class Forest:
    def __init__(self, trees: int = 100, depth: int = 8, leaf: int = 1, columns: float = 1 / 3, rows: float = 1.0, seed: int = 42):
        self.trees, self.depth, self.leaf, self.columns, self.rows, self.seed = trees, depth, leaf, columns, rows, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        self.fitted, self.gain = [], np.zeros(x.shape[1])
        for _ in range(self.trees):
            i = rng.integers(0, len(y), max(2, int(len(y) * self.rows)))
            t = Tree(self.depth, self.leaf, self.columns, rng=rng).fit(x[i], y[i])
            self.fitted.append(t)
            self.gain += t.gain
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.fitted], axis=0)


class Boosted:
    def __init__(self, trees: int = 100, depth: int = 3, rate: float = 0.1, rows: float = 0.8, columns: float = 0.8, shrink: float = 1.0, seed: int = 42):
        self.trees, self.depth, self.rate, self.rows, self.columns, self.shrink, self.seed = trees, depth, rate, rows, columns, shrink, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        rng = np.random.default_rng(self.seed)
        self.base, self.fitted, self.gain = float(y.mean()), [], np.zeros(x.shape[1])
        now = np.full(len(y), self.base)
        for _ in range(self.trees):
            i = rng.choice(len(y), max(2, int(len(y) * self.rows)), replace=False)
            t = Tree(self.depth, 1, self.columns, self.shrink, rng).fit(x[i], (y - now)[i])
            now = now + self.rate * t.predict(x)
            self.fitted.append(t)
            self.gain += t.gain
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * np.sum([t.predict(x) for t in self.fitted], axis=0)


# ---- scores of drivers; higher is better


def lasso_stability(x: np.ndarray, y: np.ndarray, iterations: int = 100, alpha: float = 0.5, inner: int = 50, cut: float = 0.1) -> np.ndarray:
    """How often, over random 80 % of the months, a driver's coefficient exceeds ``cut`` (positive ones only)."""
    z, t = standardize(x), standardize(y[:, None])[:, 0]
    hits = np.zeros(x.shape[1])
    for k in range(iterations):
        rows, _ = split(len(y), 0.2, k)
        hits += lasso(z[rows], t[rows], alpha, inner)[0] > cut
    return hits


def ridge_importance(x: np.ndarray, y: np.ndarray, iterations: int = 80, alpha: float = 1.0) -> np.ndarray:
    z, t = standardize(x), standardize(y[:, None])[:, 0]
    return np.mean([np.abs(ridge(z[r], t[r], alpha)[0]) for r in (split(len(y), 0.2, k)[0] for k in range(iterations))], axis=0)


def elimination(x: np.ndarray, y: np.ndarray, importance, iterations: int, test: float = 0.1) -> np.ndarray:
    """1 / (mean rank + 1) of recursive elimination: the weakest driver goes first; the last one has rank 0."""
    d = x.shape[1]
    ranks = np.zeros(d)
    for k in range(iterations):
        rows, _ = split(len(y), test, k)
        left = list(range(d))
        while len(left) > 1:
            weakest = left[int(np.argmin(importance(x[rows][:, left], y[rows], k)))]
            left.remove(weakest)
            ranks[weakest] += len(left)
    return 1 / (ranks / iterations + 1)


def boosted_importance(x: np.ndarray, y: np.ndarray, iterations: int = 10, trees: int = 60) -> np.ndarray:
    out = np.zeros(x.shape[1])
    for k in range(iterations):
        rows, _ = split(len(y), 0.2, k)
        g = Boosted(trees, seed=k).fit(x[rows], y[rows]).gain
        out += g / max(g.sum(), 1e-300)
    return out / iterations


def forest_importance(x: np.ndarray, y: np.ndarray, trees: int = 100) -> np.ndarray:
    return Forest(trees, leaf=2, columns=0.6, rows=0.6).fit(x, y).gain


def binomial_tail(hits: int, n: int) -> float:
    """Chance of at least ``hits`` of n fair tosses."""
    p = np.cumprod(np.concatenate([[1.0], (n - np.arange(hits, n)) / (np.arange(hits, n) + 1.0)]))
    first = np.prod([(n - i) / (i + 1) / 2 for i in range(hits)]) * 0.5 ** (n - hits) if hits else 0.5**n
    return float(min(1.0, first * p.sum()))


def boruta(x: np.ndarray, y: np.ndarray, iterations: int = 100, trees: int = 100, alpha: float = 0.05, depth: int = 5, least: int = 20) -> np.ndarray:
    """1000 x share of rounds won against the best shuffled copy, plus relative importance.

    From ``least`` rounds on a driver whose wins are no chance is confirmed; one that isn't after four fifths of the rounds
    is rejected. Either way it takes no part in later rounds, and is scored by those it took part in.
    """
    rng = np.random.default_rng(42)
    wins, gain, rounds = (np.zeros(x.shape[1]) for _ in range(3))
    open_ = np.arange(x.shape[1])
    for k in range(iterations):
        if not len(open_):
            break
        part = x[:, open_]
        shadow = np.column_stack([rng.permutation(c) for c in part.T])
        g = Forest(trees, depth, seed=k).fit(np.hstack([part, shadow]), y).gain
        real, best = g[: len(open_)], g[len(open_) :].max()
        wins[open_] += real > best
        gain[open_] += real
        rounds[open_] += 1
        if k + 1 >= least:
            sure = np.array([binomial_tail(int(wins[j]), int(rounds[j])) < alpha for j in open_])
            open_ = open_[~(sure | (rounds[open_] >= 0.8 * iterations))]
    mean = gain / np.maximum(rounds, 1)
    return 1000 * wins / np.maximum(rounds, 1) + mean / (mean.max() if mean.max() > 0 else 1.0)


def mutual_information(a: np.ndarray, b: np.ndarray, bins: int = 10) -> float:
    """Over equal-width bins of both, in nats, at least 0."""
    h = np.histogram2d(a, b, bins)[0] / len(a)
    entropy = lambda p: -(p[p > 0] * np.log(p[p > 0])).sum()
    return max(0.0, float(entropy(h.sum(axis=1)) + entropy(h.sum(axis=0)) - entropy(h)))


def mrmr(x: np.ndarray, y: np.ndarray, features: int = 10, bins: int = 10) -> np.ndarray:
    """Greedy relevance minus mean redundancy; the first chosen has the highest score, the unchosen 0."""
    d = x.shape[1]
    relevance = np.array([mutual_information(x[:, j], y, bins) for j in range(d)])
    redundancy, score, chosen = np.zeros(d), np.zeros(d), []
    n = min(features, d)
    for step in range(n):
        value = relevance - (redundancy / len(chosen) if chosen else 0)
        value[chosen] = -np.inf
        j = int(value.argmax())
        score[j] = n - step
        chosen.append(j)
        redundancy += [mutual_information(x[:, j], x[:, i], bins) for i in range(d)]
    return score


def pca_score(x: np.ndarray, y: np.ndarray, by_account: bool = True) -> np.ndarray:
    """|correlation| of drivers and account after projection on the chosen principal months."""
    z = standardize(x).T
    t = standardize(y[:, None])[:, 0]
    _, s, v = np.linalg.svd(z, full_matrices=False)
    if by_account:
        n = int(np.ceil(np.sqrt(len(s))))
        dims = np.argsort(-np.abs(v @ t), kind="stable")[:n]
    else:
        gap = np.flatnonzero(s[:-1] / np.maximum(s[1:], 1e-12) > 2)
        dims = np.arange(gap[0] + 1 if len(gap) else len(s))
    a, b = z @ v[dims].T, v[dims] @ t
    rebuilt, target = a @ v[dims], b @ v[dims]
    r = rebuilt - rebuilt.mean(axis=1, keepdims=True)
    c = target - target.mean()
    down = np.linalg.norm(r, axis=1) * np.linalg.norm(c)
    return np.where(down > 1e-12, np.abs(r @ c) / np.where(down > 1e-12, down, 1), np.nan)


# ---- collinearity matrices, n x n with a zero diagonal


def correlation_matrix(x: np.ndarray) -> np.ndarray:
    z = standardize(x)
    return z.T @ z / len(x)


def kmeans_matrix(x: np.ndarray, seeds: int = 40) -> np.ndarray:
    """How often two drivers fall into one cluster, over k from 2 to n / 1.5 and several seeds; zeros where n <= 4."""
    z = standardize(x).T
    n = len(z)
    out, runs = np.zeros((n, n)), 0
    for k in range(2, int(n / 1.5)):
        for seed in range(seeds):
            rng = np.random.default_rng(seed)
            c = z[rng.choice(n, k, replace=False)]
            label = np.zeros(n, int)
            for _ in range(50):
                new = ((z[:, None, :] - c[None]) ** 2).sum(axis=-1).argmin(axis=1)
                if (new == label).all() and _:
                    break
                label = new
                c = np.array([z[label == i].mean(axis=0) if (label == i).any() else c[i] for i in range(k)])
            out += label[:, None] == label[None, :]
            runs += 1
    out = out / max(runs, 1)
    np.fill_diagonal(out, 0)
    return out


def lasso_matrix(x: np.ndarray, alpha: float = 0.01) -> np.ndarray:
    """|coefficients| of each driver on the others, symmetrised and divided by the largest."""
    z, n = standardize(x), x.shape[1]
    out = np.zeros((n, n))
    for i in range(n):
        rest = np.delete(np.arange(n), i)
        out[i, rest] = np.abs(lasso(z[:, rest], z[:, i], alpha)[0])
    out = (out + out.T) / 2
    return out / max(out.max(), 1e-300)


def cophenetic(distance: np.ndarray, method: str = "ward") -> np.ndarray:
    """Height at which two items join, by Lance-Williams updates (ward, average, single or complete)."""
    n = len(distance)
    d = distance.astype(float) ** (2 if method == "ward" else 1)
    np.fill_diagonal(d, np.inf)
    members, out = {i: [i] for i in range(n)}, np.zeros((n, n))
    while len(members) > 1:
        keys = sorted(members)
        sub = d[np.ix_(keys, keys)]
        a, b = np.unravel_index(int(sub.argmin()), sub.shape)
        i, j = keys[a], keys[b]
        height = np.sqrt(d[i, j]) if method == "ward" else d[i, j]
        for p in members[i]:
            for q in members[j]:
                out[p, q] = out[q, p] = height
        ni, nj = len(members[i]), len(members[j])
        for k in keys:
            if k in (i, j):
                continue
            nk = len(members[k])
            if method == "ward":
                v = ((ni + nk) * d[i, k] + (nj + nk) * d[j, k] - nk * d[i, j]) / (ni + nj + nk)
            elif method == "average":
                v = (ni * d[i, k] + nj * d[j, k]) / (ni + nj)
            else:
                v = min(d[i, k], d[j, k]) if method == "single" else max(d[i, k], d[j, k])
            d[i, k] = d[k, i] = v
        members[i] += members.pop(j)
    return out


def hierarchical_matrix(x: np.ndarray, method: str = "ward", euclid: bool = False) -> np.ndarray:
    """(highest join - join) / highest join."""
    if euclid:
        z = standardize(x).T
        dist = np.sqrt(((z[:, None, :] - z[None]) ** 2).sum(axis=-1))
    else:
        dist = 1 - np.abs(correlation_matrix(x))
    h = cophenetic(np.maximum(dist, 0), method)
    top = h.max()
    out = (top - h) / top if top > 0 else np.ones_like(h)
    np.fill_diagonal(out, 0)
    return out


def halton(trials: int, dims: int) -> Iterator[list[float]]:
    """A fixed low-discrepancy sequence in the unit cube."""
    bases = [p for p in range(2, 100) if all(p % q for q in range(2, p))][:dims]
    for i in range(1, trials + 1):
        point = []
        for b in bases:
            f, r, k = 1.0, 0.0, i
            while k:
                f /= b
                r += f * (k % b)
                k //= b
            point.append(r)
        yield point
