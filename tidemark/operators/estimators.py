"""Lines for one cell: few rows, many columns, weights. A line is (constant, coefficients)."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np

Line = tuple[float, np.ndarray]
Estimator = Callable[[np.ndarray, np.ndarray, np.ndarray], Line]
ALPHAS = (0.0001, 0.001, 0.01, 0.1, 1.0, 10.0, 20.0)


def standardised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns with mean 0 and deviation 1 (of the population); columns that do not vary become 0."""
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 0, sd, 1.0)
    return (x - mean) / sd, mean, sd


def least_squares(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Line:
    """The shortest coefficients of least weighted squares, with more columns than rows too."""
    share = w / w.sum()
    mx, my = share @ x, share @ y
    root = np.sqrt(w)[:, None]
    beta = np.linalg.lstsq((x - mx) * root, (y - my) * root[:, 0], rcond=None)[0]
    return float(my - mx @ beta), beta


def ridge(x: np.ndarray, y: np.ndarray, w: np.ndarray, alphas: tuple[float, ...] = ALPHAS) -> Line:
    """Standardised columns, a free constant, and the penalty with the least weighted error of rows left out in turn."""
    z, mean, sd = standardised(x)
    share = w / w.sum()
    mz, my = share @ z, share @ y
    root = np.sqrt(w)
    a, b = (z - mz) * root[:, None], (y - my) * root
    u, s, v = np.linalg.svd(a, full_matrices=False)
    best = (np.inf, None)
    for alpha in alphas:
        shrink = s / (s**2 + alpha)
        beta = v.T @ (shrink * (u.T @ b))
        leverage = share + (u**2) @ (shrink * s)
        loo = (((b - a @ beta) / np.maximum(1 - leverage, 1e-12)) ** 2).mean()
        if loo < best[0]:
            best = (loo, beta)
    beta = best[1] / sd
    return float(my - (mz * sd + mean) @ beta), beta


def moments(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weighted products of centred columns, with each other and with y, and the means."""
    share = w / w.sum()
    mz, my = share @ z, float(share @ y)
    c = (z - mz) * share[:, None]
    return c.T @ (z - mz), c.T @ (y - my), mz, my


def descend(gram: np.ndarray, cross: np.ndarray, beta: np.ndarray, l1: np.ndarray, l2: np.ndarray, sweeps: int = 5) -> np.ndarray:
    """Minimise b'Gb / 2 - c'b + l1 |b| + l2 b'b / 2 for many problems at once, from beta on.

    gram (m, p, p), cross and beta (m, p), l1 and l2 (m,). A few sweeps of coordinate descent find most of the coordinates
    that are not zero, the rest is settled exactly, problem by problem.
    """
    beta, p = beta.copy(), gram.shape[1]
    grad = cross - np.einsum("mij,mj->mi", gram, beta)
    diagonal = np.einsum("mii->mi", gram)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(p):
            old = beta[:, j]
            pull = grad[:, j] + diagonal[:, j] * old
            step = np.sign(pull) * np.maximum(np.abs(pull) - l1, 0) / np.maximum(diagonal[:, j] + l2, 1e-300) - old
            most = np.abs(step).max()
            if most > 0:
                beta[:, j] = old + step
                grad -= gram[:, :, j] * step[:, None]
                moved = max(moved, float(most))
        if moved <= 1e-9:
            break
    return np.stack([settle(*one) for one in zip(gram, cross, beta, l1, l2, strict=True)])


def settle(gram: np.ndarray, cross: np.ndarray, beta: np.ndarray, l1: float, l2: float, tolerance: float = 1e-8) -> np.ndarray:
    """The exact solution from a near one: solve for the coordinates in use with their signs, stop at the first that would
    change its sign and drop it, and take in the one whose slope exceeds the penalty most, until none does."""
    p = len(cross)
    h = gram + (l2 + 1e-10 * max(np.trace(gram) / p, 1e-300)) * np.eye(p)
    beta = beta.copy()
    sign = np.sign(beta)
    for _ in range(50 * p + 50):
        slope = cross - h @ beta
        on = sign != 0
        if not on.any() or np.abs(slope[on] - l1 * sign[on]).max() <= tolerance:
            over = np.where(on, -np.inf, np.abs(slope) - l1)
            j = int(over.argmax())
            if over[j] <= tolerance:
                break
            sign[j] = np.sign(slope[j])
            on[j] = True
        at = np.flatnonzero(on)
        goal = np.linalg.solve(h[np.ix_(at, at)], cross[at] - l1 * sign[at])
        turned = np.sign(goal) * sign[at] < 0
        if not turned.any():
            beta[at] = goal
            continue
        now = beta[at]
        reach = np.where(turned, now / np.where(turned, now - goal, 1.0), 1.0)
        t = reach.min()
        beta[at] = now + t * (goal - now)
        gone = at[turned & (reach <= t + 1e-15)]
        beta[gone], sign[gone] = 0.0, 0.0
    return beta


def penalties(cross: np.ndarray, ratio: float, count: int = 50, span: float = 1e-3) -> np.ndarray:
    """From the least penalty at which all coefficients are zero down to `span` of it, evenly in the logarithm."""
    top = max(np.abs(cross).max() / ratio, 1e-12)
    return top * np.geomspace(1, span, count)


def time_splits(n: int, splits: int) -> list[tuple[int, int]]:
    """(rows to learn from, rows to judge up to): each part is judged by what came before it."""
    size = n // (splits + 1)
    return [(n - (splits - k) * size, n - (splits - k - 1) * size) for k in range(splits)] if size else []


def elastic_net(x: np.ndarray, y: np.ndarray, w: np.ndarray, ratios: tuple[float, ...] = (0.25, 0.5, 0.75), count: int = 50, splits: int = 4) -> Line:
    """Standardised columns; the share of the absolute penalty and its size are those with the least weighted error over
    splits in order of time. All shares and splits walk down the path together, each penalty from the last one's line."""
    z, mean, sd = standardised(x)
    cross = moments(z, y, w)[1]
    parts = time_splits(len(y), splits)
    jobs = [(r, a, b) for r in ratios for a, b in parts]
    chosen = (ratios[0], penalties(cross, ratios[0], count)[0])
    if jobs:
        found = [moments(z[:a], y[:a], w[:a]) for _, a, _ in jobs]
        gram, each = np.stack([f[0] for f in found]), np.stack([f[1] for f in found])
        grid = np.stack([penalties(cross, r, count) for r, _, _ in jobs])
        share, beta = np.array([r for r, _, _ in jobs]), np.zeros_like(each)
        error = np.zeros((len(jobs), count))
        for k in range(count):
            beta = descend(gram, each, beta, grid[:, k] * share, grid[:, k] * (1 - share))
            for i, (_, a, b) in enumerate(jobs):
                off = y[a:b] - found[i][3] - (z[a:b] - found[i][2]) @ beta[i]
                error[i, k] = w[a:b] @ off**2
        total = error.reshape(len(ratios), len(parts), count).sum(1)
        r, k = np.unravel_index(total.argmin(), total.shape)
        chosen = (ratios[r], penalties(cross, ratios[r], count)[k])
    return net_line(z, mean, sd, y, w, *chosen)


def net_line(z: np.ndarray, mean: np.ndarray, sd: np.ndarray, y: np.ndarray, w: np.ndarray, ratio: float, alpha: float) -> Line:
    """The line at one penalty, reached down the path from no coefficients."""
    gram, cross, mz, my = moments(z, y, w)
    top = max(np.abs(cross).max() / ratio, 1e-12)
    beta = np.zeros((1, len(cross)))
    for a in np.geomspace(max(top, alpha), alpha, 10):
        beta = descend(gram[None], cross[None], beta, np.array([a * ratio]), np.array([a * (1 - ratio)]))
    b = beta[0] / sd
    return float(my - (mz * sd + mean) @ b), b


def lasso(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Line:
    return elastic_net(x, y, w, (1.0,))


def shrunk(gram: np.ndarray, cross: np.ndarray, beta: np.ndarray, alpha: float, ratio: float) -> np.ndarray:
    """Coefficients of many problems at one penalty, `ratio` of it absolute; from beta on, unless all of it is square."""
    if ratio:
        one = np.ones(len(cross))
        return descend(gram, cross, beta, alpha * ratio * one, alpha * (1 - ratio) * one)
    return np.linalg.solve(gram + alpha * np.eye(gram.shape[1]), cross[..., None])[..., 0]


def contiguous(x: np.ndarray, y: np.ndarray, w: np.ndarray, ratio: float = 1.0, folds: int = 5, count: int = 60, one_error: bool = False) -> Line:
    """Standardised columns; the penalty, `ratio` of it absolute, has the least weighted error over folds of neighbouring
    rows, each judged by all the others. With one_error it is the largest one whose error lies within a standard error, over
    folds, of the least. Fewer than two rows leave the constant alone."""
    z, mean, sd = standardised(x)
    gram, cross, mz, my = moments(z, y, w)
    grid = penalties(cross, max(ratio, 1e-3), count, 1e-4 if len(y) > x.shape[1] else 1e-2)
    parts = np.array_split(np.arange(len(y)), min(folds, len(y)))
    at = 0
    if len(parts) > 1:
        found = [moments(np.delete(z, p, 0), np.delete(y, p), np.delete(w, p)) for p in parts]
        grams, crosses = np.stack([f[0] for f in found]), np.stack([f[1] for f in found])
        beta, error = np.zeros_like(crosses), np.zeros((len(parts), count))
        for k, alpha in enumerate(grid):
            beta = shrunk(grams, crosses, beta, alpha, ratio)
            for i, p in enumerate(parts):
                off = y[p] - found[i][3] - (z[p] - found[i][2]) @ beta[i]
                error[i, k] = w[p] @ off**2 / w[p].sum()
        share = np.array([w[p].sum() for p in parts]) / w.sum()
        whole = share @ error
        at = int(whole.argmin())
        if one_error:
            spread = np.sqrt(share @ (error[:, at] - whole[at]) ** 2 / (len(parts) - 1))
            at = int(np.flatnonzero(whole <= whole[at] + spread)[0])
    if ratio:
        return net_line(z, mean, sd, y, w, ratio, float(grid[at]))
    b = shrunk(gram[None], cross[None], np.zeros((1, len(cross))), float(grid[at]), 0.0)[0] / sd
    return float(my - (mz * sd + mean) @ b), b


def survival(x: np.ndarray, y: np.ndarray, w: np.ndarray, alphas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of standardised columns at every penalty of the lasso, and the largest penalty at which each column is
    still in use, 0 if it never is."""
    z = standardised(x)[0]
    gram, cross, _, _ = moments(z, y, w)
    order = np.argsort(-alphas)
    beta, path = np.zeros((1, len(cross))), np.zeros((len(alphas), len(cross)))
    for k in order:
        beta = shrunk(gram[None], cross[None], beta, float(alphas[k]), 1.0)
        path[k] = beta[0]
    return path, np.where(np.abs(path) > 1e-10, alphas[:, None], 0.0).max(0)


#: Name of an estimator to the function that fits it; any other function of (x, y, w) can stand beside them.
LINES: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray], Line]] = {"OLS": least_squares, "OLSR": ridge, "ENET": elastic_net, "LASSO": lasso}
#: Penalties by folds of neighbouring quarters: of least error, and the largest within a standard error of it.
FOLDED: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray], Line]] = {
    "RIDGE": partial(contiguous, ratio=0.0), "RIDGE1": partial(contiguous, ratio=0.0, one_error=True), "LASSO": contiguous, "LASSO1": partial(contiguous, one_error=True)
}
