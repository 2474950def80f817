"""Small numerical routines for the driver: tails, quantiles, quadrature, optimisers."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


# Wichura's algorithm AS 241 for the normal quantile, as (numerator, denominator) from the highest power
# down: for |p - 1/2| <= 0.425, in the tails, and far out in them.
MIDDLE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080),
    (5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867, 5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0),
)
TAIL = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.241780725177450611770, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.148103976427480074590, 0.689767334985100004550, 1.67638483018380384940, 2.05319162663775882187, 1.0),
)
FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.00124266094738807843860, 0.0265321895265761230930, 0.296560571828504891230, 1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.136929880922735805310, 0.599832206555887937690, 1.0),
)


def normal_quantiles(p: np.ndarray) -> np.ndarray:
    """``normal_quantile`` of many probabilities strictly between 0 and 1."""
    q = p - 0.5
    r = np.sqrt(-np.log(np.minimum(p, 1 - p)))
    ratio = lambda parts, x: np.polyval(parts[0], x) / np.polyval(parts[1], x)
    inner = ratio(MIDDLE, 0.180625 - q * q) * q
    outer = np.where(r <= 5, ratio(TAIL, r - 1.6), ratio(FAR, r - 5)) * np.sign(q)
    return np.where(np.abs(q) <= 0.425, inner, outer)


def two_sided_p(z: float) -> float:
    """2 (1 - Phi(|z|)), without loss in the tail."""
    return math.erfc(abs(z) / math.sqrt(2))


def _gamma_series(a: float, x: float) -> float:
    term = total = 1 / a
    k = a
    while abs(term) > abs(total) * 1e-16:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_fraction(a: float, x: float) -> float:
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2
        d = an * d + b or tiny
        c = b + an / c or tiny
        d = 1 / d
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution."""
    if x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    return 1 - _gamma_series(a, x) if x < a + 1 else _gamma_fraction(a, x)


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1) or tiny
    d = 1 / d
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|); the normal tail for infinite df."""
    return two_sided_p(t) if math.isinf(df) else beta_inc(df / 2, 0.5, df / (df + t * t))


@lru_cache
def gauss_hermite(n: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights for a standard normal variable."""
    t, w = np.polynomial.hermite.hermgauss(n)
    return math.sqrt(2) * t, w / math.sqrt(math.pi)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


@lru_cache
def _wide_rule() -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre nodes on both halves of [-25, 25], weights times sigmoid minus step."""
    t, w = np.polynomial.legendre.leggauss(40)
    s = np.concatenate([-12.5 + 12.5 * t, 12.5 + 12.5 * t])
    return s, np.concatenate([w, w]) * 12.5 * (sigmoid(s) - (s > 0))


def logistic_normal(a: np.ndarray, v: np.ndarray, n: int = 20) -> np.ndarray:
    """E sigmoid(a + t) for t ~ N(0, v): plain, Gauss-Hermite, or (v > 1) step plus remainder; clipped to (0, 1)."""
    a, v = np.broadcast_arrays(np.asarray(a, float), np.asarray(v, float))
    out = sigmoid(a)
    mid = (v > 1e-12) & (v <= 1)
    if mid.any():
        t, w = gauss_hermite(n)
        out[mid] = sigmoid(a[mid, None] + np.sqrt(v[mid])[:, None] * t) @ w
    wide = v > 1
    if wide.any():
        s, w = _wide_rule()
        aw, vw = a[wide][:, None], v[wide][:, None]
        step = np.array([normal_cdf(x) for x in (a[wide] / np.sqrt(v[wide]))])
        out[wide] = step + np.exp(-((s - aw) ** 2) / (2 * vw)) / np.sqrt(2 * math.pi * vw) @ w
    return np.clip(out, 1e-15, 1 - 1e-15)


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 200, tol: float = 1e-9, memory: int = 10, lower: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Minimises ``f`` (value, gradient); with ``lower`` steps are projected on x >= lower."""
    x = np.array(x, float)
    clip = (lambda z: np.maximum(z, lower)) if lower is not None else (lambda z: z)
    x = clip(x)
    value, grad = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        free = np.ones(len(x), bool) if lower is None else ~((x <= lower) & (grad > 0))
        if np.abs(grad[free]).max(initial=0) < tol:
            break
        q = np.where(free, grad, 0)
        alphas = []
        for s, y in reversed(pairs):
            alpha = s @ q / (s @ y)
            alphas.append(alpha)
            q = q - alpha * y
        if pairs:
            s, y = pairs[-1]
            q = q * (s @ y) / (y @ y)
        for (s, y), alpha in zip(pairs, reversed(alphas), strict=True):
            q = q + s * (alpha - y @ q / (s @ y))
        move = -np.where(free, q, 0)
        if move @ grad >= 0:
            move, pairs = -np.where(free, grad, 0), []
        size = 1.0 if pairs else min(1.0, 1 / max(1e-12, np.abs(move).sum()))
        for _ in range(40):
            trial = clip(x + size * move)
            new, new_grad = f(trial)
            if np.isfinite(new) and new <= value + 1e-4 * (grad @ (trial - x)):
                break
            size *= 0.5
        else:
            break
        s, y = trial - x, new_grad - grad
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-memory:]
        done = abs(value - new) <= 1e-13 * (1 + abs(value)) and np.abs(s).max() < 1e-10
        x, value, grad = trial, new, new_grad
        if done:
            break
    return x, value


def hessian(f: Callable[[np.ndarray], float], x: np.ndarray, eps: float = 1e-4) -> np.ndarray:
    """Central second differences."""
    n = len(x)
    out = np.empty((n, n))
    e = np.eye(n) * eps
    for i in range(n):
        for j in range(i, n):
            out[i, j] = out[j, i] = (f(x + e[i] + e[j]) - f(x + e[i] - e[j]) - f(x - e[i] + e[j]) + f(x - e[i] - e[j])) / (4 * eps * eps)
    return out


def standard_errors(variance: np.ndarray) -> list[float | None]:
    """Roots of the diagonal; None where it is not positive."""
    return [math.sqrt(v) if v > 0 and math.isfinite(v) else None for v in np.diag(variance).tolist()]


def clear_cache() -> None:
    """Forgets the quadrature rules that were computed so far."""
    gauss_hermite.cache_clear()
    _wide_rule.cache_clear()


def psd_jitter(sigma: np.ndarray, floor: float = 1e-4, base: float = 1e-6) -> np.ndarray:
    """``sigma`` with a ridge that lifts its least eigenvalue to ``floor``, at least ``base``."""
    low = float(np.linalg.eigvalsh((sigma + sigma.T) / 2).min())
    return sigma + (max(base, floor - low) if low < floor else base) * np.eye(len(sigma))


def pack_cholesky(sigma: np.ndarray) -> np.ndarray:
    """The lower Cholesky factor row by row as one free vector, its diagonal as logarithms."""
    chol = np.linalg.cholesky(sigma)
    np.fill_diagonal(chol, np.log(np.diag(chol)))
    return chol[np.tril_indices(len(sigma))]


def unpack_cholesky(packed: np.ndarray, p: int) -> np.ndarray:
    """The covariance whose packed factor this is."""
    chol = np.zeros((p, p))
    chol[np.tril_indices(p)] = packed
    np.fill_diagonal(chol, np.exp(np.diag(chol)))
    return chol @ chol.T


def solve_lower(chol: np.ndarray, b: np.ndarray, block: int = 256) -> np.ndarray:
    """x of L x = b for a lower triangle, block by block: as many products as there are cells, not the factors of a general matrix."""
    x = np.array(b, float)
    for i in range(0, len(chol), block):
        at = slice(i, i + block)
        if i:
            x[at] -= chol[at, :i] @ x[:i]
        x[at] = np.linalg.solve(chol[at, at], x[at])
    return x


def solve_upper(chol: np.ndarray, b: np.ndarray, block: int = 256) -> np.ndarray:
    """x of L' x = b for a lower triangle L."""
    x = np.array(b, float)
    for i in reversed(range(0, len(chol), block)):
        at = slice(i, i + block)
        if i + block < len(chol):
            x[at] -= chol[i + block :, at].T @ x[i + block :]
        x[at] = np.linalg.solve(chol[at, at].T, x[at])
    return x


def inverse_lower(chol: np.ndarray, block: int = 256) -> np.ndarray:
    """The inverse of a lower triangle."""
    out = np.zeros_like(chol)
    for i in range(0, len(chol), block):
        at = slice(i, i + block)
        out[at, at] = np.linalg.inv(chol[at, at])
        if i:
            out[at, :i] = -out[at, at] @ (chol[at, :i] @ out[:i, :i])
    return out


def safe_cholesky(k: np.ndarray, start: float = 1e-10, stop: float = 1e-2) -> np.ndarray:
    """A Cholesky factor, with a ridge that grows tenfold until there is one."""
    ridge = 0.0
    scale = float(np.mean(np.diag(k))) or 1.0
    while True:
        try:
            return np.linalg.cholesky(k + ridge * scale * np.eye(len(k)) if ridge else k)
        except np.linalg.LinAlgError:
            ridge = ridge * 10 if ridge else start
            if ridge > stop:
                raise ValueError("the kernel matrix is not positive definite") from None
