"""Small numeric kit: the normal distribution as columns, and minimisers in numpy."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMAL = NormalDist()

#: The Abramowitz-Stegun 7.1.26 coefficients of erf, highest power first.
ERF = (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)


def z_of(level: float) -> float:
    """Two-sided normal quantile of a percentage."""
    return _NORMAL.inv_cdf(0.5 + level / 200)


def normal_cdf(x: Column) -> Column:
    """Normal distribution function within 1.5e-7, from built-in functions."""
    a = F.abs(x) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + 0.3275911 * a)
    poly = F.lit(0.0)
    for c in ERF:
        poly = (poly + c) * t
    half = 0.5 * poly * F.exp(-a * a)
    return F.when(x >= 0, 1.0 - half).otherwise(half)


def normal_cdf_sql(x: str) -> str:
    a = f"(abs({x}) / sqrt(2.0::double))"
    t = f"(1.0::double / (1.0 + 0.3275911::double * {a}))"
    poly = "0.0::double"
    for c in ERF:
        poly = f"(({poly} + {c}::double) * {t})"
    return f"(case when {x} >= 0 then 1.0 - 0.5 * {poly} * exp(-{a} * {a}) else 0.5 * {poly} * exp(-{a} * {a}) end)"


def rms(v: np.ndarray, denominator: float) -> float:
    """sqrt(sum v^2 / denominator), safe from overflow."""
    top = float(np.max(np.abs(v), initial=0.0))
    return 0.0 if top == 0 else top * float(np.sqrt(np.sum((v / top) ** 2) / denominator))


def minimize_scalar(f, low: float, high: float, tol: float = 1e-7, grid: int = 25) -> float:
    """Best of a grid, refined by golden sections beside it."""
    xs = np.linspace(low, high, grid)
    i = int(np.argmin([f(x) for x in xs]))
    a, b = xs[max(0, i - 1)], xs[min(grid - 1, i + 1)]
    g = (5**0.5 - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tol:
        if fc <= fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return float((a + b) / 2)


def minimize_box(f, x0, low, high, rounds: int = 200, tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """Projected BFGS with central differences inside a box."""
    return descend(f, x0, low, high, rounds, tol)[:2]


def descend(f, x0, low, high, rounds: int = 200, tol: float = 1e-9) -> tuple[np.ndarray, float, bool]:
    """minimize_box, and whether it settled: at a flat place, or where no step gains any more."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    x = np.clip(np.asarray(x0, float), low, high)
    n = len(x)
    if n == 0:
        return x, float(f(x)), True

    def gradient(x):
        g = np.empty(n)
        for i in range(n):
            step = 1e-6 * max(1.0, abs(x[i]))
            a, b = x.copy(), x.copy()
            a[i], b[i] = max(low[i], x[i] - step), min(high[i], x[i] + step)
            g[i] = (f(b) - f(a)) / max(b[i] - a[i], 1e-300)
        return g

    fx, g, inverse, settled = f(x), gradient(x), np.eye(n), False
    for _ in range(rounds):
        held = ((x <= low) & (g > 0)) | ((x >= high) & (g < 0))
        if np.all(np.abs(np.where(held, 0, g)) < 1e-8):
            settled = True
            break
        d = -inverse @ np.where(held, 0, g)
        d[held] = 0
        if d @ g >= 0:
            inverse, d = np.eye(n), -np.where(held, 0, g)
        t, moved = 1.0, False
        for _ in range(40):
            new = np.clip(x + t * d, low, high)
            fn = f(new)
            if np.isfinite(fn) and fn <= fx + 1e-4 * (g @ (new - x)):
                moved = True
                break
            t /= 2
        if not moved or fx - fn <= tol * (abs(fx) + tol):
            if moved and fn < fx:
                x, fx = new, fn
            settled = bool(np.isfinite(fx) and fx < 1e299 and (moved or np.abs(np.where(held, 0, g)).max() <= 1e-4 * (1 + abs(fx))))
            break
        gn = gradient(new)
        s, y = new - x, gn - g
        if (sy := s @ y) > 1e-12:
            rho, eye = 1 / sy, np.eye(n)
            inverse = (eye - rho * np.outer(s, y)) @ inverse @ (eye - rho * np.outer(y, s)) + rho * np.outer(s, s)
        x, fx, g = new, fn, gn
    return x, float(fx), settled


def nelder_mead(f, x0, rounds: int = 600, tol: float = 1e-10, step: float = 0.5) -> tuple[np.ndarray, float]:
    x0 = np.asarray(x0, float)
    n = len(x0)
    points = np.vstack([x0, *(x0 + step * np.eye(n)[i] for i in range(n))])
    values = np.array([f(p) for p in points])
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if values[-1] - values[0] < tol * (abs(values[0]) + tol) and np.ptp(points, axis=0).max() < 1e-7:
            break
        centre = points[:-1].mean(0)
        r = centre + (centre - points[-1])
        fr = f(r)
        if fr < values[0]:
            e = centre + 2 * (centre - points[-1])
            fe = f(e)
            points[-1], values[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < values[-2]:
            points[-1], values[-1] = r, fr
        else:
            c = centre + 0.5 * ((r if fr < values[-1] else points[-1]) - centre)
            fc = f(c)
            if fc < min(fr, values[-1]):
                points[-1], values[-1] = c, fc
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
    i = int(np.argmin(values))
    return points[i], float(values[i])
