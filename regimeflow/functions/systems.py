"""Dynamical systems with polynomial tendencies, as terms; from them column expressions, SQL text and NumPy kernels.

A term (row, coefficient, factors) adds the coefficient times the product of the factors to the tendency of a variable.
Factors count the variables from 0; numbers from `dim` on are parameters that a table has as columns (such as the
height of the orography), so that one expression serves runs of different settings.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import cache, reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 6-mode model: damping, planetary vorticity gradient, channel ratio, orography, forced state.
DAMPING, BETA, RATIO, HEIGHT = 0.1, 1.25, 0.5, 0.2
FORCED = (0.95, 0.0, 0.0, -0.76095, 0.0, 0.0)
#: Fixed initial state, and the box of random ones.
START = (0.927796, 0.160574, -0.0969953, -0.672758, -0.118184, 0.214505)
START_BOX = ((0.8, -0.1, -0.4, -0.7, -0.4, -0.2), (0.95, 0.3, 0.1, -0.2, 0.4, 0.45))


class System(NamedTuple):
    name: str
    dim: int
    parameters: tuple[str, ...]
    terms: tuple[tuple[int, float, tuple[int, ...]], ...]


def coefficients(b: float = RATIO, beta: float = BETA, g: float = HEIGHT) -> dict[str, float]:
    """Coefficients of the 6-mode model for zonal wavenumbers 1 and 2 (keys a1, a2, beta1, ...) and e."""
    out = {}
    root = math.sqrt(2) / math.pi
    for m in (1, 2):
        q, s = b * b + m * m, 4 * m * m - 1
        out |= {
            f"a{m}": 8 * root * m * m * (q - 1) / (s * q), f"beta{m}": beta * b * b / q,
            f"gamma{m}": 4 * root * g * b * m**3 / (s * q), f"gammap{m}": 4 * root * g * b * m / s,
            f"d{m}": 64 * root * (b * b - m * m + 1) / (15 * q),
        }
    return out | {"e": 16 * root / 5}


def six_mode(b: float = RATIO, beta: float = BETA, damping: float = DAMPING, forced: Sequence[float] = FORCED, g: float | None = HEIGHT) -> System:
    """The 6-mode barotropic model; with g = None the orography's height is the parameter `g` of each row."""
    c = coefficients(b, beta, 1.0 if g is None else g)
    height = (6,) if g is None else ()
    terms = [(i, -damping, (i,)) for i in range(6)] + [(i, damping * v, ()) for i, v in enumerate(forced) if v]
    for m, (zonal, cos, sin), other in ((1, (0, 1, 2), (3, 4, 5)), (2, (3, 4, 5), (0, 1, 2))):
        terms += [(zonal, c[f"gammap{m}"], (sin, *height)), (sin, -c[f"gamma{m}"], (zonal, *height)), (cos, c[f"beta{m}"], (sin,)), (sin, -c[f"beta{m}"], (cos,))]
        # advection by the first zonal flow, and by the second through the other wave
        terms += [(cos, -c[f"a{m}"], (0, sin)), (sin, c[f"a{m}"], (0, cos)), (cos, -c[f"d{m}"], (3, other[2])), (sin, c[f"d{m}"], (3, other[1]))]
    terms += [(3, c["e"], (1, 5)), (3, -c["e"], (2, 4))]
    return System("six_mode", 6, ("g",) if g is None else (), tuple(terms))


def lorenz63(sigma: float = 10.0, rho: float = 28.0, beta: float = 8 / 3) -> System:
    return System("lorenz63", 3, (), ((0, -sigma, (0,)), (0, sigma, (1,)), (1, rho, (0,)), (1, -1.0, (1,)), (1, -1.0, (0, 2)), (2, 1.0, (0, 1)), (2, -beta, (2,))))


def rossler(a: float = 0.1, b: float = 0.1, c: float = 14.0) -> System:
    return System("rossler", 3, (), ((0, -1.0, (1,)), (0, -1.0, (2,)), (1, 1.0, (0,)), (1, a, (1,)), (2, b, ()), (2, 1.0, (0, 2)), (2, -c, (2,))))


def lorenz96(dim: int = 10, forcing: float = 8.0) -> System:
    terms = []
    for i in range(dim):
        terms += [(i, 1.0, ((i + 1) % dim, (i - 1) % dim)), (i, -1.0, ((i - 2) % dim, (i - 1) % dim)), (i, -1.0, (i,)), (i, forcing, ())]
    return System("lorenz96", dim, (), tuple(terms))


SYSTEMS = {"six_mode": six_mode, "lorenz63": lorenz63, "rossler": rossler, "lorenz96": lorenz96}


def system(name: str, **parameters) -> System:
    """A system by its name; an unknown one is an error."""
    if name not in SYSTEMS:
        raise ValueError(f"no system {name!r}; there are {', '.join(SYSTEMS)}")
    return SYSTEMS[name](**parameters)


def derivative(s: System) -> list[tuple[int, int, float, tuple[int, ...]]]:
    """Terms (row, variable, coefficient, factors) of the Jacobian, by the product rule."""
    return [(row, v, c, f[:k] + f[k + 1 :]) for row, c, f in s.terms for k, v in enumerate(f) if v < s.dim]


def _column(parts: list[tuple[float, tuple[int, ...]]], cols: Sequence[Column]) -> Column:
    made = [reduce(lambda a, b: a * b, (cols[i] for i in f), F.lit(float(c))) for c, f in parts]
    return reduce(lambda a, b: a + b, made) if made else F.lit(0.0)


def tendency(s: System, cols: Sequence[Column]) -> list[Column]:
    """Tendency of each variable as an expression over the columns of the variables (and parameters)."""
    return [_column([(c, f) for r, c, f in s.terms if r == i], cols) for i in range(s.dim)]


def jacobian(s: System, cols: Sequence[Column]) -> list[list[Column]]:
    d = derivative(s)
    return [[_column([(c, f) for r, v, c, f in d if (r, v) == (i, j)], cols) for j in range(s.dim)] for i in range(s.dim)]


def tendency_sql(s: System, cols: Sequence[str]) -> list[str]:
    """The tendencies as SQL text."""
    return [" + ".join("*".join([f"CAST({c!r} AS DOUBLE)", *(cols[k] for k in f)]) for r, c, f in s.terms if r == i) for i in range(s.dim)]


def jacobian_sql(s: System, cols: Sequence[str]) -> list[list[str]]:
    d = derivative(s)
    return [[" + ".join("*".join([f"CAST({c!r} AS DOUBLE)", *(cols[k] for k in f)]) for r, v, c, f in d if (r, v) == (i, j)) or "CAST(0 AS DOUBLE)" for j in range(s.dim)] for i in range(s.dim)]


def np_tendency(s: System, x: np.ndarray, p: np.ndarray | None = None) -> np.ndarray:
    """Tendencies of many states (rows) at once; `p` has a column per parameter."""
    z = x if p is None else np.concatenate([x, p], axis=1)
    out = np.zeros_like(x)
    for row, c, f in s.terms:
        out[:, row] += c * np.prod(z[:, f], axis=1) if len(f) > 1 else c * (z[:, f[0]] if f else 1.0)
    return out


def np_jacobian(s: System, x: np.ndarray, p: np.ndarray | None = None) -> np.ndarray:
    """Jacobians (rows, dim, dim) of many states."""
    z = x if p is None else np.concatenate([x, p], axis=1)
    out = np.zeros((len(x), s.dim, s.dim))
    for row, v, c, f in derivative(s):
        out[:, row, v] += c * np.prod(z[:, f], axis=1) if len(f) > 1 else c * (z[:, f[0]] if f else 1.0)
    return out


@cache
def number_step(s: System, dt: float) -> Callable[..., tuple[float, ...]]:
    """One RK4 step as a compiled function of a state's numbers and parameters, for single states, where arrays cost most. Sums
    go in np_tendency's order, so the numbers are the same to the last bit."""
    xs, made = [f"x{i}" for i in range(s.dim)], []
    for stage, at in enumerate(("x", "y", "z", "w")):
        z = [*(f"{at}{i}" for i in range(s.dim)), *s.parameters]
        if stage:
            made += [f"{z[i]} = x{i} + {dt if stage == 3 else dt / 2!r} * {'abc'[stage - 1]}{i}" for i in range(s.dim)]
        for i in range(s.dim):
            terms = [f"{c!r} * ({' * '.join(z[k] for k in f) or '1.0'})" for row, c, f in s.terms if row == i]
            made.append(f"{'abcd'[stage]}{i} = {' + '.join(['0.0', *terms])}")
    after = ", ".join(f"x{i} + {dt!r} * (a{i} / 2 + b{i} + c{i} + d{i} / 2) / 3" for i in range(s.dim))
    scope: dict = {}
    exec(f"def step({', '.join([*xs, *s.parameters])}):\n" + "".join(f"    {x}\n" for x in made) + f"    return ({after},)\n", scope)
    return scope["step"]


class Kernel:
    """Tendencies and Jacobians of many states side by side, in few operations. States are columns: (variables, states); what
    comes out for one doesn't depend on the others."""

    def __init__(self, s: System):
        self.s = s
        one = s.dim + len(s.parameters)  # stands for 1, where a term has fewer factors than the longest
        terms = sorted([*((row, 0.0, ()) for row in range(s.dim)), *s.terms], key=lambda t: t[0])
        self.factors = self._padded([f for _, _, f in terms], one)
        self.c = np.array([c for _, c, _ in terms])[:, None]
        self.rows = np.searchsorted([row for row, _, _ in terms], np.arange(s.dim))
        products = sorted({f for _, _, _, f in derivative(s)})
        self.products = self._padded(products, one)
        self.cells = np.zeros((len(products), s.dim * s.dim))
        for row, v, c, f in derivative(s):
            self.cells[products.index(f), row * s.dim + v] += c

    @staticmethod
    def _padded(factors: Sequence[tuple[int, ...]], one: int) -> np.ndarray:
        most = max(map(len, factors), default=0)
        return np.array([[*f, *[one] * (max(most, 1) - len(f))] for f in factors]).T

    def full(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.concatenate([x, p, np.ones((1, x.shape[1]))])

    def tendency(self, z: np.ndarray) -> np.ndarray:
        """(variables, states), of full()."""
        return np.add.reduceat(self.c * reduce(np.multiply, (z[k] for k in self.factors)), self.rows, axis=0)

    def jacobian(self, z: np.ndarray) -> np.ndarray:
        """(states, dim, dim), of full()."""
        m = np.ascontiguousarray(reduce(np.multiply, (z[k] for k in self.products)).T)
        return (m[:, None, :] @ self.cells).reshape(-1, self.s.dim, self.s.dim)

    def step(self, x: np.ndarray, p: np.ndarray, dt: float) -> np.ndarray:
        """One RK4 step."""
        a1 = self.tendency(self.full(x, p))
        a2 = self.tendency(self.full(x + dt / 2 * a1, p))
        a3 = self.tendency(self.full(x + dt / 2 * a2, p))
        a4 = self.tendency(self.full(x + dt * a3, p))
        return x + dt * (a1 / 2 + a2 + a3 + a4 / 2) / 3

    def propagator(self, x: np.ndarray, p: np.ndarray, dt: float, steps: int) -> np.ndarray:
        """(states, dim, dim): matrices that carry tangent vectors so many RK4 steps on."""
        u = np.broadcast_to(np.eye(self.s.dim), (x.shape[1], self.s.dim, self.s.dim))
        for _ in range(steps):
            z1 = self.full(x, p)
            a1 = self.tendency(z1)
            z2 = self.full(x + dt / 2 * a1, p)
            a2 = self.tendency(z2)
            z3 = self.full(x + dt / 2 * a2, p)
            a3 = self.tendency(z3)
            z4 = self.full(x + dt * a3, p)
            b1 = self.jacobian(z1) @ u
            b2 = self.jacobian(z2) @ (u + dt / 2 * b1)
            b3 = self.jacobian(z3) @ (u + dt / 2 * b2)
            b4 = self.jacobian(z4) @ (u + dt * b3)
            u = u + dt * (b1 / 2 + b2 + b3 + b4 / 2) / 3
            x = x + dt * (a1 / 2 + a2 + a3 + self.tendency(z4) / 2) / 3
        return u
