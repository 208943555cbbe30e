"""Causal measures on series and signed measures on fields, as value objects.

A one-dimensional measure has weights at lags 0, 1, ...: point atoms, and at most one density of a registered family.
It acts on a series as y[t] = sum over k of weight(k) * x[t - k]. A two-dimensional one has atoms at (rows back,
columns to the left) and at most one separable pair of one-dimensional measures.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np

TINY = 1e-12


@dataclass(frozen=True)
class Atom:
    weight: float
    lag: int

    def __post_init__(self) -> None:
        if isinstance(self.lag, bool) or int(self.lag) != self.lag or self.lag < 0:
            raise ValueError(f"a lag is a whole number from 0: {self.lag}")
        if not math.isfinite(self.weight):
            raise ValueError(f"a weight is finite: {self.weight}")


DENSITIES: dict[str, Callable[[dict[str, float], int], np.ndarray]] = {}


def register_density(name: str):
    """A decorator for a family: a function of its parameters and the last lag, giving the weights at 0 to that lag."""

    def put(f):
        DENSITIES[name] = f
        return f

    return put


def _positive(params: dict[str, float], *names: str) -> list[float]:
    values = [float(params[n]) for n in names]
    if any(not math.isfinite(v) or v <= 0 for v in values):
        raise ValueError(f"{names} must be positive: {values}")
    return values


def smoothing(halflife: float) -> float:
    """The share of the newest value in an average whose weights halve in `halflife` steps."""
    return 1 - 2 ** (-1 / halflife)


@register_density("exponential")
def _exponential(params, last):
    a = smoothing(*_positive(params, "halflife"))
    return a * (1 - a) ** np.arange(last + 1)


def _sums_to_one(weights: np.ndarray) -> np.ndarray:
    return weights / weights.sum()


@register_density("exponential_e")
def _exponential_e(params, last):
    (tau,) = _positive(params, "tau")
    return _sums_to_one(np.exp(-np.arange(last + 1) / tau))


@register_density("power_law")
def _power_law(params, last):
    scale, alpha = _positive(params, "scale", "alpha")
    if alpha <= 1:
        raise ValueError(f"alpha must be over 1: {alpha}")
    return _sums_to_one((1 + np.arange(last + 1) / scale) ** -alpha)


@register_density("gaussian_half")
def _gaussian_half(params, last):
    (sigma,) = _positive(params, "sigma")
    return _sums_to_one(np.exp(-0.5 * (np.arange(last + 1) / sigma) ** 2))


@register_density("rectangular")
def _rectangular(params, last):
    (window,) = _positive(params, "window")
    return np.where(np.arange(last + 1) < window, 1 / window, 0.0)


@register_density("delta_minus_exp")
def _delta_minus_exp(params, last):
    out = -_exponential(params, last)
    out[0] += 1
    return out


@dataclass(frozen=True)
class Density:
    family: str
    params: tuple[tuple[str, float], ...]
    last: int

    def weights(self) -> np.ndarray:
        return DENSITIES[self.family](dict(self.params), self.last)


@dataclass(frozen=True)
class Measure:
    """Equal lags are summed, weights of nearly nothing go, lags rise."""

    atoms: tuple[Atom, ...] = ()
    density: Density | None = None

    def __post_init__(self) -> None:
        by_lag: dict[int, float] = {}
        for atom in self.atoms:
            by_lag[int(atom.lag)] = by_lag.get(int(atom.lag), 0.0) + float(atom.weight)
        object.__setattr__(self, "atoms", tuple(Atom(w, k) for k, w in sorted(by_lag.items()) if abs(w) >= TINY))
        if self.density is not None:
            if self.density.family not in DENSITIES:
                raise ValueError(f"no density {self.density.family!r}; there are {sorted(DENSITIES)}")
            if self.density.last < 0:
                raise ValueError("a density's last lag is 0 or more")
            self.density.weights()  # wrong parameters show here

    @property
    def has_atomic(self) -> bool:
        return bool(self.atoms)

    @property
    def has_density(self) -> bool:
        return self.density is not None

    @property
    def total_atomic_mass(self) -> float:
        return sum(a.weight for a in self.atoms)

    @property
    def is_recursive(self) -> bool:
        """Whether it is an exponential average alone, which is computed by its recurrence, from the first value on."""
        return not self.atoms and self.density is not None and self.density.family == "exponential"

    def is_absolutely_summable(self) -> bool:
        return bool(np.isfinite(np.abs(self.kernel()).sum()))

    def kernel(self) -> np.ndarray:
        """All weights, from lag 0."""
        last = max([0, *(a.lag for a in self.atoms), *([self.density.last] if self.density else [])])
        out = np.zeros(last + 1)
        if self.density:
            out[: self.density.last + 1] += self.density.weights()
        for a in self.atoms:
            out[a.lag] += a.weight
        return out

    @property
    def warmup(self) -> int:
        """The last lag whose weight is not zero; rows before it lack a value."""
        used = np.flatnonzero(self.kernel())
        return int(used[-1]) if len(used) else 0

    def compose(self, other: Measure) -> Measure:
        """The measure that does first `other`, then this."""
        return Measure(tuple(Atom(float(w), k) for k, w in enumerate(np.convolve(self.kernel(), other.kernel())) if w))

    def l1(self) -> float:
        """The most that it can enlarge a bounded series. A recursive average starts at its first value, so its gain is 1."""
        return 1.0 if self.is_recursive else float(np.abs(self.kernel()).sum())

    def gain(self) -> float:
        """What it makes of a constant 1."""
        return 1.0 if self.is_recursive else float(self.kernel().sum())

    def apply(self, x: np.ndarray, fill: float = float("nan")) -> np.ndarray:
        """On one series in memory; rows before the warmup become `fill`."""
        x = np.asarray(x, float)
        if x.ndim != 1:
            raise ValueError("a one-dimensional measure takes one series")
        if self.is_recursive:
            a, out = smoothing(dict(self.density.params)["halflife"]), np.empty_like(x)
            held = float("nan")
            for i, v in enumerate(x.tolist()):
                held = v if i == 0 else a * v + (1 - a) * held
                out[i] = held
            return out
        kernel = self.kernel()
        out = convolve_causal(x, kernel) if len(kernel) > 64 else np.convolve(x, kernel)[: len(x)]
        out[: self.warmup] = fill
        return out


def convolve_causal(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """np.convolve(x, kernel)[:len(x)] by overlap-add of transformed blocks."""
    size = 1 << max(8, (4 * len(kernel) - 1).bit_length())
    step = size - len(kernel) + 1
    spectrum, out = np.fft.rfft(kernel, size), np.zeros(len(x) + size)
    for at in range(0, len(x), step):
        out[at : at + size] += np.fft.irfft(np.fft.rfft(x[at : at + step], size) * spectrum, size)
    return out[: len(x)]


def lag(k: int) -> Measure:
    return Measure((Atom(1.0, k),))


def diff(k: int = 1) -> Measure:
    return Measure((Atom(1.0, 0), Atom(-1.0, k)))


def ema(halflife: float, last: int | None = None) -> Measure:
    return Measure((), Density("exponential", (("halflife", float(halflife)),), int(7 * halflife + 1) if last is None else last))


def roll_mean(window: int) -> Measure:
    return Measure((), Density("rectangular", (("window", float(window)),), int(window)))


def power_law(scale: float, alpha: float, last: int = 256) -> Measure:
    return Measure((), Density("power_law", (("scale", float(scale)), ("alpha", float(alpha))), last))


def signed_sum(terms: Iterable[tuple[float, int]]) -> Measure:
    return Measure(tuple(Atom(float(w), int(k)) for w, k in terms))


# --- functionals: what a tree's node does with one or two arguments; axis: along which of a field's two, "time" or "space"

AXES = ("time", "space")


@dataclass(frozen=True)
class Linear:
    mu: Measure
    axis: str | None = None
    arity: int = field(default=1, init=False)

    def parts(self) -> list[tuple[Measure, int]]:
        """Measures with the number of the argument that each acts on; their results are multiplied."""
        return [(self.mu, 0)]


@dataclass(frozen=True)
class SeparableBilinear:
    mu: Measure
    nu: Measure
    axis: str | None = None
    arity: int = field(default=2, init=False)

    def parts(self) -> list[tuple[Measure, int]]:
        return [(self.mu, 0), (self.nu, 1)]


@dataclass(frozen=True)
class Volterra2:
    mu: Measure
    nu: Measure
    axis: str | None = None
    arity: int = field(default=1, init=False)

    def parts(self) -> list[tuple[Measure, int]]:
        return [(self.mu, 0), (self.nu, 0)]


Functional = Linear | SeparableBilinear | Volterra2


# --- fields


@dataclass(frozen=True)
class Atom2D:
    weight: float
    lag_t: int
    lag_x: int

    def __post_init__(self) -> None:
        if self.lag_t < 0 or not math.isfinite(self.weight):
            raise ValueError("time lags are 0 or more, weights finite")


@dataclass(frozen=True)
class Measure2D:
    atoms: tuple[Atom2D, ...] = ()
    separable: tuple[Measure, Measure] | None = None  # over time, over space

    @property
    def max_lag_t(self) -> int:
        return max([0, *(a.lag_t for a in self.atoms), *([self.separable[0].warmup] if self.separable else [])])

    @property
    def max_abs_lag_x(self) -> int:
        return max([0, *(abs(a.lag_x) for a in self.atoms), *([self.separable[1].warmup] if self.separable else [])])

    def points(self) -> list[Atom2D]:
        """All weights as atoms; a separable pair is the product of its kernels."""
        out = list(self.atoms)
        if self.separable:
            t, x = (m.kernel() for m in self.separable)
            out += [Atom2D(float(a * b), i, j) for i, a in enumerate(t) if a for j, b in enumerate(x) if b]
        return out

    def l1(self) -> float:
        return sum(abs(a.weight) for a in self.atoms) + (self.separable[0].l1() * self.separable[1].l1() if self.separable else 0.0)

    def is_absolutely_summable(self) -> bool:
        return math.isfinite(self.l1())

    def apply(self, u: np.ndarray, fill: float = float("nan")) -> np.ndarray:
        """On a field [t, x] in memory; rows and columns that lack a neighbour become `fill`."""
        u = np.asarray(u, float)
        if u.ndim != 2:
            raise ValueError("a two-dimensional measure takes a field")
        rows, cols = u.shape
        out, low, side = np.zeros_like(u), self.max_lag_t, self.max_abs_lag_x
        for a in self.points():
            t0, left = a.lag_t, a.lag_x
            here_t, from_t = slice(t0, rows), slice(0, rows - t0)
            here_x = slice(max(0, left), cols + min(0, left))
            from_x = slice(max(0, -left), cols - max(0, left))
            out[here_t, here_x] += a.weight * u[from_t, from_x]
        out[:low] = fill
        if side:
            out[:, :side] = fill
            out[:, cols - side :] = fill
        return out


def atomic_2d(atoms: Iterable[tuple[float, int, int]]) -> Measure2D:
    return Measure2D(tuple(Atom2D(*a) for a in atoms))


def separable_2d(over_t: Measure, over_x: Measure) -> Measure2D:
    return Measure2D((), (over_t, over_x))


def laplacian() -> Measure2D:
    """The second difference over space."""
    return atomic_2d([(1.0, 0, 1), (-2.0, 0, 0), (1.0, 0, -1)])


def diff_t(k: int = 1) -> Measure2D:
    return atomic_2d([(1.0, 0, 0), (-1.0, k, 0)])


def grad_x() -> Measure2D:
    return atomic_2d([(0.5, 0, -1), (-0.5, 0, 1)])


def sobel_x() -> Measure2D:
    """Change over space, smoothed over three rows; the newest row is the last."""
    return atomic_2d([(s * w, t, -s) for t, w in ((2, 1.0), (1, 2.0), (0, 1.0)) for s in (1, -1)])


def sobel_y() -> Measure2D:
    """Change over three rows, smoothed over space."""
    return atomic_2d([(s * w, t, x) for t, s in ((2, -1.0), (0, 1.0)) for x, w in ((1, 1.0), (0, 2.0), (-1, 1.0))])
