"""Dynamical systems as row generators, and statistical signatures of trajectories.

Trajectories are rows (traj_id, i, t, state array<double>). Generation is sequential inside a trajectory and parallel
across them. Cheap signatures are SQL aggregates over all trajectories at once; those that need whole series, neighbours
or spectra run a trajectory a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galena.sources.tables import materialised

TRAJECTORY = "traj_id string, i long, t double, state array<double>"


def rk4(f: Callable[[np.ndarray], np.ndarray], start: np.ndarray, dt: float, steps: int) -> np.ndarray:
    out = np.empty((steps + 1, *np.shape(start)))
    out[0] = start
    for k in range(steps):
        s = out[k]
        a = f(s)
        b = f(s + dt / 2 * a)
        c = f(s + dt / 2 * b)
        out[k + 1] = s + dt / 6 * (a + 2 * b + 2 * c + f(s + dt * c))
    return out


def euler(f: Callable[[np.ndarray], np.ndarray], start: np.ndarray, dt: float, steps: int, edge: Callable[[np.ndarray], None] | None = None) -> np.ndarray:
    out = np.empty((steps + 1, len(start)))
    out[0] = start
    for k in range(steps):
        out[k + 1] = out[k] + dt * f(out[k])
        if edge:
            edge(out[k + 1])
    return out


# fixed values: the words that a system may declare, and the signatures that make sense for a class of models
SYMMETRIES = ("reflection", "rotation_so2", "rotation_so3", "scaling", "space_translation", "time_reversal", "time_translation")
CONSERVED = ("angular_momentum", "energy", "l2_norm", "linear_momentum", "phase_volume")
SMOOTHNESS = ("analytic", "c_infty", "c_2", "lipschitz", "general")
APPLIES = {
    "algebraic": ("dimension", "modes", "smoothness", "symmetry"),
    "map": ("conservation", "determinism", "dimension", "modes", "smoothness", "spectral", "symmetry"),
    "ode": ("conservation", "determinism", "dimension", "lyapunov", "modes", "smoothness", "spectral", "symmetry"),
    "pde": ("conservation", "determinism", "dimension", "lyapunov", "modes", "smoothness", "spectral", "symmetry"),
}


@dataclass(frozen=True)
class System:
    name: str
    kind: str  # ode, pde or algebraic
    params: dict[str, float]
    start: Callable[[dict], np.ndarray]
    rate: Callable[[dict], Callable[[np.ndarray], np.ndarray]]
    dt: float
    seconds: float
    skip: float = 0.0
    symmetries: tuple[str, ...] = ()
    conserved: tuple[str, ...] = ()
    smooth: str = "c_infty"
    modes: int = 1
    edge: Callable[[np.ndarray], None] | None = None

    def __post_init__(self) -> None:
        for given, allowed, what in ((self.symmetries, SYMMETRIES, "symmetry"), (self.conserved, CONSERVED, "conserved quantity"), ((self.smooth,), SMOOTHNESS, "class of smoothness"), ((self.kind,), tuple(APPLIES), "class of models")):
            for word in given:
                if word not in allowed:
                    raise ValueError(f"{word!r} is no {what}; there are {', '.join(allowed)}")

    def metadata(self) -> dict:
        """What the system declares about itself."""
        size = len(self.start(self.params))
        return {"name": self.name, "class": self.kind, "state_size": size, "symmetries": list(self.symmetries), "conserved": list(self.conserved), "smoothness": self.smooth, "modes": self.modes, "params": dict(self.params)}

    def run(self, params: dict[str, float] | None = None, start: np.ndarray | None = None, seconds: float | None = None, noise: float = 0.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(times, states), with Gaussian noise of the given size on the states."""
        p = {**self.params, **(params or {})}
        rng = np.random.default_rng(seed)
        if self.kind == "algebraic":
            theta = rng.uniform(0.5, 5, int(seconds or 2000))
            states = np.exp(-theta * theta / 2)[:, None]
            times = np.arange(len(states), dtype=float)
        else:
            steps = int(round((self.seconds if seconds is None else seconds) / self.dt))
            before = int(round(self.skip / self.dt))
            s0 = self.start(p) if start is None else np.asarray(start, float)
            states = (rk4(self.rate(p), s0, self.dt, steps + before) if self.kind == "ode" else euler(self.rate(p), s0, self.dt, steps, self.edge))[before:]
            times = np.arange(len(states)) * self.dt
        return times, states + noise * rng.standard_normal(states.shape) if noise else states


SYSTEMS: dict[str, System] = {}


def register(system: System) -> System:
    SYSTEMS[system.name] = system
    return system


def _heat(p):
    def f(u):
        out = np.zeros_like(u)
        out[1:-1] = p["alpha"] * (u[2:] - 2 * u[1:-1] + u[:-2])
        return out

    return f


def _burgers(p):
    def f(u):
        dx = p["length"] / len(u)
        slope = np.where(u > 0, u - np.roll(u, 1), np.roll(u, -1) - u) / dx
        return -u * slope + p["nu"] * (np.roll(u, -1) - 2 * u + np.roll(u, 1)) / dx**2

    return f


def _ends_to_zero(u: np.ndarray) -> None:
    u[0] = u[-1] = 0.0


# fixed values: the usual parameters, starts and steps of the eleven systems
register(System("harmonic_1d", "ode", {"omega": 1.0}, lambda p: np.array([1.0, 0.0]), lambda p: lambda s: np.array([s[1], -p["omega"] ** 2 * s[0]]), 0.01, 20.0, symmetries=("time_translation", "time_reversal", "reflection"), conserved=("energy",)))
register(System("damped_harmonic_1d", "ode", {"omega": 1.0, "gamma": 0.2}, lambda p: np.array([1.0, 0.0]), lambda p: lambda s: np.array([s[1], -p["omega"] ** 2 * s[0] - p["gamma"] * s[1]]), 0.01, 20.0, symmetries=("reflection",)))
register(System("vdp", "ode", {"mu": 1.0}, lambda p: np.array([2.0, 0.0]), lambda p: lambda s: np.array([s[1], p["mu"] * (1 - s[0] ** 2) * s[1] - s[0]]), 0.01, 30.0, symmetries=("reflection",)))
register(System("lorenz63", "ode", {"sigma": 10.0, "rho": 28.0, "beta": 8 / 3}, lambda p: np.array([1.0, 1.0, 1.0]), lambda p: lambda s: np.array([p["sigma"] * (s[1] - s[0]), s[0] * (p["rho"] - s[2]) - s[1], s[0] * s[1] - p["beta"] * s[2]]), 0.01, 20.0, skip=2.0))
register(System("fhn", "ode", {"eps": 0.08, "a": 0.7, "b": 0.8, "current": 0.5}, lambda p: np.array([-1.0, 1.0]), lambda p: lambda s: np.array([s[0] - s[0] ** 3 / 3 - s[1] + p["current"], p["eps"] * (s[0] + p["a"] - p["b"] * s[1])]), 0.05, 200.0))
register(System("heat_1d", "pde", {"alpha": 0.05, "n": 64.0}, lambda p: np.exp(-0.5 * ((np.arange(int(p["n"])) - p["n"] / 2) / 4) ** 2) * 10, _heat, 0.1, 20.0, edge=_ends_to_zero))
register(System("burgers_1d", "pde", {"nu": 0.02, "n": 128.0, "length": 2 * math.pi}, lambda p: np.sin(np.arange(int(p["n"])) * p["length"] / p["n"]) + 0.5, _burgers, 0.005, 2.0, smooth="lipschitz"))
register(System("linear_pendulum", "ode", {"g_over_l": 9.81}, lambda p: np.array([0.1, 0.0]), lambda p: lambda s: np.array([s[1], -p["g_over_l"] * s[0]]), 0.01, 20.0, conserved=("energy",)))
register(System("nonlinear_pendulum", "ode", {"g_over_l": 9.81}, lambda p: np.array([1.5, 0.0]), lambda p: lambda s: np.array([s[1], -p["g_over_l"] * math.sin(s[0])]), 0.01, 20.0, conserved=("energy",)))
register(System("kepler", "ode", {"gm": 1.0}, lambda p: np.array([1.0, 0.0, 0.0, 0.8]), lambda p: lambda s: np.concatenate([s[2:], -p["gm"] * s[:2] / (s[0] ** 2 + s[1] ** 2) ** 1.5]), 0.005, 20.0, symmetries=("rotation_so2",), conserved=("energy", "angular_momentum")))
register(System("algebraic_feynman_gaussian", "algebraic", {}, lambda p: np.zeros(1), lambda p: lambda s: s, 1.0, 2000.0))


def trajectories(spark: SparkSession, requests: list[dict]) -> DataFrame:
    """Rows of trajectories, one request {system, traj_id?, params?, start?, seconds?, noise?, seed?} a task's row."""
    import json

    rows = [(str(r.get("traj_id", r["system"])), json.dumps({k: v for k, v in r.items() if k != "traj_id"})) for r in requests]

    def run(batches):
        for pdf in batches:
            for name, spec in zip(pdf["traj_id"], pdf["spec"], strict=True):
                r = json.loads(spec)
                times, states = SYSTEMS[r.pop("system")].run(**r)
                yield pd.DataFrame({"traj_id": name, "i": np.arange(len(times)), "t": times, "state": list(states)})

    return spark.createDataFrame(rows, "traj_id string, spec string").repartition(max(1, len(rows)), "traj_id").mapInPandas(run, TRAJECTORY)


def target_rows(traj: DataFrame, kind: str = "ode") -> DataFrame:
    """(traj_id, i, x array, y array): the state and what is to be explained: its rate, its change, or the next state."""
    w = Window.partitionBy("traj_id").orderBy("i")
    nxt, gap = F.lead("state").over(w), F.lead("t").over(w) - F.col("t")
    rows = traj.select("traj_id", "i", F.col("state").alias("x"), nxt.alias("n"), gap.alias("dt")).where("n is not null")
    change = F.zip_with("n", "x", lambda a, b: a - b)
    y = {"ode": F.transform(change, lambda v: v / F.col("dt")), "pde": change, "map": F.col("n")}[kind]
    return rows.select("traj_id", "i", "x", y.alias("y"))


# --- signatures as aggregates over all trajectories


def _long(traj: DataFrame) -> DataFrame:
    return traj.select("traj_id", "i", F.posexplode("state").alias("k", "v"))


def autocorrelation(traj: DataFrame, most_lag: int = 20) -> DataFrame:
    """(traj_id, k, lag, acf): biased to the component's whole variance; all lags share one window."""
    rows = _long(traj)
    stats = rows.groupBy("traj_id", "k").agg(F.avg("v").alias("m"), F.var_pop("v").alias("var"), F.count("*").alias("n"))
    w = Window.partitionBy("traj_id", "k").orderBy("i")
    centred = rows.join(stats, ["traj_id", "k"]).withColumn("c", F.col("v") - F.col("m"))
    lagged = centred.select("traj_id", "k", "var", "n", "c", *[F.lead("c", lag).over(w).alias(f"c{lag}") for lag in range(1, most_lag + 1)])
    sums = lagged.groupBy("traj_id", "k").agg(F.first("var").alias("var"), F.first("n").alias("n"), *[F.avg(F.col("c") * F.col(f"c{lag}")).alias(f"a{lag}") for lag in range(1, most_lag + 1)])
    each = ", ".join(f"{lag}, a{lag}" for lag in range(1, most_lag + 1))
    flat = sums.selectExpr("traj_id", "k", "var", "n", f"stack({most_lag}, {each}) as (lag, a)")
    # a lag of half the series and more says nothing
    return flat.where(F.col("lag") < F.col("n") / 2).select("traj_id", "k", "lag", F.when(F.col("var") > 1e-300, F.col("a") / F.col("var")).otherwise(F.lit(0.0)).alias("acf"))


def time_autocorrelation(traj: DataFrame, most_lag: int = 20) -> DataFrame:
    """(traj_id, t_acf): the largest size over lags, averaged over components."""
    top = autocorrelation(traj, most_lag).groupBy("traj_id", "k").agg(F.max(F.abs("acf")).alias("top"))
    return top.groupBy("traj_id").agg(F.avg("top").alias("t_acf"))


def spatial_autocorrelation(traj: DataFrame, rows: int = 20, least_width: int = 15) -> DataFrame:
    """(traj_id, x_acf): neighbours' correlation along the state, averaged over evenly taken rows; null for short states."""
    n = traj.groupBy("traj_id").agg(F.max("i").alias("last"))
    some = traj.join(n, "traj_id").where((F.size("state") >= least_width) & (F.col("i") % F.greatest(F.lit(1), F.floor(F.col("last") / rows)) == 0))
    mean = F.aggregate("state", F.lit(0.0), lambda a, v: a + v) / F.size("state")
    c = some.withColumn("c", F.transform("state", lambda v: v - F.col("m"))) if "m" in some.columns else some.withColumn("m", mean).withColumn("c", F.transform("state", lambda v: v - F.col("m")))
    pairs = F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: a * b)
    add = lambda a, v: a + v
    made = c.select("traj_id", (F.aggregate(pairs, F.lit(0.0), add) / (F.size("c") - 1)).alias("cov"), (F.aggregate(F.transform("c", lambda v: v * v), F.lit(0.0), add) / F.size("c")).alias("var"))
    return made.where("var > 1e-300").groupBy("traj_id").agg(F.avg(F.col("cov") / F.col("var")).alias("x_acf"))


def permutation_invariance(traj: DataFrame, shuffles: int = 8, seed: int = 3) -> DataFrame:
    """(traj_id, invariance): 1 - |acf1| / (|acf1| + mean |acf1 of shuffled rows|), averaged over components. Near 1/2 and above: order says little."""
    orders = {"own": F.col("i"), **{f"s{j}": F.xxhash64(F.lit(seed), F.lit(j), "i") for j in range(shuffles)}}
    rows = _long(traj)
    stats = rows.groupBy("traj_id", "k").agg(F.avg("v").alias("m"), F.var_pop("v").alias("var"))
    rows = rows.join(stats, ["traj_id", "k"]).withColumn("c", F.col("v") - F.col("m"))
    made = rows.select("traj_id", "k", "var", *[(F.col("c") * F.lead("c").over(Window.partitionBy("traj_id", "k").orderBy(o, "i"))).alias(n) for n, o in orders.items()])
    acf = made.groupBy("traj_id", "k").agg(*[F.coalesce(F.abs(F.avg(n) / F.nullif(F.first("var"), F.lit(0.0))), F.lit(0.0)).alias(n) for n in orders])
    noise = sum((F.col(f"s{j}") for j in range(shuffles)), F.lit(0.0)) / shuffles
    ratio = F.when(F.col("own") + noise > 0, 1 - F.col("own") / (F.col("own") + noise)).otherwise(F.lit(1.0))
    return acf.groupBy("traj_id").agg(F.avg(ratio).alias("invariance"))


def model_class(traj: DataFrame) -> DataFrame:
    """(traj_id, class): pde, ode or algebraic."""
    found = time_autocorrelation(traj).join(permutation_invariance(traj), "traj_id").join(spatial_autocorrelation(traj), "traj_id", "left")
    kind = F.when(F.col("x_acf") >= 0.3, "pde").when((F.col("invariance") >= 0.8) & (F.col("t_acf") < 0.3), "algebraic").when(F.col("t_acf") >= 0.3, "ode").otherwise("algebraic")
    return found.select("traj_id", "t_acf", "x_acf", "invariance", kind.alias("class"))


def smoothness(traj: DataFrame, lags: tuple[int, ...] = (1, 2, 4, 8, 16)) -> DataFrame:
    """(traj_id, smoothness): half the slope of the log mean square increment over the log lag, weighted by variance; 1 for smooth paths, 1/2 for Brownian ones."""
    rows = _long(traj)
    w = Window.partitionBy("traj_id", "k").orderBy("i")
    gaps = rows.select("traj_id", "k", "v", *[(F.lead("v", g).over(w) - F.col("v")).alias(f"d{g}") for g in lags])
    sums = gaps.groupBy("traj_id", "k").agg(F.var_pop("v").alias("var"), *[F.avg(F.col(f"d{g}") * F.col(f"d{g}")).alias(f"s{g}") for g in lags])
    each = ", ".join(f"{g}, s{g}" for g in lags)
    flat = sums.where("var > 0").selectExpr("traj_id", "k", "var", f"stack({len(lags)}, {each}) as (g, s)").where("s > 0")
    slope = flat.groupBy("traj_id", "k").agg(F.first("var").alias("var"), (F.regr_slope(F.log("s"), F.log("g")) / 2).alias("h")).where("h is not null")
    return slope.groupBy("traj_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.sum(F.col("h") * F.col("var")) / F.sum("var"))).alias("smoothness"))


def stencil_locality(traj: DataFrame, traj_id: str, most: int = 5, least_r2: float = 0.99) -> int | None:
    """The least k at which the change of a point is linear in its 2k + 1 neighbours; all k on one factor."""
    from galena.operators.regression import _fit, factor

    one = traj.where(F.col("traj_id") == traj_id)
    width = one.agg(F.min(F.size("state"))).first()[0]
    if not width or width < 2 * most + 2:
        return None
    # the next row by its number, so that a long trajectory is no single window
    rows = one.select("i", "state").join(one.select((F.col("i") - 1).alias("i"), F.col("state").alias("n")), "i").select("state", "n", F.explode(F.sequence(F.lit(most), F.lit(width - 1 - most))).alias("x"))
    f = factor(rows, {str(s): F.get("state", F.col("x") + s) for s in range(-most, most + 1)}, F.get("n", F.col("x")) - F.get("state", F.col("x")), intercept=False)
    total = f.solve([])[1]
    for k in range(most + 1):
        if _fit(f, list(range(most - k, most + k + 1)), total).r2 > least_r2:
            return k
    return None


def symmetry(traj: DataFrame) -> DataFrame:
    """(traj_id, time_translation, time_reversal, reflection, rotation_so2): scores from 0 to 1."""
    rows = _long(traj)
    n = rows.groupBy("traj_id", "k").agg(F.max("i").alias("last"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    r = rows.join(n, ["traj_id", "k"])
    w = Window.partitionBy("traj_id", "k").orderBy("i")
    r = r.withColumn("half", (F.col("i") > F.col("last") / 2).cast("int")).withColumn("d", F.lead("v").over(w) - F.col("v"))
    halves = r.groupBy("traj_id", "k").agg(F.first("s").alias("s"), F.first("m").alias("m"), *[f(F.when(F.col("half") == h, F.col("v"))).alias(f"{n_}{h}") for h in (0, 1) for n_, f in (("m", F.avg), ("s", F.stddev_pop))], F.avg("d").alias("d"), F.stddev_pop("d").alias("ds"), F.avg(F.pow(F.col("d"), F.lit(3.0))).alias("d3"), F.avg(F.pow(F.col("v") - F.col("m"), F.lit(3.0))).alias("v3"))
    tiny = F.lit(1e-12)
    shift = F.exp(-(F.abs(F.col("m0") - F.col("m1")) + F.abs(F.col("s0") - F.col("s1"))) / (F.col("s") + tiny))
    back = F.exp(-F.abs(F.col("d3")) / (F.pow(F.col("ds"), F.lit(3.0)) + tiny))
    mirror = F.exp(-F.abs(F.col("m")) / (F.col("s") + tiny) - F.abs(F.col("v3")) / (F.pow(F.col("s"), F.lit(3.0)) + tiny))
    flat = halves.groupBy("traj_id").agg(F.avg(shift).alias("time_translation"), F.avg(back).alias("time_reversal"), F.avg(mirror).alias("reflection"))
    # the angle's spread over sixteen parts of the circle
    mean = traj.where(F.size("state") >= 2).groupBy("traj_id").agg(F.avg(F.get("state", F.lit(0))).alias("a"), F.avg(F.get("state", F.lit(1))).alias("b"))
    angle = F.atan2(F.get("state", F.lit(1)) - F.col("b"), F.get("state", F.lit(0)) - F.col("a"))
    bins = traj.join(mean, "traj_id").select("traj_id", F.least(F.lit(15), F.floor((angle + math.pi) / (2 * math.pi) * 16)).alias("bin")).groupBy("traj_id", "bin").count()
    total = bins.groupBy("traj_id").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.log("count")).alias("c"))
    turn = total.select("traj_id", ((F.log("n") - F.col("c") / F.col("n")) / math.log(16)).alias("rotation_so2"))
    return flat.join(turn, "traj_id", "left")


def effective_dimension(traj: DataFrame) -> DataFrame:
    """(traj_id, dimension): (sum of eigenvalues)^2 / sum of squares, of the covariance; from its trace and its entries alone."""
    rows = _long(traj)
    stats = rows.groupBy("traj_id", "k").agg(F.avg("v").alias("m"))
    means = stats.groupBy("traj_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("means"))
    c = traj.join(means, "traj_id").select("traj_id", F.zip_with("state", "means", lambda a, b: a - b).alias("c"))
    pairs = c.select("traj_id", F.posexplode("c").alias("p", "x"), F.col("c")).select("traj_id", "p", "x", F.posexplode("c").alias("q", "y"))
    cov = pairs.groupBy("traj_id", "p", "q").agg(F.avg(F.col("x") * F.col("y")).alias("v"))
    sums = cov.groupBy("traj_id").agg(F.sum(F.when(F.col("p") == F.col("q"), F.col("v"))).alias("trace"), F.sum(F.col("v") * F.col("v")).alias("squares"))
    return sums.select("traj_id", (F.col("trace") * F.col("trace") / F.nullif("squares", F.lit(0.0))).alias("dimension"))


# --- signatures of a whole series, one trajectory a task


def spectral(x: np.ndarray, dt: float, size: int = 256) -> dict[str, float]:
    """Welch's periodogram with Hann windows that overlap by half: peak over mean, flatness, strongest frequency."""
    size = min(size, len(x))
    if size < 8:
        return {}
    window = np.hanning(size + 1)[:-1]
    starts = range(0, len(x) - size + 1, max(1, size // 2))
    power = np.mean([np.abs(np.fft.rfft((x[s : s + size] - x[s : s + size].mean()) * window)) ** 2 for s in starts], axis=0)[1:]
    if power.sum() <= 0:
        return {"peak": 0.0, "flatness": 1.0, "frequency": 0.0}
    return {"peak": float(power.max() / power.mean()), "flatness": float(np.exp(np.log(power + 1e-300).mean()) / power.mean()), "frequency": float(np.fft.rfftfreq(size, dt)[1:][power.argmax()])}


def principal(states: np.ndarray, most: int) -> np.ndarray:
    """The states along their first principal directions, at most so many; as they are if they have no more columns."""
    if states.shape[1] <= most:
        return states
    c = states - states.mean(0)
    # by the smaller of the two Gram matrices, so wide fields stay cheap
    if c.shape[1] <= c.shape[0]:
        return c @ np.linalg.eigh(c.T @ c)[1][:, ::-1][:, :most]
    values, left = np.linalg.eigh(c @ c.T)
    return left[:, ::-1][:, :most] * np.sqrt(np.maximum(values[::-1][:most], 0))


def _embed(x: np.ndarray, m: int) -> np.ndarray:
    return np.stack([x[k : len(x) - m + k + 1] for k in range(m)], 1)


def _forecast_error(x: np.ndarray, m: int, k: int, tests: int) -> float:
    """The mean size of the error, in standard deviations, of the last `tests` steps, each forecast by the nearest points of the stretch before all of them."""
    points, nxt = _embed(x[:-1], m), x[m:]
    known = len(points) - tests - k
    before = points[:known]
    error = [abs(nxt[np.argpartition(((before - p) ** 2).sum(1), k)[:k]].mean() - y) for p, y in zip(points[-tests:], nxt[-tests:], strict=True)]
    return float(np.mean(error) / x.std())


def determinism(x: np.ndarray, m: int = 3, k: int = 5, surrogates: int = 5, tests: int = 200, seed: int = 1) -> dict[str, float]:
    """How much better neighbours predict the next value than in series of the same spectrum with random phases: a z-score.

    Nothing for constant series and for those too short for a test.
    """
    if len(x) < m + tests + 3 * k or x.std() == 0:
        return {}
    rng, own = np.random.default_rng(seed), _forecast_error(x, m, k, tests)
    spectrum, others = np.fft.rfft(x - x.mean()), []
    for _ in range(surrogates):
        phases = np.exp(2j * np.pi * rng.random(len(spectrum)))
        phases[0] = 1
        others.append(_forecast_error(np.fft.irfft(np.abs(spectrum) * phases, len(x)), m, k, tests))
    return {"z": float((np.mean(others) - own) / (np.std(others) + 1e-9)), "error": own}


def nearest_apart(points: np.ndarray, apart: int) -> np.ndarray:
    """For each point the nearest other one whose number differs by more than `apart`, ties to the smaller number; -1 where there is none.

    Points are compared in the order of their first coordinate, outwards from each, until that coordinate alone is farther off
    than the best so far: exact, and no square of the length is held.
    """
    n = len(points)
    order = np.argsort(points[:, 0], kind="stable")
    p = points[order]
    best, found = np.full(n, np.inf), np.full(n, -1)
    for way in (1, -1):
        active, step = np.arange(n), way
        while len(active):
            active = active[(active + step >= 0) & (active + step < n)]
            other = active + step
            gap = (p[other, 0] - p[active, 0]) ** 2
            go = gap <= best[active]
            active, other = active[go], other[go]
            d = ((p[other] - p[active]) ** 2).sum(1)
            far = np.abs(order[other] - order[active]) > apart
            closer = far & ((d < best[active]) | (d == best[active]) & (order[other] < found[active]))
            best[active[closer]], found[active[closer]] = d[closer], order[other[closer]]
            step += way
    out = np.empty(n, int)
    out[order] = found
    return out


def lyapunov(x: np.ndarray, dt: float, m: int = 3, theiler: int = 10, steps: int = 30, fit: int = 15) -> dict[str, float]:
    """Rosenstein's largest exponent: the slope of the mean log distance of neighbours that part. Over the whole series."""
    points = _embed(x, m)
    n = len(points) - steps
    if n < 50:
        return {}
    near = nearest_apart(points[:n], theiler)
    i = np.flatnonzero(near >= 0)
    logs = []
    for s in range(fit):
        d = np.sqrt(((points[i + s] - points[near[i] + s]) ** 2).sum(1))
        logs.append(np.log(d[d > 1e-12]).mean() if (d > 1e-12).any() else 0.0)
    return {"exponent": float(np.polyfit(np.arange(fit) * dt, logs, 1)[0])}


def correlation_dimension(states: np.ndarray, points: int = 1500, widest: int = 6, seed: int = 0) -> dict[str, float]:
    """The slope of the log share of close pairs by log distance, from the first to the fiftieth percentile of distances, on a bounded draw of points.

    Nothing for series under 500 rows or states of more than `widest` columns.
    """
    n = len(states)
    if n < 500 or states.shape[1] > widest:
        return {}
    x = states[np.sort(np.random.default_rng(seed).choice(n, min(n, points), replace=False))]
    d = np.concatenate([np.sqrt(((x[i + 1 :] - x[i]) ** 2).sum(1)) for i in range(len(x) - 1)])
    d.sort()
    low, high = np.percentile(d, 1), np.percentile(d, 50)
    if not 0 < low < high:
        return {}
    radii = np.exp(np.linspace(np.log(low), np.log(high), 10))
    share = np.searchsorted(d, radii) / len(d)
    return {"correlation": float(np.polyfit(np.log(radii[share > 0]), np.log(share[share > 0]), 1)[0])} if (share > 0).sum() >= 4 else {}


def conservation(states: np.ndarray, degree: int = 3, seed: int = 2) -> dict[str, float]:
    """For each degree the least share of variance of a combination of monomials, against the same of independently shuffled columns.

    Wider states are taken along their first four principal directions.
    """
    from galena.operators.regression import monomials

    states = principal(states, 4)
    rng, out = np.random.default_rng(seed), {}
    scaled = (states - states.mean(0)) / (states.std(0) + 1e-12)
    d = scaled.shape[1]
    shuffled = np.column_stack([rng.permutation(c) for c in scaled.T])
    for k in range(1, degree + 1):
        powers = monomials([str(i) for i in range(d)], k)

        def least(s: np.ndarray, powers=powers) -> float:
            phi = np.column_stack([np.prod(s ** np.array(p), axis=1) for p in powers])
            phi = (phi - phi.mean(0)) / (phi.std(0) + 1e-12)
            return float(max(0.0, np.linalg.eigvalsh(phi.T @ phi / len(phi))[0]))

        out[f"degree{k}"] = least(scaled) / (least(shuffled) + 1e-12)
    return out


def mode_count(states: np.ndarray, most: int = 5, points: int = 500, seed: int = 4) -> dict[str, float]:
    """The number of Gaussians of least BIC for at most two principal components of evenly taken states, by EM."""
    x = states[np.linspace(0, len(states) - 1, min(points, len(states))).astype(int)]
    x = x - x.mean(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    z = (u * s)[:, : min(2, x.shape[1])]
    z = z / (z.std(0) + 1e-12)
    n, d = z.shape
    best, count = math.inf, 1
    for k in range(1, most + 1):
        rng = np.random.default_rng(seed)
        mean, cov, weight = z[rng.choice(n, k, replace=False)].copy(), np.array([np.eye(d)] * k), np.full(k, 1 / k)
        loglik, diff = -math.inf, z - mean[:, None]
        for _ in range(60):
            # all k Gaussians at once: (k, n) logs of their shares
            inverse, size = (1 / cov, cov[:, 0, 0]) if d == 1 else (np.linalg.inv(cov), np.linalg.det(cov))
            logs = (np.log(weight + 1e-300) - 0.5 * (np.log(size) + d * math.log(2 * math.pi)))[:, None] - 0.5 * (diff @ inverse * diff).sum(2)
            top = logs.max(0)
            p = np.exp(logs - top)
            whole = p.sum(0)
            new = float((top + np.log(whole)).sum())
            p /= whole
            w = p.sum(1) + 1e-9
            mean = p @ z / w[:, None]
            diff = z - mean[:, None]
            cov = (p[:, :, None] * diff).transpose(0, 2, 1) @ diff / w[:, None, None] + 1e-4 * np.eye(d)
            weight = w / n
            if new - loglik < 1e-5 * abs(new):
                break
            loglik = new
        bic = -2 * new + (k * (d + d * (d + 1) / 2) + k - 1) * math.log(n)
        if bic < best:
            best, count = bic, k
    return {"modes": float(count)}


@dataclass
class Signature:
    values: dict[str, dict[str, float]] = field(default_factory=dict)


def series_signatures(traj: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(traj_id, signature, key, value) of spectral, determinism, lyapunov, conservation, dimension (correlation) and modes: a trajectory a task.

    classes: (traj_id, class); then only the signatures that apply to a trajectory's class are computed, and none for one without.
    """
    limited = classes is not None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        states = np.array(pdf["state"].tolist())
        x, dt = states[:, 0], float(np.median(np.diff(pdf["t"]))) if len(pdf) > 1 else 1.0
        each = {"spectral": lambda: spectral(x, dt), "determinism": lambda: determinism(principal(states, 1)[:, 0]), "lyapunov": lambda: lyapunov(x, dt), "conservation": lambda: conservation(states), "dimension": lambda: correlation_dimension(states), "modes": lambda: mode_count(states)}
        asked = APPLIES[pdf["class"].iloc[0]] if limited else each
        rows = [(pdf["traj_id"].iloc[0], s, k, float(v)) for s, f in each.items() if s in asked for k, v in f().items()]
        return pd.DataFrame(rows, columns=["traj_id", "signature", "key", "value"])

    rows = traj if classes is None else traj.select("traj_id", "i", "t", "state").join(classes.select("traj_id", "class"), "traj_id")
    return rows.groupBy("traj_id").applyInPandas(run, "traj_id string, signature string, key string, value double")


def full_signature(traj: DataFrame, kind: str | None = None) -> DataFrame:
    """(traj_id, class, signature, key, value): the measures that tell classes apart, and the signatures that apply to the class of each trajectory.

    kind: the class of all of them, where it is known; else it is found.
    """
    melt = lambda df, name, cols: df.selectExpr("traj_id", f"'{name}' as signature", f"stack({len(cols)}, {', '.join(f"'{c}', cast({c} as double)" for c in cols)}) as (key, value)")
    classes = materialised(model_class(traj), True)
    named = traj.select("traj_id").distinct().withColumn("class", F.lit(kind)) if kind else classes.select("traj_id", "class")
    out = series_signatures(traj, named)
    for df, name, cols in ((classes, "model_class", ["t_acf", "x_acf", "invariance"]), (smoothness(traj), "smoothness", ["smoothness"]), (symmetry(traj), "symmetry", ["time_translation", "time_reversal", "reflection", "rotation_so2"]), (effective_dimension(traj), "dimension", ["dimension"])):
        out = out.unionByName(melt(df, name, cols))
    allowed = F.create_map(*[v for k, names in APPLIES.items() for v in (F.lit(k), F.array(*map(F.lit, ("model_class", *names))))])
    return out.where("value is not null").join(named, "traj_id").where(F.array_contains(F.element_at(allowed, F.col("class")), F.col("signature"))).select("traj_id", "class", "signature", "key", "value")
