"""Slot programs over a smooth operator table: evolution, a cross-entropy policy, relaxed choices by gradient, enumeration.

A program has inputs (variables and free constants) and nodes; each node applies an operator to earlier slots, the last is
the output. The table's protections are smooth, so constants can be fitted by gradient; nodes are held within 1e6.
Derivatives with respect to constants are carried forward exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

EPS, LIMIT, EXP_LIMIT = 1e-6, 1e6, 30.0

#: name -> (arity, value, derivatives): smooth forms of the usual operators.
OPS: dict[str, tuple[int, Callable, Callable]] = {
    "add": (2, lambda a, b: a + b, lambda a, b: (np.ones_like(a), np.ones_like(b))),
    "sub": (2, lambda a, b: a - b, lambda a, b: (np.ones_like(a), -np.ones_like(b))),
    "mul": (2, lambda a, b: a * b, lambda a, b: (b, a)),
    "div": (2, lambda a, b: a * b / (b * b + EPS), lambda a, b: (b / (b * b + EPS), a * (EPS - b * b) / (b * b + EPS) ** 2)),
    "id": (1, lambda a: a, lambda a: (np.ones_like(a),)),
    "neg": (1, lambda a: -a, lambda a: (-np.ones_like(a),)),
    "square": (1, lambda a: a * a, lambda a: (2 * a,)),
    "inv": (1, lambda a: a / (a * a + EPS), lambda a: ((EPS - a * a) / (a * a + EPS) ** 2,)),
    "sqrt": (1, lambda a: np.sqrt(np.abs(a) + EPS), lambda a: (np.sign(a) / (2 * np.sqrt(np.abs(a) + EPS)),)),
    "log": (1, lambda a: np.log(np.abs(a) + EPS), lambda a: (np.sign(a) / (np.abs(a) + EPS),)),
    "exp": (1, lambda a: np.exp(np.clip(a, -EXP_LIMIT, EXP_LIMIT)), lambda a: (np.exp(np.clip(a, -EXP_LIMIT, EXP_LIMIT)) * (np.abs(a) < EXP_LIMIT),)),
    "sin": (1, np.sin, lambda a: (np.cos(a),)),
    "cos": (1, np.cos, lambda a: (-np.sin(a),)),
    "tanh": (1, np.tanh, lambda a: (1 - np.tanh(a) ** 2,)),
}
NAMES = sorted(OPS)

COLUMN_OPS: dict[str, Callable[..., Column]] = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a * b / (b * b + EPS), "id": lambda a: a, "neg": lambda a: -a, "square": lambda a: a * a,
    "inv": lambda a: a / (a * a + EPS), "sqrt": lambda a: F.sqrt(F.abs(a) + EPS), "log": lambda a: F.log(F.abs(a) + EPS), "exp": lambda a: F.exp(F.greatest(F.lit(-EXP_LIMIT), F.least(a, F.lit(EXP_LIMIT)))),
    "sin": F.sin, "cos": F.cos, "tanh": F.tanh,
}


@dataclass(frozen=True)
class Program:
    nodes: tuple[tuple[str, int, int], ...]  # operator, slots of its arguments
    constants: tuple[float, ...]

    def render(self, names: list[str]) -> str:
        slots = [*names, *(f"{c:.6g}" for c in self.constants)]
        for op, a, b in self.nodes:
            slots.append(f"{op}({slots[a]}{', ' + slots[b] if OPS[op][0] == 2 else ''})")
        return slots[-1]

    def column(self, names: list[str]) -> Column:
        slots = [*(F.col(n) for n in names), *(F.lit(c) for c in self.constants)]
        for op, a, b in self.nodes:
            v = COLUMN_OPS[op](slots[a], slots[b]) if OPS[op][0] == 2 else COLUMN_OPS[op](slots[a])
            slots.append(F.greatest(F.lit(-LIMIT), F.least(v, F.lit(LIMIT))))
        return slots[-1]


def run(p: Program, x: np.ndarray, gradient: bool = False):
    """x: rows by variables. The output, and its derivatives by each constant if asked for."""
    n, m = len(x), len(p.constants)
    slots = [x[:, i] for i in range(x.shape[1])] + [np.full(n, c) for c in p.constants]
    grads = [np.zeros((m, n)) for _ in range(x.shape[1])] + [np.eye(m)[:, [i]] * np.ones(n) for i in range(m)]
    with np.errstate(all="ignore"):
        for op, a, b in p.nodes:
            arity, f, d = OPS[op]
            args = (slots[a], slots[b])[:arity]
            raw = f(*args)
            slots.append(np.clip(np.nan_to_num(raw, nan=0.0, posinf=LIMIT, neginf=-LIMIT), -LIMIT, LIMIT))
            if gradient:
                inside = np.abs(raw) < LIMIT
                grads.append(np.nan_to_num(sum(w * g for w, g in zip(d(*args), (grads[a], grads[b])[:arity], strict=True)) * inside))
    return (slots[-1], grads[-1]) if gradient else slots[-1]


def fit_scale(p: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """a, b and r2 of y ~ a p + b."""
    total = float(((y - y.mean()) ** 2).sum()) or 1e-300
    c = p - p.mean()
    var = float((c * c).sum())
    a = float((c * (y - y.mean())).sum()) / var if var > 1e-300 else 0.0
    b = float(y.mean() - a * p.mean())
    return a, b, 1 - float(((a * p + b - y) ** 2).sum()) / total


def refine(p: Program, x: np.ndarray, y: np.ndarray, steps: int = 120, rate: float = 0.05) -> tuple[Program, float]:
    """Adam on the constants against the scaled error; the best seen."""
    c = np.array(p.constants, float)
    m, s = np.zeros_like(c), np.zeros_like(c)
    best, score = p, fit_scale(run(p, x), y)[2]
    for k in range(1, steps + 1 if len(c) else 1):
        out, g = run(Program(p.nodes, tuple(c)), x, True)
        a, b, r2 = fit_scale(out, y)
        if r2 > score:
            best, score = Program(p.nodes, tuple(c.tolist())), r2
        grad = 2 * a * (g * (a * out + b - y)).mean(1)
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        c = c - rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
    return best, score


def random_program(rng: np.random.Generator, variables: int, constants: int, nodes: int) -> Program:
    out = []
    for k in range(nodes):
        slots = variables + constants + k
        out.append((NAMES[rng.integers(len(NAMES))], int(rng.integers(slots)), int(rng.integers(slots))))
    return Program(tuple(out), tuple(rng.normal(0, 1, constants).tolist()))


@dataclass
class ProgramSearch:
    population: int = 60
    generations: int = 25
    nodes: int = 4
    constants: int = 2
    elite: float = 0.1
    tournament: int = 4
    steps: int = 40
    seed: int = 0


def evolve(x: np.ndarray, y: np.ndarray, config: ProgramSearch | None = None, spark: SparkSession | None = None) -> tuple[Program, float]:
    """Tournaments, crossover node by node, changed nodes; every child's constants are fitted. With a session children are rows."""
    c = config or ProgramSearch()
    rng = np.random.default_rng(c.seed)
    score = _scorer(x, y, c.steps, spark)
    pop = score([random_program(rng, x.shape[1], c.constants, c.nodes) for _ in range(c.population)])
    for _ in range(c.generations):
        pop.sort(key=lambda q: -q[1])
        if pop[0][1] > 1 - 1e-10:
            break
        keep = pop[: max(1, int(c.elite * c.population))]

        def pick() -> Program:
            return max((pop[i] for i in rng.integers(len(pop), size=c.tournament)), key=lambda q: q[1])[0]  # noqa: B023

        children = []
        while len(children) < c.population - len(keep):
            a, b = pick(), pick()
            nodes = [(n if rng.random() < 0.5 else o) for n, o in zip(a.nodes, b.nodes, strict=True)]
            for k in range(len(nodes)):
                if rng.random() < 0.25:
                    slots = x.shape[1] + c.constants + k
                    nodes[k] = (NAMES[rng.integers(len(NAMES))], int(rng.integers(slots)), int(rng.integers(slots)))
            children.append(Program(tuple(nodes), tuple((np.array(a.constants) + rng.normal(0, 0.2, c.constants)).tolist())))
        pop = keep + score(children)
    return max(pop, key=lambda q: q[1])


def _scorer(x: np.ndarray, y: np.ndarray, steps: int, spark: SparkSession | None):
    def here(programs: list[Program]) -> list[tuple[Program, float]]:
        return [refine(p, x, y, steps) for p in programs]

    if spark is None:
        return here
    import pickle

    import pandas as pd

    data = spark.sparkContext.broadcast((x, y))

    def run_rows(batches):
        for pdf in batches:
            yield pd.DataFrame({"i": pdf["i"], "p": [pickle.dumps(refine(pickle.loads(b), *data.value, steps)) for b in pdf["p"]]})

    def there(programs: list[Program]) -> list[tuple[Program, float]]:
        rows = spark.createDataFrame([(i, bytearray(pickle.dumps(p))) for i, p in enumerate(programs)], "i long, p binary")
        found = {r[0]: pickle.loads(r[1]) for r in rows.repartition(spark.sparkContext.defaultParallelism, "i").mapInPandas(run_rows, "i long, p binary").collect()}
        return [found[i] for i in range(len(programs))]

    return there


def policy_search(x: np.ndarray, y: np.ndarray, rounds: int = 25, batch: int = 80, elite: float = 0.2, smoothing: float = 0.5, nodes: int = 4, constants: int = 2, steps: int = 40, seed: int = 0) -> tuple[Program, float]:
    """Cross-entropy: a table of chances for each node's operator and arguments, drawn to what the elite chose."""
    rng = np.random.default_rng(seed)
    inputs = x.shape[1] + constants
    ops = [np.ones(len(NAMES)) / len(NAMES) for _ in range(nodes)]
    args = [[np.ones(inputs + k) / (inputs + k) for _ in range(2)] for k in range(nodes)]
    best: tuple[Program, float] | None = None
    for _ in range(rounds):
        drawn = []
        for _ in range(batch):
            picked = tuple((NAMES[rng.choice(len(NAMES), p=ops[k])], int(rng.choice(inputs + k, p=args[k][0])), int(rng.choice(inputs + k, p=args[k][1]))) for k in range(nodes))
            drawn.append(refine(Program(picked, tuple(rng.normal(0, 1, constants).tolist())), x, y, steps))
        drawn.sort(key=lambda q: -q[1])
        best = drawn[0] if best is None or drawn[0][1] > best[1] else best
        if best[1] > 1 - 1e-10:
            break
        top = drawn[: max(1, int(elite * batch))]
        for k in range(nodes):
            ops[k] = _drawn_to(ops[k], [NAMES.index(p.nodes[k][0]) for p, _ in top], smoothing)
            for s in (0, 1):
                args[k][s] = _drawn_to(args[k][s], [p.nodes[k][1 + s] for p, _ in top], smoothing)
    return best


def _drawn_to(chances: np.ndarray, chosen: list[int], smoothing: float) -> np.ndarray:
    new = smoothing * chances + (1 - smoothing) * np.bincount(chosen, minlength=len(chances)) / len(chosen)
    new = np.maximum(new, 1e-3)
    return new / new.sum()


# --- relaxed programs: choices as weights that a gradient moves


@dataclass(frozen=True)
class Relaxed:
    """How relaxed programs are trained. hard: nodes run the likeliest choice and only slopes see the weights (straight through);
    else they run the weighted mean of all choices, and the program is read off at the end."""

    nodes: int = 3
    constants: int = 1
    steps: int = 600
    rate: float = 0.05
    hard: bool = True
    hot: float = 2.0
    cold: float = 0.1
    entropy: float = 0.02  # weight of the choices' entropy, from two fifths of the steps on
    refine_steps: int = 120


def _softmax(z: np.ndarray, heat: float) -> np.ndarray:
    e = np.exp((z - z.max()) / heat)
    return e / e.sum()


def _relaxed_pass(choices: list[list[np.ndarray]], constants: np.ndarray, x: np.ndarray, y: np.ndarray, heat: float, hard: bool, penalty: float) -> tuple[float, list[list[np.ndarray]], np.ndarray]:
    """The scaled error (in units of y's variance) with the entropy penalty, and its slopes by all logits and constants, by one pass back.

    choices: for each node the logits of its operator and of its two arguments' slots.
    """
    rows = len(y)
    slots = [*x.T, *(np.full(rows, c) for c in constants)]
    weights = [[_softmax(z, heat) for z in node] for node in choices]
    used = [[(np.arange(len(w)) == w.argmax()) * 1.0 if hard else w for w in node] for node in weights]
    kept = []
    with np.errstate(all="ignore"):
        for ops, first, second in used:
            stack = np.stack(slots)
            a, b = first @ stack, second @ stack
            args = [(a, b)[: OPS[name][0]] for name in NAMES]
            raw = np.stack([OPS[name][1](*v) for name, v in zip(NAMES, args, strict=True)])
            inside = np.isfinite(raw) & (np.abs(raw) < LIMIT)
            values = np.clip(np.nan_to_num(raw, nan=0.0, posinf=LIMIT, neginf=-LIMIT), -LIMIT, LIMIT)
            kept.append((stack, args, values, inside))
            slots.append(ops @ values)
        scale, shift, r2 = fit_scale(slots[-1], y)
        spread = float(y.var()) or 1e-300
        loss = 1 - r2
        back = [np.zeros(rows) for _ in slots]
        back[-1] = 2 * scale * (scale * slots[-1] + shift - y) / rows / spread
        slopes: list[list[np.ndarray]] = []
        for k in range(len(choices) - 1, -1, -1):
            stack, args, values, inside = kept[k]
            ops, first, second = used[k]
            g = back[len(stack)]
            by_op, ga, gb = values @ g, np.zeros(rows), np.zeros(rows)
            for o in np.flatnonzero(ops):
                d = OPS[NAMES[o]][2](*args[o])
                ga += np.nan_to_num(ops[o] * d[0] * inside[o]) * g
                if len(d) == 2:
                    gb += np.nan_to_num(ops[o] * d[1] * inside[o]) * g
            for j in range(len(stack)):
                back[j] = back[j] + first[j] * ga + second[j] * gb
            moved = []
            for w, grad in zip(weights[k], (by_op, stack @ ga, stack @ gb), strict=True):
                if penalty:
                    logs = np.log(np.maximum(w, 1e-12))
                    loss -= penalty * float(w @ logs)
                    grad = grad - penalty * (logs + 1)
                moved.append(w * (grad - w @ grad) / heat)
            slopes.insert(0, moved)
    inputs = x.shape[1]
    return loss, slopes, np.array([back[inputs + i].sum() for i in range(len(constants))])


def _read_off(choices: list[list[np.ndarray]], constants: np.ndarray) -> Program:
    return Program(tuple((NAMES[int(o.argmax())], int(a.argmax()), int(b.argmax())) for o, a, b in choices), tuple(float(c) for c in constants))


def train_relaxed(x: np.ndarray, y: np.ndarray, how: Relaxed, seed: int) -> tuple[Program, float]:
    """One restart: logits and constants from a seed, Adam with heat falling along a cosine; the best program read off on the way, its constants fitted."""
    rng, inputs = np.random.default_rng(seed), x.shape[1] + how.constants
    choices = [[0.5 * rng.standard_normal(n) for n in (len(NAMES), inputs + k, inputs + k)] for k in range(how.nodes)]
    constants = rng.standard_normal(how.constants)
    parts = [z for node in choices for z in node] + [constants]
    first, second = [np.zeros_like(z) for z in parts], [np.zeros_like(z) for z in parts]
    best, score, seen = None, -np.inf, set()
    for step in range(1, how.steps + 1):
        at = step / how.steps
        heat = how.cold + (how.hot - how.cold) * 0.5 * (1 + np.cos(np.pi * at))
        _, slopes, by_constant = _relaxed_pass(choices, constants, x, y, heat, how.hard, how.entropy if at > 0.4 else 0.0)
        for z, g, m, v in zip(parts, [*(s for node in slopes for s in node), by_constant], first, second, strict=True):
            g = np.nan_to_num(np.clip(g, -1e3, 1e3))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            z -= how.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if step % 25 == 0 or step == how.steps:
            p = _read_off(choices, constants)
            if p.nodes in seen:
                continue
            seen.add(p.nodes)
            p, r2 = refine(p, x, y, how.refine_steps)
            if best is None or r2 > score:
                best, score = p, r2
            if score > 1 - 1e-10:
                break
    return best, score


def relaxed_search(x: np.ndarray, y: np.ndarray, restarts: int = 16, how: Relaxed | None = None, seed: int = 0, spark: SparkSession | None = None) -> tuple[Program, float, float]:
    """The best hard program of all restarts, its r2, and the share of restarts over 0.999. With a session restarts are rows.

    Relaxed(hard=True) trains wiring straight through, Relaxed(hard=False) soft operators and wiring.
    """
    how = how or Relaxed()
    seeds = [seed + 7919 * r for r in range(restarts)]
    if spark is None:
        found = [train_relaxed(x, y, how, s) for s in seeds]
    else:
        import pickle

        import pandas as pd

        data = spark.sparkContext.broadcast((x, y))

        def run_rows(batches):
            for pdf in batches:
                yield pd.DataFrame({"seed": pdf["seed"], "p": [pickle.dumps(train_relaxed(*data.value, how, int(s))) for s in pdf["seed"]]})

        rows = spark.createDataFrame([(s,) for s in seeds], "seed long").repartition(restarts, "seed")
        made = {r[0]: pickle.loads(r[1]) for r in rows.mapInPandas(run_rows, "seed long, p binary").collect()}
        found = [made[s] for s in seeds]
    best = max(found, key=lambda q: q[1])
    return *best, sum(r2 > 0.999 for _, r2 in found) / restarts


# --- enumeration on the smooth table


def enumerate_programs(variables: int, depth: int = 2) -> list[Program]:
    """Programs without constants: each variable, one operator on variables, and with depth 2 an operator of one argument on those."""
    plain = [Program((("id", i, i),), ()) for i in range(variables)]
    ones = [n for n in NAMES if OPS[n][0] == 1 and n != "id"]
    flat = [Program(((n, i, i),), ()) for n in ones for i in range(variables)]
    flat += [Program(((n, i, j),), ()) for n in NAMES if OPS[n][0] == 2 for i in range(variables) for j in range(variables) if i < j or n in ("sub", "div") and i != j]
    deep = [Program((*p.nodes, (n, variables, variables)), ()) for n in ones for p in flat] if depth > 1 else []
    return [*plain, *flat, *deep]


def combine_programs(x: np.ndarray, y: np.ndarray, depth: int = 2, most: int = 5, least_gain: float = 1e-9, beam: int = 12) -> tuple[list[tuple[float, Program]], float, float]:
    """Matching pursuit over the enumerated programs with a beam: (weight, program) terms, the intercept, and r2.

    Each round extends every kept set by the programs that go best with what it leaves; the sets of least error stay, ties to
    the earlier programs. More terms must gain `least_gain`.
    """
    programs, columns = [], []
    for p in enumerate_programs(x.shape[1], depth):
        v = run(p, x)
        if np.isfinite(v).all() and 1e-12 < v.std() < LIMIT:
            programs.append(p)
            columns.append((v - v.mean()) / v.std())
    centred = y - y.mean()
    total = float(centred @ centred)
    if not columns or not total:
        return [], float(y.mean()), 0.0
    phi = np.stack(columns)
    kept: list[tuple[float, tuple[int, ...], np.ndarray]] = [(total, (), centred)]
    best = kept[0]
    for _ in range(most):
        found: dict[tuple[int, ...], tuple[float, tuple[int, ...], np.ndarray]] = {}
        for _, chosen, rest in kept:
            score = np.abs(phi @ rest)
            score[list(chosen)] = -1
            for i in np.argsort(-score, kind="stable")[:beam]:
                new = tuple(sorted((*chosen, int(i))))
                if new not in found:
                    design = phi[list(new)].T
                    left = centred - design @ np.linalg.lstsq(design, centred, rcond=None)[0]
                    found[new] = (float(left @ left), new, left)
        kept = sorted(found.values(), key=lambda k: (k[0], k[1]))[:beam]
        if not kept or best[0] - kept[0][0] < least_gain * total:
            break
        best = kept[0]
        if best[0] < 1e-12 * total:
            break
    design = np.stack([*(run(programs[i], x) for i in best[1]), np.ones(len(y))], 1)
    weights = np.linalg.lstsq(design, y, rcond=None)[0]
    return [(float(w), programs[i]) for w, i in zip(weights, best[1], strict=False)], float(weights[-1]), 1 - best[0] / total


def targets(n: int = 400, seed: int = 0) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    x = rng.uniform(0.5, 3, (n, 2))
    return {"x^2": (x[:, :1], x[:, 0] ** 2), "sin 2x": (x[:, :1], np.sin(2 * x[:, 0])), "x0 x1": (x, x[:, 0] * x[:, 1]), "x0 / x1": (x, x[:, 0] / x[:, 1])}


