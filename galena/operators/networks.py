"""Two-layer symbolic networks on images: trees on channels, means over regions, trees on those, a class each."""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galena.operators import tree as T
from galena.operators.search import Grammar, mutate
from galena.operators.tree import Node

CHANNELS = ("image", "gx", "gy", "lap")


def channels_of(images: np.ndarray) -> dict[str, np.ndarray]:
    """The image, its central differences and its five-point Laplacian; borders zero. images: [n, h, w]."""
    out = {"image": np.asarray(images, float)}
    out |= {k: np.zeros_like(out["image"]) for k in CHANNELS[1:]}
    u = out["image"]
    out["gx"][:, :, 1:-1] = u[:, :, 2:] - u[:, :, :-2]
    out["gy"][:, 1:-1] = u[:, 2:] - u[:, :-2]
    out["lap"][:, 1:-1, 1:-1] = u[:, 2:, 1:-1] + u[:, :-2, 1:-1] + u[:, 1:-1, 2:] + u[:, 1:-1, :-2] - 4 * u[:, 1:-1, 1:-1]
    return out


def channel_rows(pixels: DataFrame) -> DataFrame:
    """The same over long rows (img, r, c, image), by two windows."""
    across, down = Window.partitionBy("img", "r").orderBy("c"), Window.partitionBy("img", "c").orderBy("r")
    v = F.col("image")
    left, right, up, below = F.lag(v).over(across), F.lead(v).over(across), F.lag(v).over(down), F.lead(v).over(down)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return pixels.withColumns({"gx": zero(right - left), "gy": zero(below - up), "lap": zero(left + right + up + below - 4 * v)})


def pool_rows(rows: DataFrame, value: str, side: int, height: int, width: int) -> DataFrame:
    """(img, region, value): the mean of finite values in each of side x side regions; what is left over at the edges is cropped."""
    h, w = height // side, width // side
    inside = rows.where((F.col("r") < h * side) & (F.col("c") < w * side))
    v = F.col(value)
    return inside.groupBy("img", (F.floor(F.col("r") / h) * side + F.floor(F.col("c") / w)).cast("int").alias("region")).agg(F.avg(F.when((v - v) == 0, v)).alias(value))


def predict_images(pixels: DataFrame, tree: Node, pool: str = "mean") -> DataFrame:
    """(img, prediction) by a tree on each image's pixels (img, r, c, channels), pooled by mean, max or sum of finite values; with "none" a row a pixel."""
    from galena.operators.lowering import evaluate

    made = evaluate(pixels, {"prediction": tree}, keep=["img", "r", "c"])
    if pool == "none":
        return made
    v = F.col("prediction")
    return made.groupBy("img").agg({"mean": F.avg, "max": F.max, "sum": F.sum}[pool](F.when((v - v) == 0, v)).alias("prediction"))


@dataclass
class Network:
    features: list[Node]  # on channels
    heads: list[Node]  # one a class, on f0_0 ... (feature, region)
    side: int = 2

    def complexity(self) -> int:
        return sum(map(T.complexity, [*self.features, *self.heads]))

    def pooled(self, images: np.ndarray) -> dict[str, np.ndarray]:
        env, out = channels_of(images), {}
        n, height, width = images.shape
        h, w = height // self.side, width // self.side
        for k, tree in enumerate(self.features):
            v = np.broadcast_to(np.asarray(T.evaluate(tree, env), float), images.shape)[:, : h * self.side, : w * self.side]
            v = np.where(np.isfinite(v), v, np.nan).reshape(n, self.side, h, self.side, w)
            good = np.isfinite(v)
            mean = np.where(good, v, 0).sum((2, 4)) / np.maximum(good.sum((2, 4)), 1)
            out |= {f"f{k}_{r}": mean.reshape(n, -1)[:, r] for r in range(self.side**2)}
        return out

    def logits(self, images: np.ndarray) -> np.ndarray:
        env = self.pooled(images)
        cols = [np.nan_to_num(np.broadcast_to(np.asarray(T.evaluate(h, env), float), (len(images),)), nan=0.0, posinf=1e6, neginf=-1e6) for h in self.heads]
        return np.clip(np.stack(cols, 1), -1e6, 1e6)

    def loss(self, images: np.ndarray, labels: np.ndarray, parsimony: float = 0.001, divisor: float = 10.0) -> float:
        z = self.logits(images)
        z = z - z.max(1, keepdims=True)
        return float(-(z[np.arange(len(z)), labels] - np.log(np.exp(z).sum(1))).mean()) + parsimony * self.complexity() / divisor

    def accuracy(self, images: np.ndarray, labels: np.ndarray) -> float:
        return float((self.logits(images).argmax(1) == labels).mean())

    def predict(self, images: DataFrame) -> DataFrame:
        """(img, class) of rows (img, pixels array<array<double>>), a batch at a time."""

        def run(batches):
            for pdf in batches:
                x = np.array([np.array(p.tolist() if hasattr(p, "tolist") else p, dtype=object).tolist() for p in pdf["pixels"]])
                x = np.array([[list(r) for r in im] for im in x], float)
                yield pd.DataFrame({"img": pdf["img"], "class": self.logits(x).argmax(1)})

        return images.select("img", "pixels").mapInPandas(run, "img long, class int")


def head_names(features: int, side: int) -> list[str]:
    return [f"f{k}_{r}" for k in range(features) for r in range(side**2)]


def random_network(rng: random.Random, classes: int, features: int = 4, side: int = 2) -> Network:
    first, second = Grammar(list(CHANNELS), measures_1d=False), Grammar(head_names(features, side), measures_1d=False)
    return Network([first.tree(rng, 3) for _ in range(features)], [second.tree(rng, 3) for _ in range(classes)], side)


def mutate_network(net: Network, rng: random.Random) -> Network:
    features, heads = list(net.features), list(net.heads)
    if rng.random() < 0.5:
        k = rng.randrange(len(features))
        features[k] = mutate(features[k], Grammar(list(CHANNELS), measures_1d=False), rng)
    else:
        k = rng.randrange(len(heads))
        heads[k] = mutate(heads[k], Grammar(head_names(len(features), net.side), measures_1d=False), rng)
    return Network(features, heads, net.side)


def cross_networks(a: Network, b: Network, rng: random.Random) -> Network:
    return Network([rng.choice(p) for p in zip(a.features, b.features, strict=True)], [rng.choice(p) for p in zip(a.heads, b.heads, strict=True)], a.side)


def warm_start(binaries: list[Network]) -> Network:
    """One network of many classes from networks that tell one class from the rest: features side by side, each head on its own."""
    features, heads, at = [], [], 0
    for net in binaries:
        features += net.features
        names = {f"f{k}_{r}": f"f{k + at}_{r}" for k in range(len(net.features)) for r in range(net.side**2)}

        def put(n: Node, names: dict[str, str] = names) -> Node:
            return T.Var(names[n.name]) if isinstance(n, T.Var) else T.with_children(n, tuple(put(c, names) for c in T.children(n)))

        heads.append(put(net.heads[-1]))
        at += len(net.features)
    return Network(features, heads, binaries[0].side)


def evolve_network(images: np.ndarray, labels: np.ndarray, classes: int, population: int = 30, generations: int = 15, features: int = 4, side: int = 2, seed: int = 0, spark: SparkSession | None = None) -> tuple[Network, float]:
    """(mu + lambda) over whole networks; with a session a generation's losses are rows, images go to every task (callers bound them)."""
    rng = random.Random(seed)

    def losses(nets: list[Network]) -> list[float]:
        if spark is None:
            return [n.loss(images, labels) for n in nets]
        import pickle

        def run(batches):
            for pdf in batches:
                yield pd.DataFrame({"i": pdf["i"], "loss": [pickle.loads(b).loss(*data.value) for b in pdf["net"]]})

        rows = spark.createDataFrame([(i, bytearray(pickle.dumps(n))) for i, n in enumerate(nets)], "i long, net binary")
        found = dict(rows.repartition(spark.sparkContext.defaultParallelism, "i").mapInPandas(run, "i long, loss double").collect())
        return [found[i] for i in range(len(nets))]

    data = spark.sparkContext.broadcast((images, labels)) if spark else None
    nets = [random_network(rng, classes, features, side) for _ in range(population)]
    pool = list(zip(nets, losses(nets), strict=True))
    for _ in range(generations):
        pick = lambda: min(rng.sample(pool, min(3, len(pool))), key=lambda p: p[1])[0]  # noqa: B023, E731
        new = [mutate_network(cross_networks(pick(), pick(), rng) if rng.random() < 0.3 else pick(), rng) for _ in range(population)]
        pool = sorted([*pool, *zip(new, losses(new), strict=True)], key=lambda p: p[1])[:population]
    return pool[0]
