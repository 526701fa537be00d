"""Tree ensembles on binned features: rows become sums of cells, and the trees are grown from those.

A cell is one bin of each feature. A split only needs the number of rows and the
sum of labels of the cells on both sides, so one pass over all rows gives all
that a forest or a sequence of boosted trees needs: no job for each level or
round. Draws of rows (bootstrap, subsample) are made for each row and tree, by a
hash of the row's key, before they are summed; no row is left out beyond them.

As Spark ML's learners: up to 32 bins a feature, Poisson bootstrap, a random
subset of features for each node of a forest, squared error (of labels 0 and 1
that is half the Gini impurity, with the same splits), boosting in which the
first tree has the weight 1 and the others, on twice the residuals, the rate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import ship

BINS = 32
#: Trees whose sums one task adds up.
BLOCK = 8
#: Cells that the driver boosts on at most; there are BINS ** features of them at most.
CELLS = 2_000_000


def _rows(df: DataFrame, key: str | None, seed: int, features: str, label: str) -> DataFrame:
    """(x, y, h): features, label, and what the row is drawn by: its key, features and label."""
    draw = F.xxhash64(F.lit(seed), *([key] if key else []), vector_to_array(features), F.col(label).cast("double"))
    return df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), draw.alias("h"))


def thresholds(rows: DataFrame, bins: int = BINS) -> tuple[list[list[float]], bool]:
    """Ascending thresholds of each feature, a value at one stands below it: between all values if these are `bins` at most, else quantiles; and whether all labels are 0 or 1."""
    edges, two = prefix_thresholds(rows.select("x", "y", F.lit(0).alias("first")), 1, bins)
    return edges[0], two


def prefix_thresholds(rows: DataFrame, count: int, bins: int = BINS) -> tuple[list[list[list[float]]], bool]:
    """`thresholds` of each of `count` prefixes, from (x, y, first): prefix p has the rows with a `first` of 0 to p."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Up to bins + 1 values of each feature: with more in any partition, quantiles are taken.
        held, other = {}, False
        for b in batches:
            if b.num_rows:
                every = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                first = b.column(2).to_numpy(zero_copy_only=False)
                for f in np.unique(first).tolist():
                    wide = every[first == f]
                    for i in range(wide.shape[1]):
                        if len(held.get((f, i), ())) <= bins:
                            held[f, i] = np.union1d(held.get((f, i), np.zeros(0)), wide[:, i])[: bins + 1]
                other |= bool((~np.isin(b.column(1).to_numpy(zero_copy_only=False), (0, 1))).any())
        for (f, i), v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([i], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64())), pa.array([other])], ["f", "i", "v", "other"])

    rows = rows.where("first >= 0")
    found = rows.mapInArrow(values, "f int, i int, v array<double>, other boolean").collect()
    if not any(r.f == 0 for r in found):
        raise ValueError("no rows to fit on")
    out, many = [], []
    for p in range(count):
        out.append([])
        for i in range(1 + max(r.i for r in found)):
            own = sorted({v for r in found if r.i == i and r.f <= p for v in r.v})
            if len(own) > bins:
                many.append((p, i))
            out[p].append([(a + b) / 2 for a, b in zip(own, own[1:], strict=False)])
    if many:
        shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
        # A row for each prefix and feature, not a column: the code of many aggregates would be too long to be compiled.
        each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(i).alias("i")) for p, i in many]))
        own = rows.select("first", "x", each.alias("of")).where("first <= of.p").select("of", F.get("x", F.col("of.i")).alias("v"))
        for r in own.groupBy("of").agg(F.percentile_approx("v", shares, F.lit(10_000)).alias("q"), F.max("v").alias("top")).collect():
            out[r.of.p][r.of.i] = sorted({v for v in r.q if v < r.top})
    return out, not any(r.other for r in found)


def _codes(flat: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """The cell of each row of a matrix of features."""
    code = np.zeros(len(flat), np.int64)
    for i, e in enumerate(edges):
        code = code * (len(e) + 1) + np.searchsorted(np.array(e), flat[:, i], "left")
    return code


def _bins_of(code: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bins by feature and cell."""
    out = np.zeros((len(edges), len(code)), np.int64)
    for i in range(len(edges) - 1, -1, -1):
        code, out[i] = np.divmod(code, len(edges[i]) + 1)
    return out


def _matrix(lists: pa.Array, n: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _uniform(h: np.ndarray, trees: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) by row and tree."""
    x = h[:, None] + (trees.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x ^ (x >> np.uint64(31))) / np.float64(2**64)


#: Shares of up to k draws of a row in a bootstrap: Poisson with mean 1.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])

_BLOCKS = "block int, cells binary, n binary, s binary"


def _sums(rows: DataFrame, edges: list[list[float]], trees: int, share: float | None) -> DataFrame:
    """For each partition and block of trees: cells, drawn rows and the sum of their labels by tree and cell. share: of a subsample; None: bootstrap; at 1 all rows, for one tree."""
    k = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(_codes(_matrix(b.column(0), k), edges), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not parts:
            return
        code, y, h = (np.concatenate(v) for v in zip(*parts, strict=True))
        cells, at = np.unique(code, return_inverse=True)
        m = len(cells)
        for block in range(-(-trees // BLOCK)):
            own = np.arange(block * BLOCK, min(trees, (block + 1) * BLOCK))
            n, s = np.zeros((len(own), m)), np.zeros((len(own), m))
            for a in range(0, len(code), 1 << 16):
                to = slice(a, a + (1 << 16))
                u = None if share == 1 else _uniform(h[to].view(np.uint64), own)
                for t in range(len(own)):
                    w = np.ones(len(at[to])) if u is None else np.searchsorted(_POISSON, u[:, t], "right").astype(float) if share is None else (u[:, t] < share).astype(float)
                    n[t] += np.bincount(at[to], w, m)
                    s[t] += np.bincount(at[to], w * y[to], m)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (cells, n, s))], ["block", "cells", "n", "s"])

    return rows.mapInArrow(run, _BLOCKS)


def _added(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells, and the sums of a block's partitions by tree and cell."""
    every = [(np.frombuffer(c, np.int64), n, s) for b in batches for c, n, s in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
    cells = np.unique(np.concatenate([c for c, _, _ in every]))
    trees = len(every[0][1]) // 8 // max(1, len(every[0][0]))
    n, s = np.zeros((trees, len(cells))), np.zeros((trees, len(cells)))
    for own, rows, sums in every:
        at = np.searchsorted(cells, own)
        n[:, at] += np.frombuffer(rows).reshape(trees, -1)
        s[:, at] += np.frombuffer(sums).reshape(trees, -1)
    return cells, n, s


def _merged(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    """Cells, their rows, sums of labels and squared deviations from the cell's mean, of several such parts."""
    cells = np.unique(np.concatenate([p[0] for p in parts]))
    n, s, d = (np.zeros(len(cells)) for _ in range(3))
    places = [np.searchsorted(cells, p[0]) for p in parts]
    for at, (_, rows, sums, _) in zip(places, parts, strict=True):
        n[at] += rows
        s[at] += sums
    for at, (_, rows, sums, apart) in zip(places, parts, strict=True):
        d[at] += apart + rows * (sums / rows - s[at] / n[at]) ** 2
    return cells, n, s, d


_PREFIXES = "prefix int, test boolean, cells binary, n binary, s binary, d binary"


def _prefix_sums(rows: DataFrame, edges: list[list[list[float]]]) -> DataFrame:
    """For each partition and prefix, of its rows and of the test rows (a `first` below 0): what `_merged` has, in its prefix's cells."""
    k = len(edges[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, waiting = {}, [], 0

        def add() -> None:
            x, y, first = (np.concatenate(v) for v in zip(*parts, strict=True))
            for test in (False, True):
                for p in range(len(edges)):
                    own = first < 0 if test else (first >= 0) & (first <= p)
                    if own.any():
                        cells, at = np.unique(_codes(x[own], edges[p]), return_inverse=True)
                        n, s = np.bincount(at), np.bincount(at, y[own])
                        new = cells, n, s, np.bincount(at, (y[own] - (s / n)[at]) ** 2)
                        held[p, test] = _merged([held[p, test], new]) if (p, test) in held else new
            parts.clear()

        def given() -> Iterator[pa.RecordBatch]:
            for (p, test), v in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([test]), pa.array([v[0].tobytes()], pa.binary()), *(pa.array([a.astype(float).tobytes()], pa.binary()) for a in v[1:])], ["prefix", "test", "cells", "n", "s", "d"])
            held.clear()

        for b in batches:
            if b.num_rows:
                parts.append((_matrix(b.column(0), k), *(b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))))
                waiting += b.num_rows
            if waiting >= 1 << 17:
                add()
                waiting = 0
                if sum(len(v[0]) for v in held.values()) > CELLS:
                    yield from given()
        if parts:
            add()
        yield from given()

    return rows.mapInArrow(run, _PREFIXES)


@dataclass
class Tree:
    """Nodes by number: the feature (-1: a leaf), the last bin to the left, the left child (the right one is next) and the mean."""

    feature: np.ndarray
    bin: np.ndarray
    child: np.ndarray
    mean: np.ndarray

    def apply(self, bins: np.ndarray) -> np.ndarray:
        node, cells = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        while True:
            f = self.feature[node]
            if (f < 0).all():
                return self.mean[node]
            right = bins[np.maximum(f, 0), cells] > self.bin[node]
            node = np.where(f < 0, node, self.child[node] + right)


def grow(bins: np.ndarray, width: list[int], n: np.ndarray, s: np.ndarray, depth: int, least: int = 1, subset: int | None = None, rng: np.random.Generator | None = None) -> Tree:
    """A tree on cells with n rows and sums s of labels. subset: features that each node may split on."""
    node = np.zeros(len(n), np.int64)  # within the level
    alive = n > 0
    feature, edge, child, mean = [], [], [], []
    nodes, total, level = 1, 0, 0
    while nodes:
        of, own = node[alive], np.flatnonzero(alive)
        rows, sums = np.bincount(of, n[own], nodes), np.bincount(of, s[own], nodes)
        value = sums / np.maximum(rows, 1e-300)
        best, which, where = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64)
        if level < depth:
            k = len(width)
            order = None if subset is None or subset >= k else np.argsort(rng.random((nodes, k)), axis=1)
            for i in range(k):
                if width[i] < 2:
                    continue
                code = of * width[i] + bins[i, own]
                left_n = np.cumsum(np.bincount(code, n[own], nodes * width[i]).reshape(nodes, -1), axis=1)[:, :-1]
                left_s = np.cumsum(np.bincount(code, s[own], nodes * width[i]).reshape(nodes, -1), axis=1)[:, :-1]
                right_n, right_s = rows[:, None] - left_n, sums[:, None] - left_s
                ok = (left_n >= max(least, 1)) & (right_n >= max(least, 1))
                if order is not None:
                    ok &= (order[:, :subset] == i).any(axis=1)[:, None]
                # Sum of squares gained, by the deviation of both sides' means.
                apart = left_s / np.maximum(left_n, 1) - right_s / np.maximum(right_n, 1)
                gain = np.where(ok, left_n * right_n / rows[:, None] * apart * apart, 0.0)
                at = gain.argmax(axis=1)
                top = gain[np.arange(nodes), at]
                better = top > np.maximum(best, 1e-12 * rows)
                best[better], which[better], where[better] = top[better], i, at[better]
        split = which >= 0
        first = np.cumsum(split) - split
        feature.append(which)
        edge.append(where)
        mean.append(value)
        child.append(np.where(split, total + nodes + 2 * first, 0))
        go = split[of]
        alive = np.zeros(len(n), bool)
        alive[own[go]] = True
        of, own = of[go], own[go]
        node[own] = 2 * first[of] + (bins[which[of], own] > where[of])
        total, nodes, level = total + nodes, 2 * int(split.sum()), level + 1
    return Tree(*(np.concatenate(v) for v in (feature, edge, child, mean)))


@dataclass
class Fitted:
    """Trees with weights, as a model with `transform`: prediction, and for two classes the probabilities as well."""

    edges: list[list[float]]
    trees: list[Tree]
    weights: list[float]
    classes: bool = False
    features: str = "features"

    def of_cells(self, code: np.ndarray) -> np.ndarray:
        bins, out = _bins_of(code, self.edges), np.zeros(len(code))
        for t, w in zip(self.trees, self.weights, strict=True):
            out += w * t.apply(bins)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        ship(spark)
        model = spark.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def score(lists: pa.Array) -> pa.Array:
            own = model.value
            cells, at = np.unique(_codes(_matrix(lists, len(own.edges)), own.edges), return_inverse=True)
            return pa.array(own.of_cells(cells)[at])

        if not self.classes:
            return df.withColumn("prediction", score(vector_to_array(self.features)))
        p = df.withColumn("__p", score(vector_to_array(self.features)))
        p = p.withColumn("probability", array_to_vector(F.array(1 - F.col("__p"), F.col("__p"))))
        return p.withColumn("prediction", (F.col("__p") > 0.5).cast("double")).drop("__p")


@dataclass
class Forest:
    """A random forest. classes: labels are 0 and 1 (others are an error), and trees vote by their leaves' shares. key: the rows' id, by which they are drawn."""

    trees: int
    depth: int
    least: int = 1
    classes: bool = False
    label: str = "label"
    features: str = "features"
    key: str | None = None
    seed: int = 42

    def fit(self, df: DataFrame) -> Fitted:
        ship(df.sparkSession)
        own_rows = _rows(df, self.key, self.seed, self.features, self.label).persist()
        edges, two = thresholds(own_rows)
        if self.classes and not two:
            raise ValueError("labels must be 0 and 1")
        k, width, own = len(edges), [len(e) + 1 for e in edges], self
        subset = math.ceil(math.sqrt(k)) if self.classes else math.ceil(k / 3)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            block = held[0].column(0)[0].as_py()
            cells, n, s = _added(held)
            bins = _bins_of(cells, edges)
            for t in range(len(n)):
                rng = np.random.default_rng([own.seed, block * BLOCK + t])
                tree = grow(bins, width, n[t], s[t], own.depth, own.least, subset, rng)
                yield pa.RecordBatch.from_arrays([pa.array([block * BLOCK + t], pa.int32()), *(pa.array([v.tolist()]) for v in (tree.feature, tree.bin, tree.child, tree.mean))], ["tree", "feature", "bin", "child", "mean"])

        sums = _sums(own_rows, edges, self.trees, None)
        rows = sums.groupBy("block").applyInArrow(run, "tree int, feature array<long>, bin array<long>, child array<long>, mean array<double>").collect()
        own_rows.unpersist()
        grown = [Tree(*(np.array(v) for v in r[1:])) for r in sorted(rows, key=lambda r: r.tree)]
        return Fitted(edges, grown, [1 / len(grown)] * len(grown), self.classes, self.features)


@dataclass
class Boosting:
    """Boosted trees on the squared error. share: rows drawn for each round."""

    rounds: int = 300
    rate: float = 0.05
    depth: int = 4
    share: float = 1.0
    least: int = 1
    label: str = "label"
    features: str = "features"
    key: str | None = None
    seed: int = 42

    def fit(self, df: DataFrame) -> Fitted:
        ship(df.sparkSession)
        own_rows = _rows(df, self.key, self.seed, self.features, self.label).persist()
        edges, _ = thresholds(own_rows)
        width, drawn = [len(e) + 1 for e in edges], 1 if self.share >= 1 else self.rounds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            cells, n, s = _added(held)
            if len(cells) > CELLS:
                raise ValueError(f"more than {CELLS} cells")
            yield pa.RecordBatch.from_arrays([held[0].column(0).slice(0, 1), *(pa.array([v.tobytes()], pa.binary()) for v in (cells, n, s))], ["block", "cells", "n", "s"])

        # By tree and cell two numbers come to the driver.
        sums = _sums(own_rows, edges, drawn, min(self.share, 1))
        blocks = sorted(sums.groupBy("block").applyInArrow(run, _BLOCKS).collect(), key=lambda r: r.block)
        own_rows.unpersist()
        cells = np.frombuffer(blocks[0].cells, np.int64)  # the same in all blocks
        n, s = (np.concatenate([np.frombuffer(r[c]).reshape(-1, len(cells)) for r in blocks]) for c in ("n", "s"))
        trees, weights, _ = self._boosted(_bins_of(cells, edges), width, n, s)
        return Fitted(edges, trees, weights, False, self.features)

    def _boosted(self, bins: np.ndarray, width: list[int], n: np.ndarray, s: np.ndarray) -> tuple[list[Tree], list[float], np.ndarray]:
        """Trees, their weights, and the prediction of each cell, of rows n and sums s of labels by drawn tree and cell."""
        at, trees, weights = np.zeros(bins.shape[1]), [], []
        for i in range(self.rounds):
            rows, labels = n[i % len(n)], s[i % len(n)]
            tree = grow(bins, width, rows, labels if i == 0 else 2 * (labels - rows * at), self.depth, self.least)
            trees.append(tree)
            weights.append(1.0 if i == 0 else self.rate)
            at = at + weights[-1] * tree.apply(bins)
        return trees, weights, at

    def curve(self, train: DataFrame, test: DataFrame, count: int) -> list[tuple[float | None, float | None]]:
        """The RMSE on train and test of the trees fitted on each of `count` prefixes; train has `first`, the first prefix with the row (`prefix_thresholds`).

        One pass over all rows sums the cells of all prefixes, those of test too; each
        prefix is then fitted and scored from its cells, in a task of its own.
        """
        if self.share < 1:
            raise ValueError("a curve is fitted on all rows of a prefix")
        ship(train.sparkSession)

        def rows(df: DataFrame, first: str) -> DataFrame:
            return df.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("double").alias("y"), F.expr(first).cast("int").alias("first"))

        every = rows(train, "first").unionByName(rows(test, "-1").where("y is not null")).persist()
        edges, _ = prefix_thresholds(every, count)
        own = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {}
            for b in batches:
                for p, on, cells, *sums in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    new = np.frombuffer(cells, np.int64), *(np.frombuffer(v) for v in sums)
                    held[p, on] = _merged([held[p, on], new]) if (p, on) in held else new
                    if not on and len(held[p, on][0]) > CELLS:
                        raise ValueError(f"more than {CELLS} cells")
            for p in sorted({p for p, on in held if not on}):
                fit, rest = held[p, False], held.get((p, True))
                cells = fit[0] if rest is None else np.union1d(fit[0], rest[0])
                n, s, place = np.zeros((1, len(cells))), np.zeros((1, len(cells))), np.searchsorted(cells, fit[0])
                n[0, place], s[0, place] = fit[1], fit[2]
                _, _, at = own._boosted(_bins_of(cells, edges[p]), [len(e) + 1 for e in edges[p]], n, s)
                out = []
                for part in (fit, rest):
                    if part is not None:
                        codes, rows, sums, apart = part
                        out.append(math.sqrt((apart + rows * (sums / rows - at[np.searchsorted(cells, codes)]) ** 2).sum() / rows.sum()))
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([v], pa.float64()) for v in (out + [None])[:2])], ["prefix", "train", "test"])

        found = _prefix_sums(every, edges).repartitionById(count, "prefix").mapInArrow(run, "prefix int, train double, test double").collect()
        every.unpersist()
        by = {r.prefix: (r.train, r.test) for r in found}
        return [by[p] for p in range(count)]
