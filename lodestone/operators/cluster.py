"""Clustering: k-means with restarts, Ward's method on a sample, indices of quality, k selection, profiles.

Vectors are array<double> columns. Indices that need all pairs run on a bounded
sample that is drawn before the pairs are made; those on all rows are sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scalar as S

SILHOUETTE_SAMPLE, WARD_SAMPLE, WARD_MOST = 5000, 1200, 2000
#: Rows of the sample that one task compares with all.
SILHOUETTE_BLOCK = 500


def matrix(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, x): the columns as z-scores with the population's deviation, non-finite values as 0."""
    own = df.select(key, *[S.finite(F.col(c).cast("double")).alias(c) for c in columns])
    stats = own.agg(*[f(c).alias(f"{c}__{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    x = F.array(*[S.z_score(c, F.col(f"{c}__m"), F.col(f"{c}__s")) for c in columns])
    return own.join(F.broadcast(stats)).select(key, x.alias("x"))


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, d: s + d)


def kmeans(df: DataFrame, k: int, inits: int = 10, x: str = "x", seed: int = 42):
    """(model, cost): the best of several starts by the training cost. The vectors are cached over the starts."""
    own = df.select(array_to_vector(x).alias("features")).cache()
    fitted = [KMeans(k=k, seed=seed + i, maxIter=100).fit(own) for i in range(inits)]
    own.unpersist()
    best = min(fitted, key=lambda m: m.summary.trainingCost)
    return best, best.summary.trainingCost


def assign(df: DataFrame, centroids: Sequence[Sequence[float]], x: str = "x") -> DataFrame:
    """df with `cluster` and `d2`, the squared distance to the nearest centroid; the first of ties."""
    d = F.array(*[F.struct(F.round(squared(F.col(x), F.array(*map(F.lit, c))), 9).alias("d2"), F.lit(i).alias("c")) for i, c in enumerate(centroids)])
    least = F.array_min(d)
    return df.withColumns({"cluster": least["c"], "d2": least["d2"]})


def centroids(df: DataFrame, x: str = "x", cluster: str = "cluster") -> DataFrame:
    """(cluster, dim, mean, n): the step of Lloyd's algorithm after an assignment."""
    long = df.select(cluster, F.posexplode(x).alias("dim", "v"))
    return long.groupBy(cluster, "dim").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))


def _centred(df: DataFrame, x: str, cluster: str) -> tuple[DataFrame, DataFrame]:
    """(cluster, c, n) with each cluster's mean vector, and rows with the squared distance to their own."""
    c = centroids(df, x, cluster).groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("c"), F.max("n").alias("n"))
    return c, df.join(F.broadcast(c), cluster).withColumn("d2", squared(F.col(x), F.col("c")))


def calinski_harabasz(df: DataFrame, x: str = "x", cluster: str = "cluster") -> DataFrame:
    """One row (score): between-cluster over within-cluster variance."""
    c, rows = _centred(df, x, cluster)
    within = rows.agg(F.sum("d2").alias("w"), F.count(F.lit(1)).alias("n"))
    dims = df.select(F.posexplode(x).alias("dim", "v")).groupBy("dim").agg(F.avg("v").alias("m"))
    middle = dims.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("g"))
    between = c.join(F.broadcast(middle)).agg(F.sum(F.col("n") * squared(F.col("c"), F.col("g"))).alias("b"), F.count(F.lit(1)).alias("k"))
    score = F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))
    return between.join(F.broadcast(within)).select(F.round(F.when((F.col("k") > 1) & (F.col("w") > 0), score), 6).alias("score"))


def davies_bouldin(df: DataFrame, x: str = "x", cluster: str = "cluster") -> DataFrame:
    """One row (score): the mean over clusters of the worst ratio of spreads to the distance between centroids."""
    c, rows = _centred(df, x, cluster)
    spread = rows.groupBy(cluster).agg(F.avg(F.sqrt("d2")).alias("s"))
    own = c.join(spread, cluster).select(cluster, "c", "s")
    # One row per cluster: the pairs are few.
    pairs = own.alias("a").join(F.broadcast(own.alias("b")), F.col(f"a.{cluster}") != F.col(f"b.{cluster}"))
    r = (F.col("a.s") + F.col("b.s")) / F.sqrt(squared(F.col("a.c"), F.col("b.c")))
    return pairs.groupBy(F.col(f"a.{cluster}")).agg(F.max(r).alias("r")).agg(F.round(F.avg("r"), 6).alias("score"))


def silhouette(df: DataFrame, key: str, x: str = "x", cluster: str = "cluster", most: int = SILHOUETTE_SAMPLE) -> DataFrame:
    """One row (score): the mean Euclidean silhouette of a sample of at most `most` rows; 0 for a cluster of one.

    The sample's vectors are sent to the executors, and blocks of it are compared
    with all of it by array operations.
    """
    own = df.orderBy(S.seeded(key), key).limit(most).select(F.col(x).alias("x"), F.col(cluster).cast("string").alias("c"))
    rows = own.collect()  # a bounded sample
    spark = df.sparkSession
    if not rows:
        return spark.range(0).agg(F.avg("id").alias("score"))
    names, codes = np.unique(np.array([r.c for r in rows]), return_inverse=True)
    points = np.array([r.x for r in rows], float)
    sent, n, k = spark.sparkContext.broadcast((points, codes, np.bincount(codes))), len(points), len(names)

    def run(batches):
        points, codes, sizes = sent.value
        for b in batches:
            for start in b.column(0).to_pylist():
                at = np.arange(start, min(start + SILHOUETTE_BLOCK, n))
                squares = np.zeros((len(at), n))
                for dim in points.T:
                    gap = dim[at, None] - dim[None, :]
                    squares += gap * gap
                distance = np.sqrt(squares)
                sums = np.stack([distance[:, codes == c].sum(axis=1) for c in range(k)], axis=1)
                mine = codes[at]
                alone = sizes[mine] < 2
                inner = sums[np.arange(len(at)), mine] / np.maximum(sizes[mine] - 1, 1)
                means = sums / sizes
                means[np.arange(len(at)), mine] = np.inf
                outer = means.min(axis=1)
                most_ = np.maximum(inner, outer)
                none = alone | ~np.isfinite(outer) | (most_ == 0)
                score = np.where(none, 0.0, (outer - inner) / np.where(none, 1.0, most_))
                yield pa.RecordBatch.from_arrays([pa.array([float(score.sum())])], ["s"])

    starts = spark.range(0, n, SILHOUETTE_BLOCK, -(-n // SILHOUETTE_BLOCK))
    return starts.mapInArrow(run, "s double").agg(F.round(F.sum("s") / n, 6).alias("score"))


def elbow(curve: DataFrame) -> DataFrame:
    """(k, inertia) with the distance to the chord between its ends (not normalised); the largest is the elbow."""
    ends = curve.agg(F.min_by("inertia", "k").alias("y0"), F.max_by("inertia", "k").alias("y1"), F.min("k").alias("x0"), F.max("k").alias("x1"))
    cross = (F.col("x1") - F.col("x0")) * (F.col("inertia") - F.col("y0")) - (F.col("y1") - F.col("y0")) * (F.col("k") - F.col("x0"))
    return curve.join(F.broadcast(ends)).select("k", F.round("inertia", 6).alias("inertia"), F.round(F.abs(cross), 6).alias("distance"))


def best_k(diagnostics: Sequence[dict], prefer: int | None = None) -> tuple[int, str]:
    """The k to use and why: a preferred one, else the elbow; the k with the largest silhouette is named beside it."""
    at = max(diagnostics, key=lambda r: (r["distance"], -r["k"]))["k"]
    sil = max(diagnostics, key=lambda r: (r.get("silhouette") or -1.0, -r["k"]))["k"]
    if prefer:
        return prefer, f"given; elbow {at}, silhouette {sil}"
    return at, f"elbow; silhouette {sil}"


def k_selection(df: DataFrame, key: str, ks: Sequence[int] = range(2, 9), x: str = "x", rows: int = 2000) -> list[dict]:
    """Inertia, silhouette, elbow distance and the other indices for each k, on a sample."""
    own = df.orderBy(S.seeded(key), key).limit(rows).select(key, x).cache()
    out = []
    for k in ks:
        model, cost = kmeans(own, k, x=x)
        labelled = assign(own, [c.tolist() for c in model.clusterCenters()], x)
        out.append({"k": k, "inertia": cost, "silhouette": silhouette(labelled, key, x).first().score, "calinski_harabasz": calinski_harabasz(labelled, x).first().score, "davies_bouldin": davies_bouldin(labelled, x).first().score})
    a, b = out[0], out[-1]
    for r in out:
        r["distance"] = abs((b["k"] - a["k"]) * (r["inertia"] - a["inertia"]) - (b["inertia"] - a["inertia"]) * (r["k"] - a["k"]))
    own.unpersist()
    return out


def ward_merges(points: np.ndarray) -> np.ndarray:
    """The merges of Ward's method as rows (a, b, distance, size), by nearest-neighbour chains.

    Distances are updated by the Lance-Williams formula on the squared ones;
    merges are sorted by distance at the end and clusters renumbered.
    """
    n = len(points)
    if n < 2:
        return np.zeros((0, 4))
    d = ((points[:, None, :] - points[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    size, alive, chain, raw = np.ones(n), np.ones(n, bool), [], []
    while len(raw) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            top = chain[-1]
            row = np.where(alive, d[top], np.inf)
            row[top] = np.inf
            near = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[near]:
                near = chain[-2]
                break
            chain.append(near)
        a, b = sorted((chain.pop(), chain.pop()))
        dab = d[a, b]
        raw.append((a, b, dab))
        s = size[a] + size[b] + size
        new = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * dab) / s
        size[a] += size[b]
        alive[b] = False
        d[a, :], d[:, a] = new, new
        d[a, a] = np.inf
    raw.sort(key=lambda m: m[2])
    parent, label, count, out = list(range(n)), list(range(n)), [1] * n, []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for step, (a, b, dab) in enumerate(raw):
        a, b = find(a), find(b)
        la, lb = sorted((label[a], label[b]))
        parent[b] = a
        count[a] += count[b]
        label[a] = n + step
        out.append((la, lb, dab**0.5, count[a]))
    return np.array(out)


def cut_merges(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """Cluster numbers from 1 after all but the last k - 1 merges, in order of each cluster's first point."""
    parent = list(range(n + len(merges)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for step, (a, b, *_) in enumerate(merges[: max(0, n - k)]):
        parent[find(int(a))] = parent[find(int(b))] = n + step
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(find(i), len(seen) + 1) for i in range(n)])


def leaf_order(merges: np.ndarray, n: int) -> list[int]:
    """Leaves from left to right in the dendrogram."""
    stack, out = [n + len(merges) - 1] if len(merges) else list(range(n)), []
    while stack:
        i = stack.pop()
        if i < n:
            out.append(i)
        else:
            stack += [int(merges[i - n][1]), int(merges[i - n][0])]
    return out


def ward(df: DataFrame, key: str, k: int, x: str = "x", most: int = WARD_SAMPLE, seed: int = 42) -> DataFrame:
    """(key, cluster) of a seeded sample by Ward's method, in one task: at most WARD_MOST rows, the method is quadratic."""
    own = df.select(F.col(key).alias("key"), F.col(x).alias("x")).orderBy(S.seeded(key, seed), key).limit(min(most, WARD_MOST))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        points = np.array(rows["x"].tolist(), float)
        return pd.DataFrame({"key": rows["key"].to_numpy(), "cluster": cut_merges(ward_merges(points), len(points), k)})

    kind = df.schema[key].dataType.simpleString()
    return own.groupBy(F.lit("all")).applyInPandas(run, f"key {kind}, cluster int").withColumnRenamed("key", key)


def project(df: DataFrame, key: str, x: str = "x", rows: int = 5000) -> DataFrame:
    """(key, pc1, pc2): two principal components fitted on a sample of centred vectors; signs are arbitrary."""
    own = df.select(key, array_to_vector(x).alias("features"))
    from pyspark.ml.feature import StandardScaler

    centred = StandardScaler(inputCol="features", outputCol="c", withMean=True, withStd=False).fit(own).transform(own)
    model = PCA(k=2, inputCol="c", outputCol="p").fit(centred.orderBy(S.seeded(key), key).limit(rows))
    p = vector_to_array("p")
    return model.transform(centred).select(key, F.get(p, F.lit(0)).alias("pc1"), F.get(p, F.lit(1)).alias("pc2"))


def profile(df: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Per cluster: rows, share in percent, means."""
    total = df.agg(F.count(F.lit(1)).alias("__t"))
    g = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in columns])
    return g.join(F.broadcast(total)).withColumn("share_pct", F.round(100 * F.col("n") / F.col("__t"), 4)).drop("__t")


def top_values(df: DataFrame, column: str, k: int = 3, cluster: str = "cluster") -> DataFrame:
    """(cluster, top): the k most frequent values as text "value (count), ..", ties by value. Counts are taken first."""
    n = df.groupBy(cluster, column).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(cluster).orderBy(F.desc("n"), column)
    top = n.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    text = F.format_string("%s (%d)", F.col(column).cast("string"), F.col("n"))
    return top.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", text.alias("t")))), lambda s: s["t"]), ", ").alias("top"))


def tiers(profiles: DataFrame, value: str, names: Sequence[str] = ("low", "mid", "high"), cluster: str = "cluster") -> DataFrame:
    """Clusters ranked by a value (ties by number) and dealt into tiers of n / 3 ranks; one row per cluster."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    r = F.row_number().over(Window.orderBy(value, cluster))
    at = F.least(F.floor((r - 1) / F.greatest(n / len(names), F.lit(1.0))), F.lit(len(names) - 1)).cast("int")
    return profiles.withColumn("tier", F.get(F.array(*map(F.lit, names)), at))


def variants(df: DataFrame, name: str, cluster: str = "cluster") -> DataFrame:
    """Names that occur again get "(variant 2)", and so on, by cluster number."""
    r = F.row_number().over(Window.partitionBy(name).orderBy(cluster))
    return df.withColumn(name, F.when(r > 1, F.concat(F.col(name), F.lit(" (variant "), r.cast("string"), F.lit(")"))).otherwise(F.col(name)))

