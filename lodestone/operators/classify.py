"""Classification: gain-ratio trees grown level by level, naive Bayes as aggregates, Spark ML models, macro metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import log2

from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.binned import Forest
from lodestone.operators.clean import quantile_edges

#: Values of a tree's attribute at most; more are cut into bins.
MAX_BINS = 1000
#: Ranges that distinct scores are cut into.
SCORE_RANGES = 1000


# --- information gain ---------------------------------------------------------


def _entropy(n: Column, total: Column) -> Column:
    p = n / total
    return -F.sum(F.when(n > 0, p * F.log2(p)))


def gain_ratios(df: DataFrame, attributes: Sequence[str], label: str) -> DataFrame:
    """(attribute, info_gain, split_info, gain_ratio) of all attributes, in one contingency table."""
    long = df.select(F.col(label).cast("string").alias("y"), *[F.col(a).cast("string").alias(a) for a in attributes]).unpivot("y", list(attributes), "attribute", "bin")
    cells = long.groupBy("attribute", "bin", "y").agg(F.count(F.lit(1)).alias("n"))
    bins = cells.groupBy("attribute", "bin").agg(F.sum("n").alias("nb"))
    classes = cells.groupBy("attribute", "y").agg(F.sum("n").alias("ny"))
    totals = bins.groupBy("attribute").agg(F.sum("nb").alias("nt"))
    h = classes.join(totals, "attribute").groupBy("attribute").agg(_entropy(F.col("ny"), F.col("nt")).alias("h"))
    split = bins.join(totals, "attribute").groupBy("attribute").agg(_entropy(F.col("nb"), F.col("nt")).alias("split_info"))
    inner = cells.join(bins, ["attribute", "bin"]).join(totals, "attribute")
    # The bins' entropies, each weighted by its share: -sum n/nt * log2(n/nb).
    rest = inner.groupBy("attribute").agg((-F.sum(F.col("n") / F.col("nt") * F.log2(F.col("n") / F.col("nb")))).alias("rest"))
    joined = h.join(split, "attribute").join(rest, "attribute")
    gain = F.col("h") - F.col("rest")
    ratio = F.when((F.col("h") > 0) & (F.col("split_info") > 0), gain / F.when(F.col("split_info") > 0, F.col("split_info"))).otherwise(0.0)
    return joined.select("attribute", F.round(gain, 6).alias("info_gain"), F.round("split_info", 6).alias("split_info"), F.round(ratio, 6).alias("gain_ratio"))


@dataclass
class Node:
    counts: dict[str, int]
    depth: int
    path: tuple[tuple[str, str], ...] = ()
    attribute: str | None = None
    gain: float = 0.0
    children: dict[str, "Node"] = field(default_factory=dict)

    @property
    def n(self) -> int:
        return sum(self.counts.values())

    @property
    def best(self) -> str:
        return min(self.counts, key=lambda c: (-self.counts[c], c))

    def leaves(self):
        if not self.children:
            yield self
        for c in self.children.values():
            yield from c.leaves()

    def nodes(self):
        yield self
        for c in self.children.values():
            yield from c.nodes()


def _h(counts) -> float:
    n = sum(counts)
    return -sum(c / n * log2(c / n) for c in counts if c) if n else 0.0


class GainRatioTree:
    """A C4.5 tree with a branch for every bin of the attribute with the best gain ratio.

    One Spark job grows a whole level: rows get the number of their open node
    by one expression, and a contingency table of (node, attribute, bin, class)
    comes back. Its size is bounded by nodes x attributes x bins x classes,
    whatever the number of rows: attributes of more than MAX_BINS values are cut
    into quantile bins if they are numbers, left out if no value occurs twice,
    and an error else.

    A split on the attribute with the best gain ratio is rejected as a whole, and
    the node is a leaf, if one of its branches has under min_leaf rows.
    """

    def __init__(self, max_depth: int = 8, min_split: int = 20, min_leaf: int = 10, prune: bool = False, confidence: float = 0.25, bins: int = 10):
        self.max_depth, self.min_split, self.min_leaf, self.prune_it, self.confidence, self.bins = max_depth, min_split, min_leaf, prune, confidence, bins

    def fit(self, df: DataFrame, attributes: Sequence[str], label: str) -> "GainRatioTree":
        self.label = label
        self._choose(df, attributes)
        data = df.select(F.col(label).cast("string").alias("__y"), *[self._bin(a).alias(a) for a in self.attributes])
        self.root = Node({r["__y"]: r.n for r in data.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}, 0)
        open_nodes = [self.root]
        while open_nodes := [x for x in open_nodes if x.depth < self.max_depth and x.n >= self.min_split and sum(v > 0 for v in x.counts.values()) > 1]:
            place = F.lit(None).cast("int")
            for i, x in enumerate(open_nodes):
                place = F.when(self._on(x.path), F.lit(i)).otherwise(place)
            tagged = data.withColumn("__node", place).where("__node is not null")
            long = tagged.unpivot(["__node", "__y"], self.attributes, "attribute", "bin")
            table: dict = {}
            for r in long.groupBy("__node", "attribute", "bin", "__y").agg(F.count(F.lit(1)).alias("n")).collect():
                table.setdefault((r["__node"], r.attribute), {}).setdefault(r.bin, {})[r["__y"]] = r.n
            grown = []
            for i, x in enumerate(open_nodes):
                best, at = 0.0, None
                used = {a for a, _ in x.path}
                for a in self.attributes:  # the first wins ties
                    bins = table.get((i, a), {})
                    if a in used or len(bins) < 2 or len(bins) == x.n:
                        continue
                    sizes = [sum(b.values()) for b in bins.values()]
                    gain, info = _h(x.counts.values()) - sum(s / x.n * _h(b.values()) for s, b in zip(sizes, bins.values(), strict=True)), _h(sizes)
                    ratio = gain / info if info > 0 else 0.0
                    if ratio > best + 1e-12:
                        best, at = ratio, a
                if at and min(sum(b.values()) for b in table[i, at].values()) >= self.min_leaf:
                    x.attribute, x.gain = at, best
                    for b, counts in sorted(table[i, at].items(), key=lambda kv: (kv[0] is None, kv[0])):
                        x.children[b] = Node(counts, x.depth + 1, (*x.path, (at, b)))
                        grown.append(x.children[b])
            open_nodes = grown
        if self.prune_it:
            self._prune(self.root)
        return self

    def _choose(self, df: DataFrame, attributes: Sequence[str]) -> None:
        """Which attributes are used, and the inner edges of those that are cut into bins."""
        n = df.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(a).alias(a) for a in attributes]).first()
        self.attributes, self.edges = [], {}
        numbers = ("byte", "short", "integer", "long", "float", "double")
        many = [a for a in attributes if df.schema[a].dataType.typeName() in numbers and n[a] > self.bins]
        if many:
            self.edges = {r.column_name: list(r.edges)[1:-1] for r in quantile_edges(df, many, self.bins).collect()}
        for a in attributes:
            if a not in self.edges and n[a] > MAX_BINS:
                if n[a] >= 0.9 * n.n:
                    continue  # a key: the split would have a branch for each row
                raise ValueError(f"{a} has some {n[a]} values; {MAX_BINS} at most")
            self.attributes.append(a)

    def _bin(self, a: str) -> Column:
        """An attribute's bin as text; of a number that is cut, the count of edges it is over, (a, b]."""
        if a not in self.edges:
            return F.col(a).cast("string")
        over = sum((F.when(F.col(a) > e, 1).otherwise(0) for e in self.edges[a]), F.lit(0))
        return F.when(F.col(a).isNotNull(), over.cast("string"))

    def _on(self, path) -> Column:
        on = F.lit(True)
        for a, b in path:
            on = on & F.col(a).eqNullSafe(F.lit(b))
        return on

    def _errors(self, x: Node) -> float:
        """The upper bound of errors in a leaf, at the confidence: the normal approximation of the binomial's."""
        from statistics import NormalDist

        z, n, f = NormalDist().inv_cdf(1 - self.confidence), x.n, 1 - x.counts[x.best] / x.n
        return n * (f + z * z / (2 * n) + z * (f / n - f * f / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)

    def _prune(self, x: Node) -> float:
        below = sum(self._prune(c) for c in x.children.values()) if x.children else float("inf")
        own = self._errors(x)
        if own <= below + 0.1:
            x.children, x.attribute = {}, None
            return own
        return below

    def _walk(self, of_leaf) -> Column:
        """One nested expression over the tree; an unseen bin takes the smallest branch."""
        def of(x: Node) -> Column:
            if not x.children:
                return of_leaf(x)
            first, *rest = sorted(x.children, key=lambda b: (b is None, b))
            out = of(x.children[first])
            for b in rest:
                out = F.when(self._bin(x.attribute).eqNullSafe(F.lit(b)), of(x.children[b])).otherwise(out)
            return out

        return of(self.root)

    def predict(self, df: DataFrame, to: str = "predicted") -> DataFrame:
        """df with the class of each row."""
        return df.withColumn(to, self._walk(lambda x: F.lit(x.best)))

    def predict_proba(self, df: DataFrame, to: str = "probability") -> DataFrame:
        """df with a map from each class to its share of the rows in the leaf."""
        classes = sorted(self.root.counts)

        def shares(x: Node) -> Column:
            return F.create_map(*[v for c in classes for v in (F.lit(c), F.lit(x.counts.get(c, 0) / x.n))])

        return df.withColumn(to, self._walk(shares))

    def rules(self, min_confidence: float = 0.5) -> list[dict]:
        """One rule for each leaf, the surest first; rules with the same conditions once."""
        out, seen = [], set()
        for leaf in self.root.leaves():
            hits = leaf.counts[leaf.best]
            text = " AND ".join(f"{a} = {b}" for a, b in leaf.path)
            if hits / leaf.n >= min_confidence and text not in seen:
                seen.add(text)
                out.append({"antecedent": text, "n_conditions": len(leaf.path), "conclusion": leaf.best, "confidence": round(hits / leaf.n, 4), "support_abs": leaf.n, "support_pct": round(100 * leaf.n / self.root.n, 4), "error_count": leaf.n - hits})
        out.sort(key=lambda r: (-r["confidence"], -r["support_abs"], r["antecedent"]))
        return [{"rule_id": i, **r} for i, r in enumerate(out, 1)]

    def stats(self) -> dict:
        leaves = list(self.root.leaves())
        return {"leaves": len(leaves), "depth": max(x.depth for x in leaves), "nodes": sum(1 for _ in self.root.nodes()), "train_accuracy": sum(x.counts[x.best] for x in leaves) / max(1, self.root.n)}

    def text(self) -> str:
        def lines(x: Node, name: str):
            yield f"{'  ' * x.depth}{name}: {x.best} ({x.n}/{x.n - x.counts[x.best]})" + (f" by {x.attribute}" if x.children else "")
            for b, c in x.children.items():
                yield from lines(c, f"{x.attribute} = {b}")

        return "\n".join(lines(self.root, "all"))

    def importance(self) -> list[dict]:
        """The sum of gain ratios by attribute, ranked, with the cumulative share."""
        sums = dict.fromkeys(self.attributes, 0.0)
        for x in self.root.nodes():
            if x.attribute:
                sums[x.attribute] += x.gain
        total, so_far, out = sum(sums.values()) or 1.0, 0.0, []
        for i, (a, v) in enumerate(sorted(sums.items(), key=lambda kv: (-kv[1], kv[0])), 1):
            so_far += v
            out.append({"rank": i, "attribute": a, "sum_gain_ratio": round(v, 6), "cumulative": round(so_far / total, 6)})
        return out


# --- naive Bayes --------------------------------------------------------------


def categorical_nb(train: DataFrame, attributes: Sequence[str], label: str, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Priors (y, ny, log_prior) and smoothed likelihoods (attribute, bin, y, log_yes, log_no) of one-hot bins."""
    long = train.select(F.col(label).cast("string").alias("y"), *[F.col(a).cast("string").alias(a) for a in attributes]).unpivot("y", list(attributes), "attribute", "bin")
    priors = train.groupBy(F.col(label).cast("string").alias("y")).agg(F.count(F.lit(1)).alias("ny"))
    total = priors.agg(F.sum("ny").alias("nt"))
    priors = priors.join(F.broadcast(total)).select("y", "ny", F.log(F.col("ny") / F.col("nt")).alias("log_prior"))
    seen = long.groupBy("attribute", "bin", "y").agg(F.count(F.lit(1)).alias("n"))
    grid = seen.select("attribute", "bin").distinct().join(F.broadcast(priors.select("y", "ny")))  # one row for each class
    full = grid.join(seen, ["attribute", "bin", "y"], "left")
    p = (F.coalesce("n", F.lit(0)) + alpha) / (F.col("ny") + 2 * alpha)
    return priors, full.select("attribute", "bin", "y", F.log(p).alias("log_yes"), F.log(1 - p).alias("log_no"))


def apply_categorical_nb(rows: DataFrame, key: str, attributes: Sequence[str], priors: DataFrame, likelihoods: DataFrame) -> DataFrame:
    """(key, predicted): the class with the largest sum of log-likelihoods over all one-hot columns."""
    base = likelihoods.groupBy("y").agg(F.sum("log_no").alias("base")).join(priors, "y").select("y", (F.col("base") + F.col("log_prior")).alias("base"))
    long = rows.select(key, *[F.col(a).cast("string").alias(a) for a in attributes]).unpivot(key, list(attributes), "attribute", "bin")
    # A bin that a row has changes its log_no to log_yes. The table of bins and classes is broadcast if it measures small.
    gain = long.join(likelihoods, ["attribute", "bin"]).groupBy(key, "y").agg(F.sum(F.col("log_yes") - F.col("log_no")).alias("gain"))
    every = rows.select(key).join(F.broadcast(base)).join(gain, [key, "y"], "left")
    score = every.withColumn("score", F.round(F.col("base") + F.coalesce("gain", F.lit(0.0)), 9))
    return score.groupBy(key).agg(F.max_by("y", F.struct("score", "y")).alias("predicted"))


def gaussian_moments(train: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(y, feature, n, mean, variance) with the population's variance."""
    long = train.select(F.col(label).cast("string").alias("y"), *[F.col(f).cast("double").alias(f) for f in features]).unpivot("y", list(features), "feature", "x")
    return long.groupBy("y", "feature").agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.var_pop("x"), 6).alias("variance"))


# --- metrics ------------------------------------------------------------------


def confusion(df: DataFrame, actual: str, predicted: str, classes: Sequence[str]) -> DataFrame:
    """Rows by actual class, a column for each predicted class, 0 where none."""
    return df.groupBy(F.col(actual).cast("string").alias("actual")).agg(*[F.count_if(F.col(predicted).cast("string") == c).alias(f"pred_{c}") for c in classes])


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(class, precision, recall, f1, support) of every class that is actual or predicted; 0 where undefined."""
    pairs = df.groupBy(F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    long = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("class"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("np"), F.col("n").alias("na")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("np"), F.lit(0).cast("long").alias("na")),
    )))
    g = long.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("np").alias("np"), F.sum("na").alias("support"))
    p, r = F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    g = g.select("class", "support", "tp", p.alias("precision"), r.alias("recall"))
    f = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / F.when(F.col("precision") + F.col("recall") > 0, F.col("precision") + F.col("recall"))).otherwise(0.0)
    return g.withColumn("f1", f)


def macro_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: accuracy and unweighted means over the classes."""
    g = class_report(df, actual, predicted)
    return g.agg(F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"), *[F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def auc_one_vs_rest(df: DataFrame, actual: str, scores: dict[str, str]) -> DataFrame:
    """(class, auc): the rank-sum statistic with mean ranks of ties, from counts of distinct scores.

    Ranks come from running sums over distinct scores, so equal scores, however
    many, are one row. The sums run within ranges of scores, and over the ranges'
    own sums, so that no task holds all scores of a class.
    """
    long = df.select(F.col(actual).cast("string").alias("a"), *[F.col(c).alias(k) for k, c in scores.items()]).unpivot("a", list(scores), "class", "score")
    by = long.groupBy("class", "score").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("class")).alias("pos"))
    ends = by.groupBy("class").agg(F.min("score").alias("__low"), F.max("score").alias("__high"))
    place = (F.col("score") - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0)) * (SCORE_RANGES - 1)
    by = by.join(F.broadcast(ends), "class").withColumn("range", F.coalesce(F.floor(place), F.lit(0)))
    before = Window.partitionBy("class").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = by.groupBy("class", "range").agg(F.sum("n").alias("m")).withColumn("before", F.sum("m").over(before) - F.col("m")).drop("m")
    w = Window.partitionBy("class", "range").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    ranked = by.withColumn("sum", F.sum("n").over(w)).join(ranges, ["class", "range"]).withColumn("rank", F.col("before") + F.col("sum") - (F.col("n") - 1) / 2)
    g = ranked.groupBy("class").agg(F.sum(F.col("rank") * F.col("pos")).alias("s"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    auc = (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))
    return g.where("p > 0 and n > p").select("class", F.round(auc, 6).alias("auc"))


def majority(df: DataFrame, label: str) -> DataFrame:
    """(label, n): the most frequent class, the smallest of ties."""
    return df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(1)


# --- models of Spark ML -------------------------------------------------------


def models(features: str = "features", label: str = "label", key: str | None = None) -> dict:
    """The models by name, with the parameters of the survey. key: the rows' id, by which the forest draws them."""
    return {
        "entropy_tree": DecisionTreeClassifier(featuresCol=features, labelCol=label, impurity="entropy", maxDepth=7, minInstancesPerNode=10),
        "random_forest": Forest(120, 12, classes=True, label=label, features=features, key=key),
        "gaussian_nb": NaiveBayes(featuresCol=features, labelCol=label, modelType="gaussian"),
    }


def assemble(df: DataFrame, columns: Sequence[str], label: str | None = None) -> DataFrame:
    out = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df)
    return out.withColumn("label", F.col(label).cast("double")) if label else out


class TreeModel:
    """The gain-ratio tree in the form of a Spark ML model: fit and transform on columns, `label` and `prediction`."""

    def __init__(self, attributes: Sequence[str], **settings):
        self.attributes, self.settings = list(attributes), settings

    def fit(self, df: DataFrame) -> "TreeModel":
        out = TreeModel(self.attributes, **self.settings)
        out.tree = GainRatioTree(**self.settings).fit(df.withColumn("__class", F.col("label").cast("int")), self.attributes, "__class")
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        shares = self.tree.predict_proba(df, "__shares")
        scored = self.tree.predict(shares, "prediction").withColumn("prediction", F.col("prediction").cast("double"))
        classes = sorted(self.tree.root.counts)
        return scored.withColumn("probability", F.array(*[F.col("__shares")[c] for c in classes])).drop("__shares")


class Majority:
    """The baseline: the most frequent class of the training rows."""

    def fit(self, df: DataFrame) -> "Majority":
        out = Majority()
        out.label = float(majority(df, "label").first().label)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(self.label))


def compare_models(train: DataFrame, test: DataFrame, which: dict | None = None, k: int = 0, fold: str = "fold") -> list[dict]:
    """Accuracy and macro metrics of each model on test (columns features, label), with k its mean accuracy over the folds of train, and the area under the curve from its own scores; the best first."""
    out = []
    for name, m in (which or models()).items():
        fitted = m.fit(train).transform(test)
        scored = fitted.select(F.col("label").cast("int").alias("a"), F.col("prediction").cast("int").alias("p"))
        row = {"model": name, **macro_metrics(scored, "a", "p").first().asDict()}
        if k:
            row["cv_accuracy"] = round(cross_validate(train, m, k, fold), 6)
        row["auc"] = _area(fitted)
        out.append(row)
    return sorted(out, key=lambda r: (-r["accuracy"], r["model"]))


def _area(fitted: DataFrame) -> float | None:
    """The macro area over the classes from a model's probabilities (label: class numbers from 0); None without them."""
    if "probability" not in fitted.columns:
        return None
    kind = fitted.schema["probability"].dataType.typeName()
    shares = F.col("probability") if kind == "array" else vector_to_array("probability")
    own = fitted.select(F.col("label").cast("int").cast("string").alias("a"), shares.alias("p"))
    n = own.agg(F.max(F.size("p"))).first()[0] or 0
    wide = own.select("a", *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(n)])
    areas = [r.auc for r in auc_one_vs_rest(wide, "a", {str(i): f"p{i}" for i in range(n)}).collect()]
    return round(sum(areas) / len(areas), 6) if areas else None


def cross_validate(df: DataFrame, model, k: int = 5, fold: str = "fold") -> float:
    """Mean accuracy over the folds of a fold column."""
    total = 0.0
    for i in range(k):
        scored = model.fit(df.where(F.col(fold) != i)).transform(df.where(F.col(fold) == i))
        total += scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] or 0.0
    return total / k
