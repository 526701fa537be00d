"""Small fixtures: edges, ties, gaps, invariants."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import scalar as S
from lodestone.operators import association as AS
from lodestone.operators import classify as CL
from lodestone.operators import clean as C
from lodestone.operators import cluster as K
from lodestone.operators import feed as L
from lodestone.operators import ratings as R
from lodestone.operators import recommend as B
from lodestone.operators import regress as G
from lodestone.operators import tables as TB
from lodestone.sources import files


def test_clean_dirty_titles(spark):
    rows = [
        (1, " a ", "X, Y, Unknown, ", "TV", "12", 7.0, 100), (1, "b", "Z", "TV", "12", 7.0, 100), (2, "c", None, None, "Unknown", None, 101),
        (3, "d", "X", "odd", "x", 9.0, 1000), (4, "e", "Y", "TV", "24", None, 1001),
    ]
    df = spark.createDataFrame(rows, "item_id long, name string, genre string, type string, episodes string, rating double, members long")
    got = {r.item_id: r for r in C.clean(df, ["TV", "Movie"]).collect()}
    assert len(got) == 4 and got[1].tags == ["X", "Y"] and got[1].primary_genre == "X" and got[1].is_multi_genre == 1
    assert got[2].type == "Unknown" and got[2].tags == [] and got[2].primary_genre == "Unknown" and got[3].type == "Unknown"
    assert got[2].episodes == 18.0 and got[4].rating == 7.0 and got[2].rating == 9.0
    assert [got[i].members_band for i in (1, 2, 3, 4)] == ["tiny", "small", "small", "medium"]


def test_edges_of_bins(spark):
    df = spark.createDataFrame([(x,) for x in (6.0, 6.1, 6.8, 7.3, 10.9, 11.0, -1.0)], "x double")
    assert [r[0] for r in df.select(S.tier("x")).collect()] == ["Low", "Medium", "High", "Top", "Top", None, None]


def test_constant_column_scales_to_zero(spark):
    row = C.scale(spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, x double"), ["x"]).first()
    assert row.x_minmax == 0.0 and row.x_zscore == 0.0


def test_single_and_unscored_ratings(spark):
    df = spark.createDataFrame([(1, 1, 8), (2, 1, -1), (3, 1, 4), (3, 2, 9)], "user_id long, item_id long, rating int")
    got = {r.user_id: r for r in R.user_profile(df).collect()}
    assert set(got) == {1, 3} and got[1].std_rating == 0.0 and got[3].n_liked == 1 and got[3].n_disliked == 1 and got[3].range_rating == 5


TINY = [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "c"), (3, "a"), (3, "b"), (4, "c")]


def test_miners_agree_and_empty_baskets_count(spark):
    lines = spark.createDataFrame(TINY, "basket int, item string")
    baskets = lines.groupBy("basket").agg(F.collect_list("item").alias("items")).unionByName(spark.createDataFrame([(5, [])], "basket int, items array<string>"))
    a = {tuple(r["items"]): r.freq for r in AS.level_wise(lines, 5, 0.4).collect()}
    b = {tuple(r["items"]): r.freq for r in AS.fp_growth(baskets, 5, 0.4, 3).collect()}
    assert a == b and a["a", "b"] == 3 and a["a", "b", "c"] == 2


def test_rules_cover_every_split(spark):
    lines = spark.createDataFrame(TINY, "basket int, item string")
    rows = AS.rules(AS.level_wise(lines, 5, 0.4), 5).collect()
    pairs = {(tuple(r.antecedent), tuple(r.consequent)): r for r in rows}
    assert (("a",), ("b", "c")) in pairs and (("b", "c"), ("a",)) in pairs
    sure = pairs[("a",), ("b",)]
    assert sure.confidence == 1.0 and math.isinf(sure.conviction)
    for (a, c), r in pairs.items():
        assert r.lift == pytest.approx(pairs[c, a].lift) and -0.25 <= r.leverage <= 0.25 and r.support <= min(r.support_a, r.support_c) + 1e-12


def test_tree_splits_on_the_informative_attribute(spark):
    rows = [("x" if i % 2 else "y", str(i % 3), "c", "1" if i % 2 else "0") for i in range(60)]
    df = spark.createDataFrame(rows, "a string, b string, k string, y string")
    tree = CL.GainRatioTree(min_split=4, min_leaf=2).fit(df, ["a", "b", "k"], "y")
    assert tree.root.attribute == "a" and tree.stats()["leaves"] == 2 and tree.stats()["train_accuracy"] == 1.0
    assert tree.predict(df).where("predicted = y").count() == 60
    assert len(tree.rules()) == 2 and tree.importance()[0]["attribute"] == "a" and "by a" in tree.text()
    best = {r.attribute: r.gain_ratio for r in CL.gain_ratios(df, ["a", "b", "k"], "y").collect()}
    assert best["a"] == pytest.approx(1.0) and best["k"] == 0.0


def test_macro_metrics_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "a")], "y string, p string")
    r = CL.macro_metrics(df, "y", "p").first()
    assert r.accuracy == pytest.approx(2 / 3, abs=1e-6) and r.macro_recall == 0.5 and r.macro_precision == pytest.approx(1 / 3, abs=1e-6)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([("1", 0.5), ("0", 0.5), ("1", 0.9), ("0", 0.1)], "y string, s double")
    assert CL.auc_one_vs_rest(df, "y", {"1": "s"}).first().auc == pytest.approx(0.875)


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 2))
    y = x @ [1.5, -2] + 3 + rng.normal(size=40)
    df = CL.assemble(spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, label double"), ["a", "b"])
    m = G.ridge(df, "label", 1.0).fit(df)
    xc = x - x.mean(0)
    want = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ (y - y.mean()))
    assert np.allclose(m.coefficients.toArray(), want, atol=1e-6)


def test_blend_beats_both_ends(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(map(float, (v, v + e[0], v + e[1]))) for v, e in zip(rng.normal(size=50), rng.normal(size=(50, 2)), strict=True)]
    df = spark.createDataFrame(rows, "y double, a double, b double")
    best = G.blend(df, "a", "b", "y").first()
    ends = [sum((r[0] - r[i]) ** 2 for r in rows) for i in (1, 2)]
    assert 0 <= best.weight <= 1 and best.sse <= min(ends) + 1e-6


def _ward_brute(points, k):
    clusters = [[i] for i in range(len(points))]
    while len(clusters) > k:
        def cost(a, b):
            pa, pb = points[a].mean(0), points[b].mean(0)
            return len(a) * len(b) / (len(a) + len(b)) * ((pa - pb) ** 2).sum()

        _, i, j = min((cost(a, b), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        clusters[i] += clusters.pop(j)
    return {frozenset(c) for c in clusters}


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10_000))
def test_ward_is_brute_force(seed):
    points = np.random.default_rng(seed).normal(size=(12, 2))
    labels = K.cut_merges(K.ward_merges(points), 12, 3)
    assert {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels.tolist())} == _ward_brute(points, 3)
    assert sorted(K.leaf_order(K.ward_merges(points), 12)) == list(range(12))


def test_silhouette_of_five_points(spark):
    points, label = np.array([[0, 0], [0, 1], [5, 5], [5, 6], [6, 5]], float), [0, 0, 1, 1, 1]
    df = spark.createDataFrame([(i, p.tolist(), c) for i, (p, c) in enumerate(zip(points, label, strict=True))], "id int, x array<double>, cluster int")
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    want = []
    for i in range(5):
        own = [j for j in range(5) if label[j] == label[i] and j != i]
        a, b = d[i, own].mean(), d[i, [j for j in range(5) if label[j] != label[i]]].mean()
        want.append((b - a) / max(a, b))
    assert K.silhouette(df, "id").first().score == pytest.approx(np.mean(want), abs=1e-6)


TYPES = ["TV", "Movie"]
TITLE = "item_id long, name string, genre string, type string, episodes string, rating double, members long"
UPDATE = "item_id long, genre string, type string, episodes string, rating double, members long"
PAYLOAD = '{"mal_id": 1, "score": 8.75, "members": 100000, "scored_by": 600123, "favorites": 0, "episodes": 26, "type": "TV", "genres": [{"name": "Action"}, {"name": "Action"}], "themes": [{"name": "Space"}], "demographics": [{"name": "Seinen"}]}'


def test_normalise_payload(spark):
    rows = spark.createDataFrame([(PAYLOAD,), ("{broken",)], "json string")
    r = L.normalise(rows).where("item_id = 1").first()
    assert (r.genre, r.episodes, r.rating, r.type, r.scored_by, r.favorites) == ("Action, Space, Seinen", "26", 8.75, "TV", 600123, None)


def test_upsert_is_guarded_and_idempotent(spark):
    titles = spark.createDataFrame([(1, "name", "Unknown", "TV", "Unknown", 7.0, 100), (2, "other", "X", "TV", "3", 5.0, 10)], TITLE)
    new = spark.createDataFrame([(1, "Action", "TV", "26", 8.75, 1000), (2, " ", "XX", None, None, -5), (999999, "Y", "TV", "1", 5.0, 1)], UPDATE)
    once = L.upsert(titles, new, TYPES)
    got = {r.item_id: r for r in once.collect()}
    assert set(got) == {1, 2} and got[1].name == "name" and (got[1].genre, got[1].episodes, got[1].rating, got[1].members) == ("Action", "26", 8.75, 1000)
    assert got[2] == titles.where("item_id = 2").first()
    assert sorted(L.upsert(once, new, TYPES).collect()) == sorted(once.collect())
    assert {r.field for r in L.changes(titles, new, TYPES).collect()} == {"genre", "episodes", "rating", "members"}
    assert L.changes(once, new, TYPES).isEmpty()
    assert L.upsert(titles, new, TYPES, allow_new=True).count() == 2 and L.upsert(titles, new, TYPES, True, "new").where("name = 'new'").count() == 1


def test_versions_history_and_missing_tables(spark, tmp_path):
    t = files.Versioned(spark, str(tmp_path / "t"))
    assert t.read() is None
    for i in range(3):
        t.replace(spark.range(i + 1))
    assert t.versions() == [1, 2] and t.read().count() == 3
    assert files.try_read(spark, str(tmp_path / "none"), "a int").count() == 0
    h = spark.createDataFrame([(1, "2024-01-01 10:00:00")], "item_id int, fetched_at string")
    files.append_history(h, str(tmp_path / "h"))
    files.append_history(h, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2
    files.write_csv(h, str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), "item_id int, fetched_at string", ["item_id"]).collect() == [(1,)]
    memo = files.Memo(spark, 1)
    assert memo.read(str(tmp_path / "h")) is memo.read(str(tmp_path / "h"))


def test_insert_conflicts_and_required(spark):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    with pytest.raises(TB.Conflict):
        TB.insert(df, spark.createDataFrame([("a",)], "name string"), "id", ["name"], ["name"])
    with pytest.raises(ValueError):
        TB.insert(df, spark.createDataFrame([("",)], "name string"), "id", ["name"])
    assert TB.insert(df, spark.createDataFrame([("b",)], "name string"), "id", ["name"], ["name"]).where("id = 2").first().name == "b"
    assert TB.flatten({"a": {"b": [1, None, 0.5]}, "c": False}) == [("a.b[0]", "1"), ("a.b[1]", ""), ("a.b[2]", "0.5"), ("c", "False")]


def test_best_k_and_variants(spark):
    rows = [{"k": 2, "distance": 0.0, "silhouette": 0.5}, {"k": 3, "distance": 4.0, "silhouette": 0.3}]
    assert K.best_k(rows)[0] == 3 and K.best_k(rows, 2)[0] == 2
    df = spark.createDataFrame([(1, "n"), (2, "n"), (3, "m")], "cluster int, name string")
    assert {r.cluster: r.name for r in K.variants(df, "name").collect()} == {1: "n", 2: "n (variant 2)", 3: "m"}


def test_recommender_falls_back_and_excludes(spark):
    titles = spark.createDataFrame([(i, f"t{i}", ["X"] if i % 2 else ["Y"], "X" if i % 2 else "Y", "TV", 5.0 + i, 2000 + i) for i in range(6)], "item_id int, name string, tags array<string>, primary_genre string, type string, rating double, members long")
    genre = spark.createDataFrame([(0, "X", 9.0), (0, "Y", 5.0)], "segment int, primary_genre string, affinity double")
    kind = spark.createDataFrame([(0, "TV", 7.0)], "segment int, type string, affinity double")
    r = B.Recommender(titles, genre, kind)
    assert [x.item_id for x in r.by_segment(0, 3).collect()] == [5, 3, 1]
    assert r.by_preferences(["none"], "TV", 2).count() == 2
    assert {x.name for x in r.by_watched(["t5"], 10).collect()} == {"t0", "t1", "t2", "t3", "t4"}


def test_splits_are_partitions(spark):
    df = C.split(spark.range(500), "id", stratify=None)
    n = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert sum(n.values()) == 500 and 60 < n["test"] < 140
    assert C.folds(spark.range(100), "id").select("fold").distinct().count() == 5


# --- ranks, trees, stages, feeds ----------------------------------------------


def test_a_split_with_a_small_branch_is_rejected_as_a_whole(spark):
    # `a` has the best ratio, but a branch of two rows; `b` would do, and isn't taken.
    rows = [("x" if i < 2 else "y", "p" if i < 10 else "q", 0 if i < 9 else 1) for i in range(20)]
    df = spark.createDataFrame(rows, "a string, b string, y int")
    ratios = {r.attribute: r.gain_ratio for r in CL.gain_ratios(df, ["a", "b"], "y").collect()}
    only = CL.GainRatioTree(min_split=2, min_leaf=5).fit(df, ["b"], "y")
    assert only.root.attribute == "b"
    best = max(ratios, key=ratios.get)
    tree = CL.GainRatioTree(min_split=2, min_leaf=5).fit(df, ["a", "b"], "y")
    assert tree.root.attribute == (None if best == "a" else "b")
    rows = [("x" if i < 2 else "y", "p" if i < 10 else "q", 0 if i < 2 else 1) for i in range(20)]
    tree = CL.GainRatioTree(min_split=2, min_leaf=5).fit(spark.createDataFrame(rows, "a string, b string, y int"), ["a", "b"], "y")
    assert tree.root.attribute is None and not tree.root.children


def test_tree_bins_numbers_leaves_out_keys_and_gives_shares(spark):
    df = spark.range(3000).select(F.col("id").alias("n"), F.concat(F.lit("k"), "id").alias("key"), (F.col("id") >= 1500).cast("int").alias("y"))
    tree = CL.GainRatioTree(min_split=2, min_leaf=5).fit(df, ["n", "key"], "y")
    assert tree.attributes == ["n"] and len(tree.edges["n"]) == 9 and tree.root.attribute == "n"
    got = tree.predict_proba(tree.predict(df)).select("y", "predicted", F.col("probability")["0"].alias("p0"), F.col("probability")["1"].alias("p1")).collect()
    assert all(str(r.y) == r.predicted and r.p0 + r.p1 == 1.0 and r.p1 == r.y for r in got)
    wide = spark.range(3000).select(F.concat(F.lit("k"), F.col("id") % 1500).alias("key"), (F.col("id") % 2).alias("y"))
    with pytest.raises(ValueError, match="values"):
        CL.GainRatioTree().fit(wide, ["key"], "y")


@pytest.mark.parametrize("scores", ["rand(3)", "floor(rand(3) * 4)", "cast(1 as double)", "pow(rand(3), 30) * 1e9"])
def test_auc_is_that_of_all_pairs(spark, scores):
    df = spark.range(300).select((F.rand(1) < 0.4).cast("int").alias("a"), F.expr(scores).alias("s")).cache()
    rows = [(r.a, r.s) for r in df.collect()]
    pos, neg = [s for a, s in rows if a], [s for a, s in rows if not a]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    got = CL.auc_one_vs_rest(df, "a", {"1": "s"}).collect()
    assert len(got) == 1 and abs(got[0].auc - want) < 1e-6
    df.unpersist()


def test_ranks_in_a_hot_class_are_those_of_one_sort(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 3 > 0, "hot").otherwise("rare").alias("c"))
    got = C.folds(df, "id", 5, "c")
    assert got.columns == ["id", "c", "fold"]
    by = {}
    for r in df.select("id", "c", S.seeded("id").alias("h")).collect():
        by.setdefault(r.c, []).append((r.h, r.id))
    want = {i: k % 5 for rows in by.values() for k, (_, i) in enumerate(sorted(rows))}
    assert {r.id: r.fold for r in got.collect()} == want
    parts = C.split(df, "id", stratify="c").groupBy("c").agg(F.count_if(F.col("split") == "test").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    assert all(abs(r.t - 0.2 * r.n) <= 1 for r in parts)


def test_model_table_and_fold_errors(spark):
    df = spark.range(400).select("id", (F.rand(2) * 10).alias("x"), F.lit(1.0).alias("z")).withColumn("label", (F.col("x") > 5).cast("double"))
    df = C.folds(CL.assemble(df, ["x", "z"]), "id")
    rows = CL.compare_models(df, df, {"majority": CL.Majority(), "tree": CL.models()["entropy_tree"]}, 5)
    assert rows[0]["model"] == "tree" and rows[0]["accuracy"] > 0.98 and rows[0]["cv_accuracy"] > 0.95 and rows[0]["auc"] > 0.98
    assert rows[1]["auc"] is None and 0.3 < rows[1]["cv_accuracy"] < 0.7
    line = df.withColumn("label", 3 * F.col("x") + 1)
    table = G.compare(line, line, {"ols": G.models(line)["ols"], "tree": G.models(line)["tree"]}, k=5)
    assert table[0]["model"] == "ols" and table[0]["cv_rmse"] < 1e-6 < table[1]["cv_rmse"]


def test_blend_learns_its_weight_on_validation_and_its_spread_on_test(spark):
    from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression

    df = spark.range(900).select("id", (F.rand(4) * 10).alias("x")).withColumn("label", F.col("x") * 0.9 + F.randn(5) * 0.1)
    df = C.split(CL.assemble(df, ["x"]), "id").cache()
    parts = [df.where(f"split = '{k}'") for k in ("train", "validation", "test")]
    model = G.Blend.fit(*parts, "id", which={"random_forest": LinearRegression(), "gbt": DecisionTreeRegressor(maxDepth=1)})
    assert model.weight > 0.9 and 0.05 < model.sigma < 0.2 and model.r2_full > 0.98
    assert [(r["split"], r["model"]) for r in model.table if r["split"] == "validation"] == [("validation", "blend")] and len(model.table) == 4
    got = model.predict(parts[2], "id").collect()
    assert all(1.0 <= r.low <= r.score <= r.high <= 10.0 for r in got)
    df.unpersist()


def test_silhouette_is_that_of_all_pairs(spark):
    r = np.random.default_rng(3)
    x, c = r.normal(size=(700, 3)), r.integers(0, 3, 700)
    x[c == 1] += 2
    c[0] = 9  # a cluster of one
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(700):
        mine = c == c[i]
        if mine.sum() < 2:
            want.append(0.0)
            continue
        a, b = d[i, mine].sum() / (mine.sum() - 1), min(d[i, c == k].mean() for k in set(c.tolist()) - {c[i]})
        want.append((b - a) / max(a, b))
    df = spark.createDataFrame([(i, x[i].tolist(), int(c[i])) for i in range(700)], "id long, x array<double>, cluster int")
    assert abs(K.silhouette(df, "id").first().score - np.mean(want)) < 1e-5
    assert K.silhouette(df.where("false"), "id").first().score is None
    assert K.silhouette(df.where("cluster = 1"), "id").first().score == 0.0


def test_too_few_baskets_are_an_error_and_defaults_hold(spark):
    baskets = spark.createDataFrame([(["a", "b", "c"],)] * 8 + [(["a"],)], "items array<string>")
    with pytest.raises(ValueError, match="8 baskets; 100"):
        AS.mine_users(baskets)
    assert AS.mine_users(baskets, min_baskets=8, min_lift=1.0).count() == 6
    assert AS.mine_tags(baskets.withColumnRenamed("items", "tags"), min_lift=1.0).where("confidence < 0.2").count() == 0


def test_fetches_fail_alone_and_a_sync_counts_them(spark):
    def fetch(i):
        if i % 2:
            raise KeyError(i)
        return '{"mal_id": %d, "score": 8.5, "type": "TV"}' % i

    got, failed = L.fetch_all([1, 2, 3, 4], fetch)
    assert [i for i, _ in got] == [2, 4] and failed == {1: "KeyError: 1", 3: "KeyError: 3"}
    titles = spark.createDataFrame([(2, "b", None, "TV", None, 7.0, 10), (4, "d", None, "TV", None, 8.5, 10)], "item_id long, name string, genre string, type string, episodes string, rating double, members long")
    payloads = spark.createDataFrame([(t,) for _, t in got] + [("{broken",), ("{}",), (None,)], "json string")
    out, report = L.sync(titles, payloads, ["TV"])
    assert report == {"fetched": 2, "failed": 3, "changed": 1, "fields": {"rating": 1}} and {r.item_id: r.rating for r in out.collect()} == {2: 8.5, 4: 8.5}


def test_ids_are_selected_by_each_mode(spark):
    titles = spark.createDataFrame([(i, i * 7 % 10) for i in range(10)], "item_id long, members long")
    state = spark.createDataFrame([(1, "2024-05-01"), (2, "2024-05-09")], "item_id long, at string").select("item_id", F.to_timestamp("at").cast("timestamp_ntz").alias("fetched_at"))

    def ids(**how):
        return [r.item_id for r in L.select_ids(titles, state, **how).orderBy("item_id").collect()]

    assert ids(ids=[3, 99]) == [3] and ids() == list(range(10)) and ids(limit=2) == [0, 1]
    assert ids(top=3) == [1, 4, 7] and ids(cutoff="2024-05-05") == [0, 1, 3, 4, 5, 6, 7, 8, 9] and ids(cutoff="2024-05-05", limit=3) == [0, 1, 3]


def test_json_cache_fetches_once_and_again_when_broken(spark, tmp_path):
    calls = []
    cache = files.JsonCache(spark, f"file://{tmp_path}", lambda k: calls.append(k) or '{"id": %d}' % k)
    assert cache.get(1) == cache.get(1) == {"id": 1} and calls == [1] and cache.hits == 1
    (tmp_path / "1.json").write_text('{"id": ')
    (tmp_path / ".1.json.crc").unlink(missing_ok=True)
    assert cache.get(1) == {"id": 1} and calls == [1, 1]
    assert cache.get(1, use_cache=False) == {"id": 1} and calls == [1, 1, 1]


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    from lodestone.streaming import live

    table = files.Versioned(spark, f"file://{tmp_path}/t")
    table.replace(spark.createDataFrame([(1, "a", "G", "TV", "1", 5.0, 10)], "item_id long, name string, genre string, type string, episodes string, rating double, members long"))
    run = live.upsert_batches(table, f"file://{tmp_path}/h", ["TV"])
    batch = spark.createDataFrame([(1, "2024-01-01", 6.0), (1, "2024-01-02", 7.0)], "item_id long, fetched_at string, rating double")
    for number in (0, 0, 1, 1):
        run(batch, number)
    assert [r.rating for r in table.read().collect()] == [7.0]
    assert {r.batch: r["count"] for r in spark.read.parquet(f"file://{tmp_path}/h").groupBy("batch").count().collect()} == {0: 2, 1: 2}


def test_running_profiles_of_a_stream(spark, tmp_path):
    from lodestone.streaming import live

    rows = spark.createDataFrame([(1, 8), (1, -1), (2, 4), (1, 6)], "user_id long, rating int")
    rows.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live.profiles(stream).writeStream.outputMode("complete").format("memory").queryName("profiles_test").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.user_id, r.n_ratings, r.mean_rating) for r in spark.table("profiles_test").collect()} == {(1, 2, 7.0), (2, 1, 4.0)}


def test_stages_fail_alone_and_keep_the_metrics_of_others(spark, tmp_path):
    from lodestone.operators import stages as ST

    def broken(s):
        raise RuntimeError("x" * 500)

    runner = ST.Runner(spark, files.Versioned(spark, f"file://{tmp_path}/s"), {2: lambda s: {"a": 1, "old": {"b": 2}}, 3: broken, 4: lambda s: {"ok": True}})
    info = runner.run()
    assert info[2].startswith("ok (") and info[4].startswith("ok (") and info[3].startswith("FAILED: RuntimeError: xxx") and len(info[3]) == 200
    runner.stages[2] = lambda s: {"a": 5}
    runner.run([2])
    assert {r.metric: r.value for r in runner.read().collect()} == {"stage2.a": "5", "stage4.ok": "True"}
    with pytest.raises(ValueError, match="9"):
        runner.run([9])
    log, built = f"file://{tmp_path}/log", []
    sync = lambda: {"selected": 4, "fetched": 3, "failed": 1, "changed": 1}
    assert ST.retrain(runner, log, sync, lambda: built.append(1), min_changed=2)["skipped"] and not built
    row = ST.retrain(runner, log, sync, lambda: built.append(1), [3, 4], min_changed=2, force=True)
    assert not row["skipped"] and built and row["stages"] == "3 4" and row["stages_ok"] == "4" and row["failed"] == 1
    assert ST.retrain(runner, log, only=[4])["mode"].startswith("retrain-only")
    assert spark.read.parquet(log).count() == 3


@pytest.fixture
def server():
    """A server on the loopback interface: what it answers, one after the other for each path, and what was asked."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            script = answers.get(self.path, [404])
            code = script.pop(0) if len(script) > 1 else script[0]
            body = f'{{"mal_id": {self.path[1:]}}}'.encode() if code == 200 else b""
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    answers, asked = {}, []
    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", answers, asked
    httpd.shutdown()


def test_http_source_waits_retries_and_gives_up(spark, server):
    import time

    from lodestone.sources.http import HttpSource

    base, answers, asked = server
    answers |= {"/1": [200], "/2": [429, 503, 200], "/3": [500], "/4": [403]}
    source = HttpSource(base, interval=0.05, retries=2, wait=0.01)
    began = time.monotonic()
    assert source.get(1) == '{"mal_id": 1}' and source.get(2) == '{"mal_id": 2}' and source.calls == 4
    assert time.monotonic() - began >= 0.15  # three intervals between four calls
    with pytest.raises(KeyError):
        source.get(99)
    with pytest.raises(RuntimeError, match="3 calls.*500"):
        source.get(3)
    with pytest.raises(Exception, match="403"):
        source.get(4)
    assert [asked.count(p) for p in ("/1", "/2", "/99", "/3", "/4")] == [1, 3, 1, 3, 1]
    with pytest.raises(RuntimeError):
        HttpSource("http://127.0.0.1:9", interval=0, retries=1, wait=0).get(1)
    ids = spark.createDataFrame([(1,), (2,), (2,), (3,), (99,), (None,)], "id long")
    got = {r.id: (r.json, r.error) for r in HttpSource(base, interval=0, retries=1, wait=0).table(ids, "id", 2).collect()}
    assert got[1] == ('{"mal_id": 1}', None) and got[2][1] is None and got[3][1].startswith("RuntimeError") and got[99] == (None, "KeyError: 99") and len(got) == 4


def test_binned_trees_are_those_of_rows(spark):
    """Sums of cells grow the trees that the rows themselves do; few jobs, whatever the rounds."""
    from lodestone.operators import binned

    df = spark.range(3000).select("id", F.floor(F.rand(1) * 20).cast("double").alias("a"), F.rand(2).alias("b"))
    df = df.withColumn("label", F.when(F.col("a") > 7, 3.0).otherwise(1.0) + F.col("b") + 0.01 * F.randn(3))
    df = CL.assemble(df, ["a", "b"]).cache()
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("boosting", "")
    fitted = G.boosting(rounds=60).fit(df)
    assert len(tracker.getJobIdsForGroup("boosting")) <= 12
    sc.setLocalProperty("spark.jobGroup.id", None)
    rows = df.select("a", "b", "label").collect()
    x, y = np.array([r[:2] for r in rows]), np.array([r.label for r in rows])
    bins = np.array([np.searchsorted(np.array(e), x[:, i], "left") for i, e in enumerate(fitted.edges)])
    width, at = [len(e) + 1 for e in fitted.edges], np.zeros(len(y))
    for i in range(60):
        tree = binned.grow(bins, width, np.ones(len(y)), y if i == 0 else 2 * (y - at), 4)
        at += (1.0 if i == 0 else 0.05) * tree.apply(bins)
    got = np.array([r.prediction for r in fitted.transform(df).select("prediction").collect()])
    assert np.allclose(got, at) and np.sqrt(np.mean((got - y) ** 2)) < 0.1
    # A first split by hand: that of all which leaves the least squared error.
    one = binned.grow(bins, width, np.ones(len(y)), y, 1)
    errors = {(f, c): sum(((v - v.mean()) ** 2).sum() for v in (y[bins[f] <= c], y[bins[f] > c])) for f in range(2) for c in range(width[f] - 1)}
    assert (one.feature[0], one.bin[0]) == min(errors, key=errors.get)
    forest = G.blend_models(key="id")["random_forest"]
    a, b = (np.array([r.prediction for r in forest.fit(part).transform(df).orderBy("id").select("prediction").collect()]) for part in (df, df.repartition(7)))
    assert np.allclose(a, b) and np.corrcoef(a, np.array([r.label for r in df.orderBy("id").select("label").collect()]))[0, 1] > 0.9
    n = np.concatenate([np.frombuffer(r.n) for r in binned._sums(binned._rows(df, "id", 42, "features", "label"), fitted.edges, 8, 0.9).collect()])
    assert abs(n.sum() / (8 * 3000) - 0.9) < 0.01
    two = CL.models(key="id")["random_forest"].fit(df.withColumn("label", (F.col("a") > 7).cast("double"))).transform(df)
    assert two.where((F.col("prediction") == 1) != (F.col("a") > 7)).count() == 0
    df.unpersist()


def test_learning_curve_fits_all_prefixes_at_once(spark, tmp_path):
    """Each size as if fitted by itself, in few jobs, whatever the sizes; null keys and labels, no test rows, no rows at all."""
    from lodestone.plans import all_queries

    df = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.floor(F.rand(1) * 20).cast("double").alias("a"), F.rand(2).alias("b"))
    df = CL.assemble(df.withColumn("label", F.when(F.col("a") > 7, 3.0).otherwise(1.0) + F.col("b") + 0.1 * F.randn(3)), ["a", "b"]).cache()
    train, test = df.where("id is null or id % 5 > 0"), df.where("id % 5 = 0").withColumn("label", F.when(F.col("id") > 50, F.col("label")))
    sizes, model = [1, 40, 500, 1200, 1201, train.count()], G.boosting(rounds=20)
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("curve", "")
    got = G.learning_curve(train, test, model, "id", sizes)
    assert len(tracker.getJobIdsForGroup("curve")) <= 20
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert [r["n"] for r in got] == sizes
    lines = G.learning_curve(train, test, G.models(df)["ols"], "id", sizes[3:])
    for rows, m in ((got, model), (lines, G.models(df)["ols"])):
        for r in rows:
            part = train.orderBy(S.seeded("id"), "id").limit(r["n"]).cache()
            fitted = m.fit(part)
            for k, on in (("train", part), ("test", test)):
                assert r[f"rmse_{k}"] == pytest.approx(G.metrics(fitted.transform(on), "label", "prediction").first().rmse, abs=2e-6)
    assert G.learning_curve(train, test.where("false"), model, "id", [40]) == [{"n": 40, "rmse_train": got[1]["rmse_train"], "rmse_test": None}]
    df.unpersist()
    assert G.curve_sizes(0) == [] and G.curve_sizes(700) == [700] and G.curve_sizes(2500) == [1000, 2000, 2500]
    assert G.curve_sizes(16044) == [*range(1000, 15437, 1604), 16044]
    for name in ("part", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert all_queries()["r11_learning_curve"](spark, str(tmp_path)).collect() == []
