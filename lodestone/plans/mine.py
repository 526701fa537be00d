"""Queries of mining: association, classification, regression, clustering, recommendation, live feed, row mutation, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
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
from lodestone.operators import stages as ST
from lodestone.operators import tables as TB
from lodestone.plans.prepare import cleaned, r6, segments
from lodestone.plans.registry import query, with_
from lodestone.sources import adapters as A
from lodestone.sources import files
from lodestone.streaming import live

# --- association --------------------------------------------------------------


def tag_lines(s: SparkSession, d: str) -> DataFrame:
    return cleaned(s, d).select(F.col("item_id").alias("basket"), F.explode("tags").alias("item"))


def _joined(c: str) -> F.Column:
    return F.array_join(c, "|")


TAG_SUPPORT, TYPE_SUPPORT = 0.012, 0.2
#: Itemsets of up to three items, level by level, of a CTE `lines` (basket, item) with n baskets.
ITEMSETS = {
    "own": "select distinct basket, item from lines",
    "one": "select [item] as items, count(*) as freq from own group by item having count(*) >= (select m from need)",
    "two": "select [a.item, b.item] as items, count(*) as freq from own a join own b on a.basket = b.basket and a.item < b.item group by a.item, b.item having count(*) >= (select m from need)",
    "three": "select [a.item, b.item, c.item] as items, count(*) as freq from own a join own b on a.basket = b.basket and a.item < b.item join own c on b.basket = c.basket and b.item < c.item group by a.item, b.item, c.item having count(*) >= (select m from need)",
    "itemsets": "select * from one union all select * from two union all select * from three",
}
_TAGS = {"lines": "select basket, item from taglines", "need": f"select {TAG_SUPPORT} * count(*) as m, count(*) as n from clean"}
_TYPES = {"lines": "select l_orderkey as basket, p_type as item from lineitem join part on l_partkey = p_partkey", "need": f"select {TYPE_SUPPORT} * count(distinct l_orderkey) as m, count(distinct l_orderkey) as n from lineitem"}
_FREQ = "select array_to_string(items, '|') as items, freq from itemsets"


@query("m1_fp_growth", with_("", _FREQ, **_TYPES, **ITEMSETS))
def m1(s, d):
    baskets = A.order_lines(s, d).groupBy("basket").agg(F.collect_set("item").alias("items"))
    return AS.fp_growth(baskets, 0, TYPE_SUPPORT, 3).select(_joined("items").alias("items"), "freq")


@query("m2_j11_level_wise", with_("taglines", _FREQ, **_TAGS, **ITEMSETS))
def m2(s, d):
    return AS.level_wise(tag_lines(s, d), cleaned(s, d).count(), TAG_SUPPORT, 3).select(_joined("items").alias("items"), "freq")


_SIDES = """select i.items, i.freq, list_filter(i.items, lambda x, k: (m.mask >> (k - 1)) & 1 = 1) as a, list_filter(i.items, lambda x, k: (m.mask >> (k - 1)) & 1 = 0) as c
    from itemsets i, (select unnest(range(1, 7)) as mask) m where len(i.items) > 1 and m.mask < (1 << len(i.items)) - 1"""
_RULES = """select array_to_string(s.a, '|') as antecedent, array_to_string(s.c, '|') as consequent, s.freq / n.n as s, a.freq / n.n as sa, c.freq / n.n as sc, len(s.items) as k
    from sides s join itemsets a on a.items = s.a join itemsets c on c.items = s.c, need n"""
_MEASURES = """select antecedent, consequent, round(s, 6) as support, round(s / sa, 6) as confidence, round(s / sa / sc, 6) as lift, round(s - sa * sc, 6) as leverage,
    round(case when s / sa >= 1 then -1 else (1 - sc) / (1 - s / sa) end, 6) as conviction, round((s - sa * sc) / greatest(s * (1 - sa), sa * (sc - s)), 6) as zhang,
    round(s / (sa + sc - s), 6) as jaccard, round((s / sa - sc) / (1 - sc), 6) as certainty, round((s / sa + s / sc) / 2, 6) as kulczynski, cast(k as integer) as n_items from rules"""


def _measured(r: DataFrame) -> DataFrame:
    names = ("support", "confidence", "lift", "leverage", "zhang", "jaccard", "certainty", "kulczynski")
    conviction = F.when(F.col("conviction") == float("inf"), -1.0).otherwise(F.col("conviction"))
    return r.select(_joined("antecedent").alias("antecedent"), _joined("consequent").alias("consequent"), *r6(*names), F.round(conviction, 6).alias("conviction"), "n_items")


@query("m3_m4_m5_m6_rule_measures", with_("taglines", _MEASURES + " where s / sa >= 0.1 and s / sa / sc >= 1.05", **_TAGS, **ITEMSETS, sides=_SIDES, rules=_RULES))
def m3(s, d):
    n = cleaned(s, d).count()
    return _measured(AS.rules(AS.level_wise(tag_lines(s, d), n, TAG_SUPPORT, 3), n, 0.10, 1.05, 3))


@query("m3_dense_rules", with_("", _MEASURES, **_TYPES, **ITEMSETS, sides=_SIDES, rules=_RULES))
def m3_dense(s, d):
    lines = A.order_lines(s, d)
    n = A.table(s, d, "lineitem").select("l_orderkey").distinct().count()
    return _measured(AS.rules(AS.level_wise(lines, n, TYPE_SUPPORT, 3), n, 0.0, 0.0, 3))


@query("m7_rule_text", with_("taglines", "select array_to_string(list_sort(s.a), ', ') || ' -> ' || array_to_string(list_sort(s.c), ', ') as rule, cast(len(s.items) as integer) as n_items from sides s", **_TAGS, **ITEMSETS, sides=_SIDES))
def m7(s, d):
    n = cleaned(s, d).count()
    r = AS.rules(AS.level_wise(tag_lines(s, d), n, TAG_SUPPORT, 3), n, 0.0, 0.0, 3)
    return r.select(F.concat(S.pretty("antecedent"), F.lit(" -> "), S.pretty("consequent")).alias("rule"), "n_items")


query("p18_rule_filter", with_("taglines", "select antecedent, consequent, round(s / sa / sc, 6) as lift from rules where s / sa / sc >= 1.2 and s / sa >= 0.12 and k <= 2", **_TAGS, **ITEMSETS, sides=_SIDES, rules=_RULES))(
    lambda s, d: (lambda n: AS.rules(AS.level_wise(tag_lines(s, d), n, TAG_SUPPORT, 2), n, 0.12, 1.2, 2).select(_joined("antecedent").alias("antecedent"), _joined("consequent").alias("consequent"), *r6("lift")))(cleaned(s, d).count()))


#: Supports at which the two miners are compared.
SUPPORTS = (0.2, 0.22, 0.25, 0.3)
_SUPPORTS = " union all ".join(f"select cast({x} as double) as ms" for x in SUPPORTS)


@query("m8_miners", with_("", f"select ms as min_support, (select count(*) from itemsets where freq >= ms * (select n from need)) as itemsets, true as same from ({_SUPPORTS}) s", **_TYPES, **ITEMSETS))
def m8(s, d):
    lines = A.order_lines(s, d)
    n = lines.select("basket").distinct().count()
    rows = AS.compare_miners(lines, n, SUPPORTS)
    return s.createDataFrame([(r["min_support"], r["fp_growth_itemsets"], r["fp_growth_itemsets"] == r["level_wise_itemsets"]) for r in rows], "min_support double, itemsets long, same boolean")


_NAMED = f"select antecedent, consequent, round(s / sa / sc, 6) as lift from rules where s / sa / sc >= {AS.TAG_DEFAULTS['min_lift']} and s / sa >= 0.1"
_LOW = {"lines": "select basket, item from taglines", "need": "select 0.012 * count(*) as m, count(*) as n from clean"}
query("m9_tag_rules", with_("taglines", _NAMED, **_LOW, **ITEMSETS, sides=_SIDES, rules=_RULES))(
    lambda s, d: AS.mine_tags(cleaned(s, d), min_support=0.012, min_confidence=0.1).select(_joined("antecedent").alias("antecedent"), _joined("consequent").alias("consequent"), *r6("lift")))


@query("p14_m9_user_rules", "select true as enough, '10000000 are needed' as needed")
def p14(s, d):
    """The rules of users' favourites, and the error where there are too few baskets."""
    favourites = R.favourites(A.ratings(s, d), cleaned(s, d))
    baskets = favourites.groupBy("user_id").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    enough = AS.mine_users(baskets, min_baskets=3).count() >= 0
    try:
        AS.mine_users(baskets, min_baskets=10_000_000)
        needed = ""
    except ValueError as e:
        needed = str(e).split("; ")[1]
    return s.createDataFrame([(enough, needed)], "enough boolean, needed string")


# --- classification -----------------------------------------------------------

ATTRIBUTES = ("lang", "source", "length")
_OUT = "select id, cast(actual as varchar) as actual, lang, source, case when n_chars <= 500 then 'short' when n_chars <= 2000 then 'mid' else 'long' end as length from outcome"


def labelled(s: SparkSession, d: str) -> DataFrame:
    length = F.when(F.col("n_chars") <= 500, "short").when(F.col("n_chars") <= 2000, "mid").otherwise("long")
    return A.outcome(s, d).select("id", F.col("actual").cast("string").alias("actual"), "lang", "source", length.alias("length"))


_GAIN = """select attribute, round(h - rest, 6) as info_gain, round(info, 6) as split_info, round(case when h > 0 and info > 0 then (h - rest) / info else 0 end, 6) as gain_ratio from (
    select b.attribute, (select -sum(n / t * log2(n / t)) from (select count(*) as n, (select count(*) from lab) as t from lab group by actual) y) as h,
      -sum(nb / nt * log2(nb / nt)) as info, (select -sum(n / nt * log2(n / nb)) from cells c where c.attribute = b.attribute) as rest from bins b group by b.attribute) z"""
_CELLS = "select attribute, bin, actual, count(*) as n, sum(count(*)) over (partition by attribute, bin) as nb, sum(count(*)) over (partition by attribute) as nt from long group by 1, 2, 3"
_LONG = " union all ".join(f"select id, actual, '{a}' as attribute, {a} as bin from lab" for a in ATTRIBUTES)
query("c1_c2_gain_ratio", with_("outcome", _GAIN, lab=_OUT, long=_LONG, cells=_CELLS, bins="select distinct attribute, bin, nb, nt from cells"))(
    lambda s, d: CL.gain_ratios(labelled(s, d), ATTRIBUTES, "actual"))


def _tree(s, d, **kw):
    return CL.GainRatioTree(max_depth=3, min_split=20, min_leaf=5, **kw).fit(labelled(s, d), ATTRIBUTES, "actual")


@query("c3_c5_gain_ratio_tree")
def c3(s, d):
    return _tree(s, d).predict(labelled(s, d)).select("id", "actual", "predicted")


@query("c4_pruned_tree")
def c4(s, d):
    return _tree(s, d, prune=True).predict(labelled(s, d)).groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def c5_shares(s, d):
    """Shares of the classes in the leaf of each row, by the tree."""
    return _tree(s, d).predict_proba(labelled(s, d)).select("id", "actual", F.round(F.col("probability")["0"], 6).alias("p0"), F.round(F.col("probability")["1"], 6).alias("p1"))


#: The first split: the attribute with the best gain ratio, if all of its branches have five rows or more; the first named of ties.
_FIRST = """select a as attribute, case when least_n >= 5 and ratio > 0 then true else false end as split from (
    select attribute as a, (select min(nb) from bins b where b.attribute = g.attribute) as least_n, gain_ratio as ratio from gains g where (select count(*) from bins b where b.attribute = g.attribute) > 1
    order by gain_ratio desc, case attribute when 'lang' then 0 when 'source' then 1 else 2 end limit 1) z"""
_STUMP = dict(lab=_OUT, long=_LONG, cells=_CELLS, bins="select distinct attribute, bin, nb, nt from cells", gains=_GAIN)


@query("c3_first_split", with_("outcome", _FIRST, **_STUMP))
def c3_first(s, d):
    lab = labelled(s, d)
    best = CL.gain_ratios(lab, ATTRIBUTES, "actual").withColumn("order", F.expr("case attribute when 'lang' then 0 when 'source' then 1 else 2 end"))
    name = best.orderBy(F.desc("gain_ratio"), "order").first().attribute
    tree = CL.GainRatioTree(max_depth=1, min_split=2, min_leaf=5).fit(lab, ATTRIBUTES, "actual")
    return s.createDataFrame([(tree.root.attribute or name, bool(tree.root.children))], "attribute string, split boolean")


query("c5_leaf_shares")(c5_shares)
query("c5_c16_tree_auc")(lambda s, d: CL.auc_one_vs_rest(c5_shares(s, d), "actual", {"0": "p0", "1": "p1"}))
_MEANS = "select n_chars, actual, case when n_chars <= e1 then 0 else 1 end as bin from outcome, (select round(median(n_chars), 6) as e1 from outcome) e"
query("c3_numeric_bins", with_("outcome", "select cast(bin as varchar) as bin, cast(actual as varchar) as actual, count(*) as n from halves group by 1, 2", halves=_MEANS))(
    lambda s, d: (lambda o, t: (t._choose(o, ["n_chars"]), o.select(t._bin("n_chars").alias("bin"), F.col("actual").cast("string").alias("actual")).groupBy("bin", "actual").agg(F.count(F.lit(1)).alias("n")))[1])(A.outcome(s, d), CL.GainRatioTree(bins=2)))
query("c6_tree_rules")(lambda s, d: s.createDataFrame(_tree(s, d).rules(0.0)))
query("c7_tree_text")(lambda s, d: (lambda t: s.createDataFrame([(k, str(v)) for k, v in t.stats().items()] + [("text", t.text())], "metric string, value string"))(_tree(s, d)))
query("c8_tree_importance")(lambda s, d: s.createDataFrame(_tree(s, d).importance()))


def _model_frame(s, d):
    c = cleaned(s, d).withColumn("label", (F.col("rating") > 5).cast("double"))
    return C.split(CL.assemble(c, ["members_log", "episodes_log", "genre_count"], "label"), "item_id")


def _fitted(name):
    def run(s, d):
        df = _model_frame(s, d)
        out = CL.models(key="item_id")[name].fit(df.where("split <> 'test'")).transform(df.where("split = 'test'"))
        return CL.macro_metrics(out.select(F.col("label").cast("int").alias("a"), F.col("prediction").cast("int").alias("p")), "a", "p")

    return run


query("c9_entropy_tree")(_fitted("entropy_tree"))
query("c10_random_forest")(_fitted("random_forest"))
query("c11_gaussian_nb")(_fitted("gaussian_nb"))
query("c11_gaussian_moments", with_("clean", " union all ".join(f"select type as y, '{f}' as feature, count({f}) as n, round(avg({f}), 6) as mean, round(var_pop({f}), 6) as variance from clean group by type" for f in ("rating", "members_log"))))(
    lambda s, d: CL.gaussian_moments(cleaned(s, d), ["rating", "members_log"], "type"))
_NB = """select a.y, a.attribute, a.bin, round(ln((coalesce(n, 0) + 1) / (ny + 2)), 6) as log_yes from
    (select p.y, p.ny, g.attribute, g.bin from priors p, (select distinct attribute, bin from long) g) a left join (select attribute, bin, actual, count(*) as n from long group by 1, 2, 3) c
    on c.attribute = a.attribute and c.bin = a.bin and c.actual = a.y"""
_LIKE = """select a.y, a.attribute, a.bin, (coalesce(n, 0) + 1) / (ny + 2) as p from (select p.y, p.ny, g.attribute, g.bin from priors p, (select distinct attribute, bin from long) g) a
    left join (select attribute, bin, actual, count(*) as n from long group by 1, 2, 3) c on c.attribute = a.attribute and c.bin = a.bin and c.actual = a.y"""
_SCORES = """select l.id, k.y, round((select ln(p.ny / (select sum(ny) from priors)) from priors p where p.y = k.y) + sum(case when k.bin = l.bin then ln(k.p) else ln(1 - k.p) end), 9) as score
    from long l join likes k on k.attribute = l.attribute group by l.id, k.y"""
query("c12_nb_likelihoods", with_("outcome", _NB, lab=_OUT, long=_LONG, priors="select actual as y, count(*) as ny from lab group by 1"))(
    lambda s, d: CL.categorical_nb(labelled(s, d), ATTRIBUTES, "actual")[1].select("y", "attribute", "bin", *r6("log_yes")))


def nb_predictions(s, d):
    lab = labelled(s, d)
    return lab.select("id", "actual").join(CL.apply_categorical_nb(lab, "id", ATTRIBUTES, *CL.categorical_nb(lab, ATTRIBUTES, "actual")), "id")


_PRED = dict(lab=_OUT, long=_LONG, priors="select actual as y, count(*) as ny from lab group by 1", likes=_LIKE, scores=_SCORES, pred="select l.id, l.actual, p.predicted from lab l join (select id, arg_max(y, (score, y)) as predicted from scores group by id) p on p.id = l.id")
query("c12_nb_predictions", with_("outcome", "select id, actual, predicted from pred", **_PRED))(lambda s, d: nb_predictions(s, d).select("id", "actual", "predicted"))
query("c13_majority", with_("outcome", "select cast(actual as varchar) as label, count(*) as n from outcome group by 1 order by n desc, label limit 1"))(lambda s, d: CL.majority(A.outcome(s, d), "actual"))
_REP = """select k as class, (select count(*) from pred where actual = k and predicted = k) as tp, (select count(*) from pred where predicted = k) as np, (select count(*) from pred where actual = k) as na
    from (select actual as k from pred union select predicted from pred) u"""
_PRF = "select class, na, tp, case when np > 0 then tp / np else 0.0 end as p, case when na > 0 then tp / na else 0.0 end as r from rep"
_F1 = "case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end"
query("c14_macro_metrics", with_("outcome", f"select round(sum(tp) / sum(na), 6) as accuracy, round(avg(p), 6) as macro_precision, round(avg(r), 6) as macro_recall, round(avg({_F1}), 6) as macro_f1 from prf", **_PRED, rep=_REP, prf=_PRF))(
    lambda s, d: CL.macro_metrics(nb_predictions(s, d), "actual", "predicted"))
query("c15_class_report", with_("outcome", f"select class, round(p, 6) as precision, round(r, 6) as recall, round({_F1}, 6) as f1, cast(na as bigint) as support from prf", **_PRED, rep=_REP, prf=_PRF))(
    lambda s, d: CL.class_report(nb_predictions(s, d), "actual", "predicted").select("class", *r6("precision", "recall", "f1"), F.col("support").cast("long").alias("support")))
query("a16_confusion", with_("outcome", "select actual, count(*) filter (where predicted = '0') as pred_0, count(*) filter (where predicted = '1') as pred_1 from pred group by actual", **_PRED))(
    lambda s, d: CL.confusion(nb_predictions(s, d), "actual", "predicted", ["0", "1"]))
query("c16_auc", with_("outcome", """select '1' as class, round((sum(case when actual = 1 then rk else 0 end) - p * (p + 1) / 2) / (p * (n - p)), 6) as auc from (
    select actual, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2 as rk, sum(actual) over () as p, count(*) over () as n from outcome) a group by p, n"""))(
    lambda s, d: CL.auc_one_vs_rest(A.outcome(s, d), "actual", {"1": "n_chars"}))


@query("c17_model_table")
def c17(s, d):
    """All models: metrics on the test part, accuracy over five folds of the rest, and the area under the curve."""
    df = G.sized(_model_frame(s, d), "item_id").cache()
    train, test = C.folds(df.where("split <> 'test'"), "item_id", stratify="label").cache(), df.where("split = 'test'")
    tree = CL.TreeModel(["type", "members_band", "episodes_band", "genre_count"], max_depth=6)
    rows = CL.compare_models(train, test, {"majority": CL.Majority(), "gain_ratio_tree": tree, **CL.models(key="item_id")}, 5)
    train.unpersist()
    df.unpersist()
    return s.createDataFrame(rows, "model string, accuracy double, macro_precision double, macro_recall double, macro_f1 double, cv_accuracy double, auc double")


# --- regression ---------------------------------------------------------------

_LINE = "select regr_slope(rating, members_log) as b, regr_intercept(rating, members_log) as a from clean"
_MET = """count(*) as n, round(avg(y), 6) as mean_actual, round(avg(p), 6) as mean_predicted, round(avg(abs(y - p)), 6) as mae, round(sqrt(avg((y - p) * (y - p))), 6) as rmse,
    round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) + 0.0 as r2, round(100 * avg(abs(y - p) / greatest(abs(y), 1e-9)), 2) as mape"""
_PREDICTED = "select c.item_id, c.type, c.rating as y, l.a + l.b * c.members_log as p from clean c, line l"


def predictions(s, d):
    c = cleaned(s, d)
    line = c.agg(F.regr_slope("rating", "members_log").alias("b"), F.regr_intercept("rating", "members_log").alias("a"))
    return c.join(F.broadcast(line)).select("item_id", "type", F.col("rating").alias("y"), (F.col("a") + F.col("b") * F.col("members_log")).alias("p"), F.col("members_log"))


query("r1_mean_baseline", with_("clean", f"select {_MET} from x", x="select rating as y, (select avg(rating) from clean) as p from clean"))(
    lambda s, d: (lambda c: G.metrics(c.join(F.broadcast(c.agg(F.avg("rating").alias("p")))), "rating", "p"))(cleaned(s, d).select("rating")))
query("r2_line", with_("clean", "select round(regr_slope(rating, members_log), 6) as slope, round(regr_intercept(rating, members_log), 6) as intercept, round(regr_r2(rating, members_log), 6) as r2 from clean"))(
    lambda s, d: G.line(cleaned(s, d), "rating", "members_log"))
query("r7_metrics", with_("clean", f"select {_MET} from x", line=_LINE, x=_PREDICTED))(lambda s, d: G.metrics(predictions(s, d), "y", "p"))
query("r9_residuals", with_("clean", "select item_id, round(y, 6) as y, round(p, 6) as p, round(y - p, 6) as residual from x", line=_LINE, x=_PREDICTED))(
    lambda s, d: G.residuals(predictions(s, d), "y", "p").select("item_id", *r6("y", "p", "residual")))
query("r10_a17_by_type", with_("clean", f"select type, {_MET} from x group by type", line=_LINE, x=_PREDICTED))(lambda s, d: G.metrics(predictions(s, d), "y", "p", "type"))
_BLEND = "select round(w / 50.0, 6) as weight, round(sum(power(y - (w / 50.0 * p + (1 - w / 50.0) * q), 2)), 6) as sse from (select unnest(range(0, 51)) as w) g, (select y, p, (select avg(y) from x) as q from x) z group by w order by sse, weight limit 1"
query("b2_blend", with_("clean", _BLEND, line=_LINE, x=_PREDICTED))(
    lambda s, d: (lambda p: G.blend(p.join(F.broadcast(p.agg(F.avg("y").alias("q")))), "p", "q", "y"))(predictions(s, d)))
_TIER = "case when {0} >= 0 then case when {0} < 6.1 then 'Low' when {0} < 6.8 then 'Medium' when {0} < 7.3 then 'High' when {0} < 11 then 'Top' end end"
query("b5_interval", with_("clean", "select item_id, round(q, 4) as score, " + _TIER.format("q") + " as tier, round(least(greatest(q - 1.96 * 0.65, 1), 10), 4) as low, round(least(greatest(q + 1.96 * 0.65, 1), 10), 4) as high from (select item_id, least(greatest(p * 1.3, 1), 10) as q from x) a", line=_LINE, x=_PREDICTED))(
    lambda s, d: predictions(s, d).select("item_id", *[v.alias(k) for k, v in G.interval(F.col("p") * 1.3, 0.65).items()]))
_IMP = "select p_type as name, round(sum(p_retailprice), 4) as importance from part group by 1"
query("r12_w4_importance", with_("", "select name, importance, cast(row_number() over (order by importance desc, name) as integer) as rank, round(sum(importance) over (order by importance desc, name rows unbounded preceding) / sum(importance) over (), 6) as cumulative from imp", imp=_IMP))(
    lambda s, d: G.ranked(A.table(s, d, "part").groupBy(F.col("p_type").alias("name")).agg(F.round(F.sum("p_retailprice"), 4).alias("importance"))))


FEATURES = ["members_log", "episodes_log", "genre_count"]


def _parts(s, d) -> DataFrame:
    return C.split(CL.assemble(cleaned(s, d), FEATURES).withColumn("label", F.col("rating")), "item_id")


def _regression(s, d) -> DataFrame:
    return G.sized(_parts(s, d), "item_id")


def _regressor(name):
    def run(s, d):
        df = _regression(s, d).cache()
        train = df.where("split <> 'test'")
        out = G.metrics(G.models(train)[name].fit(train).transform(df.where("split = 'test'")), "label", "prediction")
        rows = s.createDataFrame(out.collect(), out.schema)
        df.unpersist()
        return rows

    return run


for _name, _id in (("ols", "r2_ols"), ("ridge", "r3_ridge"), ("tree", "r4_tree"), ("random_forest", "r5_random_forest"), ("gbt", "r6_gbt")):
    query(_id)(_regressor(_name))
#: A ridge line of one feature in closed form: slope = cov / (var + 1 / n), and the mean is met.
_RIDGE = "select round(b, 6) as slope, round(my - b * mx, 6) as intercept from (select covar_pop(rating, members_log) / (var_pop(members_log) + 1.0 / count(*)) as b, avg(rating) as my, avg(members_log) as mx from clean) z"


@query("r3_ridge_line", with_("clean", _RIDGE))
def r3(s, d):
    df = CL.assemble(cleaned(s, d), ["members_log"]).withColumn("label", F.col("rating"))
    m = G.ridge(df, "label").fit(df)
    return s.createDataFrame([(round(float(m.coefficients[0]), 6), round(float(m.intercept), 6))], "slope double, intercept double")


_FOLD = "cast(concat('0x', substr(md5('42:' || item_id), 1, 8)) as bigint) % 5"
_CV = f"select round(avg(e), 6) as cv_rmse from (select t.fold, sqrt(avg(power(t.y - (l.a + l.b * t.x), 2))) as e from points t join lines l on l.fold = t.fold group by t.fold) z"
_FOLD_LINES = "select f.fold, regr_slope(y, x) as b, regr_intercept(y, x) as a from points p join (select distinct fold from points) f on p.fold <> f.fold group by f.fold"


@query("r8_cv_rmse", with_("clean", _CV, points=f"select {_FOLD} as fold, rating as y, members_log as x from clean", lines=_FOLD_LINES))
def r8(s, d):
    df = C.folds(CL.assemble(cleaned(s, d), ["members_log"]).withColumn("label", F.col("rating")), "item_id")
    return s.createDataFrame([(round(G.cross_validated_rmse(df, G.models(df)["ols"]), 6),)], "cv_rmse double")


@query("r8_model_table")
def r8_table(s, d):
    """Least squares, ridge, tree and forest: metrics on the test part, and RMSE over five folds of the rest."""
    df = _regression(s, d).cache()
    train = C.folds(df.where("split <> 'test'"), "item_id")
    which = {k: m for k, m in G.models(train).items() if k != "gbt"}
    rows = G.compare(train, df.where("split = 'test'"), which, k=5)
    df.unpersist()
    return s.createDataFrame([(r["model"], r["rmse"], r["mae"], r["r2"], r["cv_rmse"]) for r in rows], "model string, rmse double, mae double, r2 double, cv_rmse double")


@query("r12_model_importance")
def r12(s, d):
    """The forest's impurity importances, ranked, with the cumulative share."""
    train = _regression(s, d).where("split <> 'test'")
    found = G.importances(G.models(train)["random_forest"].fit(train), FEATURES)
    return G.ranked(s.createDataFrame(found, "name string, importance double"))


@query("r13_tree_text")
def r13(s, d):
    """The regression tree as text, one row a line."""
    train = _regression(s, d).where("split <> 'test'")
    text = G.models(train)["tree"].fit(train).toDebugString.rstrip("\n")
    return s.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")


@query("r11_learning_curve")
def r11(s, d):
    """Boosting on the first 1,000 rows and on, in steps of a tenth of all, at least 1,000, and on all rows."""
    df = files.scratch_table(_parts(s, d).select("item_id", "features", "label", "split"))
    train = df.where("split <> 'test'")
    sizes = G.curve_sizes(train.count())
    rows = G.learning_curve(train, df.where("split = 'test'"), G.boosting(), "item_id", sizes) if sizes else []
    return s.createDataFrame([(r["n"], r["rmse_test"], r["rmse_train"]) for r in rows], "n long, rmse_test double, rmse_train double")


# --- clustering ---------------------------------------------------------------


def _points(s, d):
    """Embeddings with the label as a fixed cluster."""
    return A.vectors(s, d).select("id", F.col("label").alias("cluster"), "x")


query("k1_matrix", with_("clean", "select item_id, round((rating - (select avg(rating) from clean)) / (select stddev_pop(rating) from clean), 6) as z0, round((members_log - (select avg(members_log) from clean)) / (select stddev_pop(members_log) from clean), 6) as z1 from clean"))(
    lambda s, d: K.matrix(cleaned(s, d), "item_id", ["rating", "members_log"]).select("item_id", F.round(F.get("x", F.lit(0)), 6).alias("z0"), F.round(F.get("x", F.lit(1)), 6).alias("z1")))
_ASSIGN = "select p.id, arg_min(c.label, (c.d, c.label)) as cluster from (select p.id, c.label, round(sum((p.v - c.m) * (p.v - c.m)), 9) as d from dims p join (select label, dim, avg(v) as m from dims group by 1, 2) c on c.dim = p.dim group by 1, 2) c join vecs p on p.id = c.id group by p.id"


@query("k2_k3_lloyd_step", with_("dims", _ASSIGN))
def k2(s, d):
    p = _points(s, d)
    c = K.centroids(p).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda v: v["mean"]).alias("c"))
    rows = c.orderBy("cluster").collect()  # one per cluster
    out = K.assign(p.select("id", "x"), [r.c for r in rows])
    numbers = F.array(*[F.lit(r.cluster) for r in rows])
    return out.select("id", F.get(numbers, F.col("cluster")).alias("cluster"))


@query("k2_kmeans")
def k2_kmeans(s, d):
    m = K.matrix(cleaned(s, d), "item_id", ["rating", "members_log", "episodes_log"])
    model, _ = K.kmeans(m, 4)
    out = K.assign(m, [c.tolist() for c in model.clusterCenters()])
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d2"), 4).alias("inertia"))


_SIL = """select round(avg(s), 6) as score from (select i, case when a is null or b is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end as s from (
    select i, min(case when li = lj then d end) as a, min(case when li <> lj then d end) as b from (select i, li, lj, avg(d) as d from (
    select p.id as i, q.id as j, p.label as li, q.label as lj, sqrt(sum((p.v - q.v) * (p.v - q.v))) as d from few p join few q on p.dim = q.dim and p.id <> q.id group by 1, 2, 3, 4) a group by 1, 2, 3) b group by i) c) e"""
query("k4_silhouette", with_("dims", _SIL, few="select d.* from dims d join (select id from vecs order by md5('42:' || id), id limit 5000) k on k.id = d.id"))(
    lambda s, d: K.silhouette(_points(s, d), "id"))
_CENT = dict(cent="select label, dim, avg(v) as m, count(*) as n from dims group by 1, 2", dist="select p.id, p.label, sum((p.v - c.m) * (p.v - c.m)) as d2 from dims p join cent c on c.label = p.label and c.dim = p.dim group by 1, 2")
_CH = "select round((b / (k - 1)) / (w / (n - k)), 6) as score from (select (select sum(c.n * (c.m - g.m) * (c.m - g.m)) from cent c join (select dim, avg(v) as m from dims group by 1) g on g.dim = c.dim) as b, (select count(distinct label) from cent) as k, (select sum(d2) from dist) as w, (select count(*) from dist) as n) a"
query("k5_calinski_harabasz", with_("dims", _CH, **_CENT))(lambda s, d: K.calinski_harabasz(_points(s, d)))
_DB = "select round(avg(r), 6) as score from (select a.label, max((a.s + b.s) / sqrt(ab.d)) as r from spread a join spread b on a.label <> b.label join (select x.label as la, y.label as lb, sum((x.m - y.m) * (x.m - y.m)) as d from cent x join cent y on x.dim = y.dim group by 1, 2) ab on ab.la = a.label and ab.lb = b.label group by a.label) z"
query("k5_davies_bouldin", with_("dims", _DB, **_CENT, spread="select label, avg(sqrt(d2)) as s from dist group by 1"))(lambda s, d: K.davies_bouldin(_points(s, d)))
_CURVE = "select p_size as k, sum(p_retailprice) / p_size as inertia from part where p_size between 2 and 8 group by 1"
query("k6_k7_w8_elbow", with_("", "select k, round(inertia, 6) as inertia, round(abs((x1 - x0) * (inertia - y0) - (y1 - y0) * (k - x0)), 6) as distance from curve, (select min(k) as x0, max(k) as x1, arg_min(inertia, k) as y0, arg_max(inertia, k) as y1 from curve) e", curve=_CURVE))(
    lambda s, d: K.elbow(A.table(s, d, "part").where("p_size between 2 and 8").groupBy(F.col("p_size").alias("k")).agg((F.sum("p_retailprice") / F.first("p_size")).alias("inertia"))))
query("k6_k_sweep")(lambda s, d: s.createDataFrame(K.k_selection(_points(s, d), "id")))


@query("k7_best_k", with_("", "select arg_max(k, (distance, -k)) as k, 'elbow' as why from (select k, round(abs((x1 - x0) * (inertia - y0) - (y1 - y0) * (k - x0)), 6) as distance from curve, (select min(k) as x0, max(k) as x1, arg_min(inertia, k) as y0, arg_max(inertia, k) as y1 from curve) e) z", curve=_CURVE))
def k7(s, d):
    curve = A.table(s, d, "part").where("p_size between 2 and 8").groupBy(F.col("p_size").alias("k")).agg((F.sum("p_retailprice") / F.first("p_size")).alias("inertia"))
    k, why = K.best_k([r.asDict() for r in K.elbow(curve).collect()])  # one row for each k
    return s.createDataFrame([(k, why.split(";")[0])], "k int, why string")
query("k8_ward")(lambda s, d: K.ward(_points(s, d), "id", 4).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))


@query("k9_dendrogram")
def k9(s, d):
    import numpy as np

    rows = C.sample(_points(s, d), "id", K.WARD_SAMPLE).collect()  # a bounded sample
    merges = K.ward_merges(np.array([r.x for r in rows], float))
    return s.createDataFrame([(int(a), int(b), float(x), int(n)) for a, b, x, n in merges[-12:]], "a long, b long, distance double, size long")


query("k10_pca")(lambda s, d: K.project(_points(s, d), "id").agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_pop("pc1"), 4).alias("spread1"), F.round(F.stddev_pop("pc2"), 4).alias("spread2")))
query("a13_k11_profile", with_("clean", "select cast(item_id % 4 as integer) as cluster, count(*) as n, round(avg(rating), 6) as mean_rating, round(avg(members_log), 6) as mean_members_log, round(100.0 * count(*) / (select count(*) from clean), 4) as share_pct from clean group by 1"))(
    lambda s, d: K.profile(cleaned(s, d).withColumn("cluster", (F.col("item_id") % 4).cast("int")), ["rating", "members_log"]))
query("a14_top_values", with_("clean", "select cluster, string_agg(type || ' (' || n || ')', ', ' order by r) as top from (select *, row_number() over (partition by cluster order by n desc, type) as r from (select cast(item_id % 4 as integer) as cluster, type, count(*) as n from clean group by 1, 2) a) b where r <= 3 group by cluster"))(
    lambda s, d: K.top_values(cleaned(s, d).withColumn("cluster", (F.col("item_id") % 4).cast("int")), "type"))
query("w3_tiers", with_("", "select name as cluster, case least(floor((r - 1) / greatest(n / 3, 1)), 2) when 0 then 'low' when 1 then 'mid' else 'high' end as tier from (select name, row_number() over (order by importance, name) as r, count(*) over () as n from imp) a", imp=_IMP))(
    lambda s, d: K.tiers(A.table(s, d, "part").groupBy(F.col("p_type").alias("cluster")).agg(F.round(F.sum("p_retailprice"), 4).alias("importance")), "importance").select("cluster", "tier"))
query("w6_variants", "select s_suppkey as cluster, case when r > 1 then name || ' (variant ' || r || ')' else name end as name from (select s_suppkey, 'nation ' || s_nationkey as name, row_number() over (partition by s_nationkey order by s_suppkey) as r from supplier) a")(
    lambda s, d: K.variants(A.table(s, d, "supplier").select(F.col("s_suppkey").alias("cluster"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("name")), "name"))
query("k12_cube", with_("clean", "select cast(item_id % 4 as integer) as cluster, " + ", ".join(f"count(*) filter (where score_tier = '{t}') as {t}" for _, t in S.TIERS) + " from clean group by 1"))(
    lambda s, d: R.crosstab(cleaned(s, d).withColumn("cluster", (F.col("item_id") % 4).cast("int")), "cluster", "score_tier", [t for _, t in S.TIERS]))

# --- recommendation -----------------------------------------------------------


def recommender(s, d, rules=None):
    r, seg, c = A.ratings(s, d), segments(s, d), cleaned(s, d)
    return B.Recommender(c, R.affinity(r, seg, c), R.affinity(r, seg, c, "type"), rules)


_GENRE = "select primary_genre as genre, avg(affinity) as affinity from (select segment, primary_genre, avg(rating) as affinity from segmented group by 1, 2) a group by 1"
_TYPE = "select type, avg(affinity) as affinity from (select segment, type, avg(rating) as affinity from segmented group by 1, 2) a group by 1"
_SCORE = """select item_id, round(0.30 * (coalesce(a, 7) - 7) + 0.18 * (coalesce(ta, 7) - 7) + 0.20 * z + 0.18 * (rating - tm) + 0.14 * least(greatest((ln(1 + members) - ln(1 + mm)) / 5, -1), 1.5), 6) as match_score from (
    select c.*, g.affinity as a, t.affinity as ta, m.tm, (c.rating - avg(c.rating) over ()) / stddev_pop(c.rating) over () as z, median(c.members) over () as mm
    from cand c left join genre g on g.genre = c.primary_genre left join types t on t.type = c.type left join (select type, avg(rating) as tm from clean group by 1) m on m.type = c.type) z"""
_CAND = "select * from clean where members >= 1000"


def _ranked(cand: str, genre: str, types: str, where: str = "") -> str:
    return with_("segmented", f"select item_id, match_score, cast(row_number() over (order by match_score desc, item_id) as integer) as rank from scored {where} order by rank limit 10", cand=cand, genre=genre, types=types, scored=_SCORE)


_SEG = "select primary_genre as genre, avg(rating) as affinity from segmented where segment = 2 group by 1"
query("b9_b10_by_segment", _ranked(_CAND, _SEG, "select type, avg(rating) as affinity from segmented where segment = 2 group by 1"))(
    lambda s, d: recommender(s, d).by_segment(2).select("item_id", "match_score", "rank"))
query("b7_w7_match_scores", with_("segmented", "select item_id, match_score from scored", cand=_CAND, genre=_GENRE, types=_TYPE, scored=_SCORE))(
    lambda s, d: (lambda r: B.score(r.titles, r._genre(None), r._types(None), r.means).select("item_id", "match_score"))(recommender(s, d)))
_BOOSTED = "select coalesce(g.genre, c.genre) as genre, case when c.genre is not null then least(coalesce(g.affinity, 7) + {by}, 10) else g.affinity end as affinity from (" + _GENRE + ") g full join ({chosen}) c on c.genre = g.genre"
query("b11_by_preferences", _ranked("select * from clean where members >= 1000 and type = 'PROMO' and list_has_any(tags, ['Brand#11', 'Brand#23'])", _BOOSTED.format(by=0.8, chosen="select 'Brand#11' as genre union all select 'Brand#23'"), _TYPE))(
    lambda s, d: recommender(s, d).by_preferences(["Brand#11", "Brand#23"], "PROMO").select("item_id", "match_score", "rank"))
_SEEN = "(select name from clean where item_id in (1, 2, 3))"


@query("b12_by_watched", _ranked(_CAND, _BOOSTED.format(by=0.7, chosen=f"select distinct unnest(tags) as genre from clean where name in {_SEEN}"), _TYPE, f"where item_id not in (select item_id from clean where name in {_SEEN})"))
def b12(s, d):
    names = [r["name"] for r in cleaned(s, d).where("item_id in (1, 2, 3)").select("name").collect()]
    return recommender(s, d).by_watched(names).select("item_id", "match_score", "rank")


query("b8_j10_rule_boosts", with_("taglines", "select consequent as item, round(sum(s / sa / sc), 6) as boost from rules where k = 2 and s / sa / sc >= 1.05 and (contains(antecedent, 'Brand#1') or contains(antecedent, 'blue')) group by 1", **_TAGS, **ITEMSETS, sides=_SIDES, rules=_RULES))(
    lambda s, d: (lambda n: B.rule_boosts(AS.rules(AS.level_wise(tag_lines(s, d), n, TAG_SUPPORT, 2), n, 0.0, 1.05, 2), ["Brand#1", "blue"]).select("item", *r6("boost")))(cleaned(s, d).count()))
query("b13_regular_users", with_("profile", "select user_id, n_ratings, printf('%d - %d items rated - mean %.2f - segment %d', user_id, n_ratings, mean_rating, user_id % 5) as label from profile order by n_ratings desc, user_id limit 300"))(
    lambda s, d: B.regular_users(R.user_profile(A.ratings(s, d)).withColumn("segment", F.col("user_id") % 5)))
query("b4_form_rows", with_("clean", "select item_id, type, round(episodes, 4) as episodes, members_band, episodes_band from clean"))(
    lambda s, d: cleaned(s, d).select("item_id", "type", F.round("episodes", 4).alias("episodes"), "members_band", "episodes_band"))


_blends: dict[tuple[str, str], tuple] = {}


def _blend(s, d) -> tuple[G.Blend, DataFrame]:
    """The blended predictor of a table's titles, fitted once in a session, and the titles."""
    key = (s.sparkContext.applicationId, d)
    if key not in _blends:
        df = _regression(s, d).cache()
        parts = (df.where(f"split = '{k}'") for k in ("train", "validation", "test"))
        _blends.clear()
        _blends[key] = G.Blend.fit(*parts, "item_id"), df
    return _blends[key]


@query("b1_b3_blended_predictor")
def b1(s, d):
    """Metrics of the blend and of its models, with the weight, the test part's spread and R2 on all rows."""
    model, _ = _blend(s, d)
    rows = [(r["split"], r["model"], r["n"], r["rmse"], r["mae"], r["r2"], model.weight, model.sigma, model.r2_full) for r in model.table]
    return s.createDataFrame(rows, "split string, model string, n long, rmse double, mae double, r2 double, weight double, sigma double, r2_full double")


@query("b5_blended_scores")
def b5(s, d):
    """Score, tier and 95 % interval of each title of the test part, by the blend's own spread."""
    model, df = _blend(s, d)
    return model.predict(df.where("split = 'test'"), "item_id").select("item_id", "score", "tier", "low", "high")


@query("b6_user_segments")
def b6(s, d):
    users = R.user_profile(A.ratings(s, d)).where("n_ratings >= 20")
    m = K.matrix(users, "user_id", ["n_ratings", "mean_rating", "std_rating", "like_ratio"])
    model, _ = K.kmeans(m, 5)
    return K.assign(m, [c.tolist() for c in model.clusterCenters()]).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


# --- live feed and row mutation -----------------------------------------------

_UPD = "select user_id as item_id, case when arg_max(value, event_id) > 0 then 'Live' else '' end as genre, arg_max(event_type, event_id) as type, cast(cast(arg_max(json_extract_string(props, '$.k'), event_id) as bigint) as varchar) as episodes, round(arg_max(value, event_id), 2) as rating, cast(floor(arg_max(value, event_id) * 100) as bigint) - 500 as members from events group by user_id"


def updates(s, d):
    e = A.feed(s, d)
    g = e.groupBy("item_id").agg(F.max_by(F.struct("kind", "value", "props"), "event_id").alias("r"))
    v = F.col("r.value")
    return g.select("item_id", F.when(v > 0, "Live").otherwise("").alias("genre"), F.col("r.kind").alias("type"), F.from_json("r.props", "k bigint")["k"].cast("string").alias("episodes"), F.round(v, 2).alias("rating"), (F.floor(v * 100) - 500).cast("long").alias("members"))


KINDS = ["click", "view", "purchase"]
_OK = {
    "genre": "trim(u.genre) <> '' and u.genre is distinct from t.genre", "type": "u.type in ('click', 'view', 'purchase') and u.type is distinct from t.type",
    "episodes": "try_cast(u.episodes as bigint) > 0 and u.episodes is distinct from t.episodes", "rating": "u.rating > 0 and u.rating <= 10 and u.rating is distinct from t.rating",
    "members": "u.members >= 0 and u.members is distinct from t.members",
}
query("j7_l3_p25_upsert", with_("titles", "select t.item_id, t.name, " + ", ".join((f"case when {ok} then u.{f} else t.{f} end as {f}" if f != "rating" else f"round(case when {ok} then u.{f} else t.{f} end, 6) as {f}") for f, ok in _OK.items()) + " from (select item_id, name, genre, type, episodes, rating, cast(members as bigint) as members from titles) t left join upd u on u.item_id = t.item_id", upd=_UPD))(
    lambda s, d: L.upsert(A.titles(s, d), updates(s, d), KINDS).withColumn("rating", F.round("rating", 6)))
_DIFF = " union all ".join(f"select t.item_id, '{f}' as field from (select item_id, name, genre, type, episodes, rating, cast(members as bigint) as members from titles) t join upd u on u.item_id = t.item_id where {ok}" for f, ok in _OK.items())
query("j8_field_diff", with_("titles", _DIFF, upd=_UPD))(lambda s, d: L.changes(A.titles(s, d), updates(s, d), KINDS).select("item_id", "field"))
query("l4_sync_counts", with_("titles", f"select field, count(*) as n from ({_DIFF}) a group by field", upd=_UPD))(lambda s, d: L.sync_counts(L.changes(A.titles(s, d), updates(s, d), KINDS)))
query("j9_l5_state", "select user_id as item_id, max(ts) as fetched_at from events group by 1")(
    lambda s, d: (lambda e: L.latest(e.where("fetched_at < timestamp_ntz'2024-01-15'"), e.where("fetched_at >= timestamp_ntz'2024-01-15'")))(A.table(s, d, "events").select(F.col("user_id").alias("item_id"), F.col("ts").alias("fetched_at"))))
query("j5_l1_stale", with_("titles", "select item_id from titles where item_id not in (select user_id from events where ts >= timestamp '2024-01-29') order by item_id limit 500"))(
    lambda s, d: L.select_ids(A.titles(s, d), A.table(s, d, "events").select(F.col("user_id").alias("item_id"), F.col("ts").alias("fetched_at")), cutoff="2024-01-29 00:00:00", limit=500))


_STATE = "select user_id as item_id, max(ts) as fetched_at from events group by 1"


def _state(s, d):
    return A.table(s, d, "events").select(F.col("user_id").alias("item_id"), F.col("ts").alias("fetched_at"))


_MODES = """select 'ids' as mode, item_id from titles where item_id in (3, 1, 7) union all select 'all', item_id from (select item_id from titles order by item_id limit 40) a
    union all select 'top', item_id from (select item_id from titles order by members desc, item_id limit 20) b
    union all select 'stale', item_id from (select item_id from titles where item_id not in (select user_id from events where ts >= timestamp '2024-01-29') order by item_id limit 30) c"""


@query("l1_select_ids", with_("titles", _MODES))
def l1(s, d):
    t, e = A.titles(s, d), _state(s, d)
    modes = {"ids": dict(ids=[3, 1, 7, -5]), "all": dict(limit=40), "top": dict(top=20), "stale": dict(cutoff="2024-01-29 00:00:00", limit=30)}
    out = None
    for name, how in modes.items():
        rows = L.select_ids(t, e, **how).select(F.lit(name).alias("mode"), "item_id")
        out = rows if out is None else out.unionAll(rows)
    return out


def _payloads(s, d) -> DataFrame:
    """Payloads of the feed; every tenth text is cut short."""
    u = updates(s, d)
    text = F.to_json(F.struct(F.col("item_id").alias("mal_id"), F.col("rating").alias("score"), "members", F.col("episodes").cast("long").alias("episodes"), "type", F.array(F.struct(F.col("genre").alias("name"))).alias("genres")))
    return u.select(F.when(F.col("item_id") % 10 == 0, F.substring(text, 1, 15)).otherwise(text).alias("json"))


@query("l4_sync", f"select count(*) filter (where item_id % 10 <> 0) as fetched, count(*) filter (where item_id % 10 = 0) as failed from ({_STATE}) s")
def l4(s, d):
    """A sync in which broken payloads fail alone."""
    _, report = L.sync(A.titles(s, d), _payloads(s, d), KINDS)
    return s.createDataFrame([(report["fetched"], report["failed"])], "fetched long, failed long")


def _stages(d) -> dict[int, ST.Stage]:
    def association(s):
        rules = AS.mine_tags(cleaned(s, d), min_support=0.012)
        return {"genre_rules": rules.count(), "best_genre_lift": rules.agg(F.max(F.round("lift", 6))).first()[0]}

    def classification(s):
        return {"j48": _tree(s, d).stats(), "majority": CL.majority(A.outcome(s, d), "actual").first().asDict()}

    def regression(s):
        return {"mean": G.metrics(predictions(s, d), "y", "p").first().asDict()}

    def broken(s):
        raise KeyError("no such table")

    return {2: association, 3: classification, 4: regression, 5: broken}


@query("l6_stage_runner", "select * from (values (2, true), (3, true), (4, true), (5, false)) t(stage, ok)")
def l6(s, d):
    """Stages run one by one: a failing one does not stop the others, and a stage that runs again replaces only its own metrics."""
    runner = ST.Runner(s, files.Versioned(s, files.scratch(s, "summary")), _stages(d))
    info = runner.run()
    before = {r.metric: r.value for r in runner.read().collect()}
    runner.stages[3] = lambda s: {"leaves": 1}
    runner.run([3])
    after = {r.metric: r.value for r in runner.read().collect()}
    kept = all(after[k] == v for k, v in before.items() if not k.startswith("stage3.")) and [k for k in after if k.startswith("stage3.")] == ["stage3.leaves"]
    return s.createDataFrame([(n, x.startswith("ok") and kept) for n, x in info.items()], "stage int, ok boolean")


@query("l7_retrain", "select * from (values ('forced', false, '2 4'), ('too few', true, ''), ('no sync', false, '4')) t(run, skipped, stages_ok)")
def l7(s, d):
    """Three retrainings: one forced, one skipped for too few changes, one without a sync; the log has a row for each."""
    runner, log = ST.Runner(s, files.Versioned(s, files.scratch(s, "summary")), _stages(d)), files.scratch(s, "log")

    def sync():
        _, report = L.sync(A.titles(s, d), _payloads(s, d).limit(0), KINDS)
        return report | {"selected": 0}

    runs = {
        "forced": ST.retrain(runner, log, sync, only=[2, 4, 5], force=True),
        "too few": ST.retrain(runner, log, sync, only=[2]),
        "no sync": ST.retrain(runner, log, only=[4]),
    }
    if s.read.parquet(log).count() != len(runs):
        raise RuntimeError("the log has not a row for each run")
    return s.createDataFrame([(k, r["skipped"], r["stages_ok"]) for k, r in runs.items()], "run string, skipped boolean, stages_ok string")


@query("f23_l2_normalise", "select event_id as item_id, 'Live, ' || event_type as genre, event_type as type, case when k > 0 then cast(k as varchar) end as episodes, case when round(value, 2) > 0 then round(value, 2) end as rating, k as members from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events) e")
def f23(s, d):
    e = A.feed(s, d).withColumn("k", F.from_json("props", "k bigint")["k"])
    named = F.array(F.struct(F.lit("Live").alias("name")))
    payload = F.to_json(F.struct(F.col("event_id").alias("mal_id"), F.round("value", 2).alias("score"), F.col("k").alias("members"), F.col("k").alias("episodes"), F.col("kind").alias("type"), named.alias("genres"), F.array(F.struct(F.col("kind").alias("name"))).alias("themes")))
    return L.normalise(e.select(payload.alias("json"))).select("item_id", "genre", "type", "episodes", "rating", "members")


@query("d1_insert", "select n_nationkey, n_name, n_regionkey from nation union all select (select max(n_nationkey) from nation) + 1, 'ATLANTIS', 0")
def d1(s, d):
    new = s.range(1).select(F.lit("ATLANTIS").alias("n_name"), F.lit(None).cast("int").alias("n_regionkey"))
    return TB.insert(A.table(s, d, "nation"), new, "n_nationkey", ["n_name"], ["n_name"], {"n_regionkey": 0}).select("n_nationkey", "n_name", "n_regionkey")


query("d2_update", "select n_nationkey, case when n_nationkey = 3 then 'RENAMED' else n_name end as n_name, n_regionkey from nation")(
    lambda s, d: TB.update(A.table(s, d, "nation"), "n_nationkey", 3, {"n_name": "RENAMED", "n_regionkey": None, "n_nationkey": 99}, ["n_name", "n_regionkey"]).select("n_nationkey", "n_name", "n_regionkey"))
query("d3_delete", "select n_nationkey, n_name from nation where n_nationkey <> 3")(lambda s, d: TB.delete(A.table(s, d, "nation"), "n_nationkey", 3).select("n_nationkey", "n_name"))
query("d4_conflicts", "select s_nationkey, count(*) as n from supplier group by 1 having count(*) > 1")(lambda s, d: TB.duplicates(A.table(s, d, "supplier"), "s_nationkey"))

# --- sinks --------------------------------------------------------------------

_SUPPLIER = "select s_suppkey, s_name, round(s_acctbal, 2) as s_acctbal from supplier"


def _supplier(s, d):
    return A.table(s, d, "supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))


@query("s5_s12_csv_round_trip", _SUPPLIER)
def s5(s, d):
    at = files.scratch(s, "csv")
    files.write_csv(_supplier(s, d), at)
    return files.read_csv(s, at, "s_suppkey long, s_name string, s_acctbal double")


@query("s6_append_history", "select to_day, count(*) as n from (select strftime(ts, '%Y-%m-%d') as to_day from events) a group by 1")
def s6(s, d):
    at, e = files.scratch(s, "history"), A.table(s, d, "events").select("event_id", F.col("ts").alias("fetched_at"))
    files.append_history(e.where("event_id % 2 = 0"), at)
    files.append_history(e.where("event_id % 2 = 1"), at)
    return s.read.parquet(at).groupBy(F.col("day").cast("string").alias("to_day")).agg(F.count(F.lit(1)).alias("n"))


@query("s7_versioned_replace", "select s_suppkey, s_name, round(round(s_acctbal, 2) + 1, 2) as s_acctbal from supplier")
def s7(s, d):
    t = files.Versioned(s, files.scratch(s, "versions"))
    t.replace(_supplier(s, d))
    t.replace(t.read().withColumn("s_acctbal", F.round(F.col("s_acctbal") + 1, 2)))
    return t.read()


@query("s10_model_store", with_("clean", "select item_id, round(l.a + l.b * c.members_log, 4) as p from clean c, line l", line=_LINE))
def s10(s, d):
    from pyspark.ml.regression import LinearRegressionModel

    df = CL.assemble(cleaned(s, d), ["members_log"]).withColumn("label", F.col("rating"))
    at = files.scratch(s, "model")
    files.save_model(G.models(df)["ols"].fit(df), at)
    return LinearRegressionModel.load(at).transform(df).select("item_id", F.round("prediction", 4).alias("p"))


query("s11_missing_table", "select 0 as n")(lambda s, d: files.try_read(s, f"{d}/absent.parquet", "a int").agg(F.count(F.lit(1)).cast("int").alias("n")))
query("s13_seed_view", "select n_nationkey, n_name from nation where n_regionkey = 1")(
    lambda s, d: (A.table(s, d, "nation").createOrReplaceTempView("lodestone_nation"), s.sql("select n_nationkey, n_name from lodestone_nation where n_regionkey = 1"))[1])
query("s14_memo", "select count(*) as n from part")(lambda s, d: files.Memo(s).read(f"{d}/part.parquet").agg(F.count(F.lit(1)).alias("n")))


@query("s8_json_cache", "select * from (values (1, cast(8.75 as double), 2, 1)) t(id, score, fetches, hits)")
def s8_cache(s, d):
    """A payload fetched once, found, and fetched again after its file broke."""
    calls = []
    cache = files.JsonCache(s, files.scratch(s, "cache"), lambda key: calls.append(key) or '{"mal_id": 1, "score": 8.75}')
    cache.get(1)
    cache.get(1)
    fs, at = files._fs(s, f"{cache.path}/1.json")
    out = fs.create(at, True)
    out.write(bytearray(b'{"mal_id": 1, "sc'))
    out.close()
    got = cache.get(1)
    return s.createDataFrame([(got["mal_id"], got["score"], len(calls), cache.hits)], "id int, score double, fetches int, hits int")

# --- extensions ---------------------------------------------------------------


@query("ext_event_stream", "select date_trunc('hour', ts) as start, event_type as kind, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def ext_stream(s, d):
    """The events as a stream: windows are appended to files as the watermark passes them, and a last row far ahead closes the last ones."""
    events = A.table(s, d, "events")
    at = files.scratch(s, "stream")
    end = events.agg(F.max("ts").alias("ts")).select(*[(F.col("ts") + F.expr("interval 400 days")).alias(c) if c == "ts" else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns])
    events.write.parquet(f"{at}/in/part=0")
    end.write.parquet(f"{at}/in/part=1")
    # One file after the other, so that the row that closes the windows comes in a batch of its own.
    stream = s.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{at}/in")
    q = live.event_windows(stream, late="60 days").writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(f"{at}/out").where("kind is not null").select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n", F.round("total", 4).alias("total"))
