"""Queries of preparation: scans, projections, joins, aggregates, windows, samples, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import scalar as S
from lodestone.operators import clean as C
from lodestone.operators import ratings as R
from lodestone.operators import tables as TB
from lodestone.plans.registry import query, with_
from lodestone.sources import adapters as A


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return C.clean(A.titles(spark, d))


def r6(*names: str) -> list:
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


# --- scans and projections ----------------------------------------------------

query("s1_scan", "select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) as o_totalprice from orders")(
    lambda s, d: A.table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 4).alias("o_totalprice")))
query("s2_pruned_scan", "select l_orderkey, l_quantity from lineitem where l_quantity > 45")(
    lambda s, d: A.table(s, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_quantity"))
query("s3_accumulate", with_("ratings", "select item_id, count(*) as n, cast(sum(rating) as bigint) as total, cast(sum(rating * rating) as bigint) as squares from ratings where rating > 0 group by item_id"))(
    lambda s, d: R.scored(A.ratings(s, d)).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("total"), F.sum(F.col("rating") * F.col("rating")).alias("squares")))
query("s4_head", "select event_id, event_type from events order by event_id limit 100")(
    lambda s, d: A.table(s, d, "events").select("event_id", "event_type").orderBy("event_id").limit(100))


@query("s8_json_read", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def s8(s, d):
    return A.feed(s, d).select("event_id", F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})["k"].alias("k"))


@query("p1_column_names", "select c_custkey, c_name from customer")
def p1(s, d):
    df = A.table(s, d, "customer")
    return C.normalise_names(df.toDF(*[f" {c.upper()} " for c in df.columns])).select("c_custkey", "c_name")


query("p2_fill_strip", with_("typed", "select item_id, genre, type from typed"))(
    lambda s, d: A.titles(s, d).select("item_id", S.or_unknown("genre").alias("genre"), S.or_unknown("type").alias("type")))
query("p3_lenient_cast", with_("typed", "select item_id, e0 as episodes from typed"))(
    lambda s, d: A.titles(s, d).select("item_id", S.number("episodes").alias("episodes")))
query("p4_group_median", with_("grouped", "select item_id, type, round(episodes, 6) as episodes from grouped"))(
    lambda s, d: C.fill_by_group(A.titles(s, d).withColumn("episodes", S.number("episodes")), "episodes", "type").select("item_id", "type", *r6("episodes")))
query("p5_group_mean", with_("clean", "select item_id, type, rating from clean"))(
    lambda s, d: C.fill_by_group(A.titles(s, d), "rating", "type", "mean").select("item_id", "type", F.round("rating", 2).alias("rating")))
query("p6_domain", "select p_partkey, case when p_type in ('ECONOMY', 'STANDARD', 'PROMO') then p_type else 'Unknown' end as kind from part")(
    lambda s, d: A.table(s, d, "part").select("p_partkey", S.in_list("p_type", ["ECONOMY", "STANDARD", "PROMO"]).alias("kind")))
query("p7_first_by_key", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders) a where rn = 1")(
    lambda s, d: C.first_by_key(A.table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey"))
query("p8_duplicate_rows", with_("ratings", "select cast(sum(n) as bigint) as n_rows, cast(sum(n - 1) as bigint) as n_duplicates from (select count(*) as n from ratings group by user_id, item_id, rating) a"))(
    lambda s, d: C.duplicate_rows(A.ratings(s, d)))
query("p9_null_profile", with_("typed", """select 'episodes' as column_name, count(*) filter (where e0 is null) as n_null, round(100.0 * count(*) filter (where e0 is null) / count(*), 4) as pct_null from typed
    union all select 'rating', count(*) filter (where r0 is null), round(100.0 * count(*) filter (where r0 is null) / count(*), 4) from typed
    union all select 'genre', count(*) filter (where genre is null), round(100.0 * count(*) filter (where genre is null) / count(*), 4) from typed"""))(
    lambda s, d: C.null_profile(A.titles(s, d).select(S.number("episodes").alias("episodes"), "rating", "genre")))
query("p10_sentinel", with_("ratings", "select user_id, count(*) filter (where rating > 0) as n_scored, count(*) filter (where rating = -1) as n_unscored from ratings group by user_id"))(
    lambda s, d: A.ratings(s, d).groupBy("user_id").agg(F.count_if(F.col("rating") > 0).alias("n_scored"), F.count_if(F.col("rating") == -1).alias("n_unscored")))
query("p11_thresholds", with_("clean", "select item_id, members, rating from clean where members >= 1000 and rating >= 5"))(
    lambda s, d: cleaned(s, d).where("members >= 1000 and rating >= 5").select("item_id", "members", "rating"))
query("p12_rare_classes", with_("clean", "select item_id, members_band from clean where members_band in (select members_band from clean group by 1 having count(*) >= 25)"))(
    lambda s, d: C.drop_rare(cleaned(s, d).select("item_id", "members_band"), "members_band"))
query("p13_drop_nulls", with_("typed", "select item_id, r0 as rating from typed where r0 is not null and e0 is not null"))(
    lambda s, d: A.titles(s, d).withColumn("episodes", S.number("episodes")).dropna(subset=["rating", "episodes"]).select("item_id", "rating"))
query("p15_finite", with_("typed", "select item_id, coalesce(r0, 0.0) as rating from typed"))(
    lambda s, d: A.titles(s, d).select("item_id", S.finite("rating").alias("rating")))
query("p16_columns_by_prefix", "select p_partkey, p_name, p_brand, p_type from part")(
    lambda s, d: (lambda df: df.select("p_partkey", *[c for c in df.columns if c in ("p_name", "p_brand", "p_type", "p_missing")]))(A.table(s, d, "part")))
query("p17_conditional_update", "select c_custkey, case when c_acctbal < 0 then 'debt' else c_mktsegment end as c_mktsegment from customer")(
    lambda s, d: A.table(s, d, "customer").withColumns({"c_mktsegment": F.when(F.col("c_acctbal") < 0, "debt").otherwise(F.col("c_mktsegment"))}).select("c_custkey", "c_mktsegment"))
query("p19_any_genre", with_("clean", "select item_id, name from clean where list_has_any(tags, ['Brand#11', 'Brand#23', 'small'])"))(
    lambda s, d: cleaned(s, d).where(F.arrays_overlap("tags", F.array(*map(F.lit, ("Brand#11", "Brand#23", "small"))))).select("item_id", "name"))


@query("p20_fallback", with_("clean", "select item_id from clean where (select count(*) from clean where type = 'NONE') = 0 and list_contains(tags, 'Brand#11') or type = 'NONE'"))
def p20(s, d):
    c = cleaned(s, d)
    both, tagged = c.where((F.col("type") == "NONE") & F.array_contains("tags", "Brand#11")), c.where(F.array_contains("tags", "Brand#11"))
    return next((x for x in (both, tagged) if not x.isEmpty()), c).select("item_id")


query("p21_exclude", with_("titles", "select item_id, name from titles where name not in (select name from titles where item_id <= 10)"))(
    lambda s, d: (lambda t: t.join(t.where("item_id <= 10").select("name"), "name", "left_anti").select("item_id", "name"))(A.titles(s, d)))
query("p22_pattern", "select p_partkey, p_type from part where lower(p_type) not like '%promo%'")(
    lambda s, d: A.table(s, d, "part").where(~F.lower("p_type").contains("promo")).select("p_partkey", "p_type"))
query("p23_search", "select p_partkey, p_name, p_brand from part where (p_name ilike '%AL%' or p_brand ilike '%AL%') and p_type = 'PROMO'")(
    lambda s, d: TB.search(A.table(s, d, "part"), "AL", ["p_name", "p_brand"], p_type="PROMO").select("p_partkey", "p_name", "p_brand"))
query("p24_lookup", "select c_custkey, c_name from customer where c_custkey = 42")(
    lambda s, d: A.table(s, d, "customer").where("c_custkey = 42").select("c_custkey", "c_name"))
query("p26_drop_columns", "select n_nationkey, n_regionkey from nation")(lambda s, d: A.table(s, d, "nation").drop("n_name", "absent"))

# --- joins --------------------------------------------------------------------

query("j1_semi", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')")(
    lambda s, d: A.table(s, d, "customer").join(A.table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey"))
query("j2_lookup", with_("ratings titles", "select r.user_id, t.name, r.rating from ratings r join titles t on t.item_id = r.item_id where r.rating >= 9"))(
    lambda s, d: A.ratings(s, d).where("rating >= 9").join(A.titles(s, d).select("item_id", "name"), "item_id").select("user_id", "name", "rating"))
query("j3_three_way", with_("segmented", "select segment, primary_genre, type, count(*) as n from segmented group by 1, 2, 3"))(
    lambda s, d: R.scored(A.ratings(s, d)).withColumn("segment", (F.col("user_id") % 5).cast("int")).join(cleaned(s, d).select("item_id", "primary_genre", "type"), "item_id").groupBy("segment", "primary_genre", "type").agg(F.count(F.lit(1)).alias("n")))


@query("j4_default_lookup", with_("clean", "select c.item_id, round(coalesce(a.aff, 7.0), 6) as affinity from clean c left join aff a on a.primary_genre = c.primary_genre", aff="select primary_genre, avg(rating) as aff from clean where type = 'PROMO' group by 1 having count(*) > 5"))
def j4(s, d):
    c = cleaned(s, d)
    aff = c.where("type = 'PROMO'").groupBy("primary_genre").agg(F.avg("rating").alias("aff"), F.count(F.lit(1)).alias("n")).where("n > 5").drop("n")
    return c.join(aff, "primary_genre", "left").select("item_id", F.round(F.coalesce("aff", F.lit(7.0)), 6).alias("affinity"))


query("j6_anti", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity >= 49)")(
    lambda s, d: A.table(s, d, "part").join(A.table(s, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey"))
query("j13_concat_by_id", "select c_custkey, cast(c_mktsegment = 'BUILDING' as integer) as seg_BUILDING, cast(c_mktsegment = 'MACHINERY' as integer) as seg_MACHINERY, round(c_acctbal, 4) as c_acctbal from customer")(
    lambda s, d: (lambda c: C.one_hot(c, "c_mktsegment", ["BUILDING", "MACHINERY"], "seg_").select("c_custkey", "seg_BUILDING", "seg_MACHINERY").join(c.select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal")), "c_custkey"))(A.table(s, d, "customer")))
query("j14_references", "select count(*) as n_orphans, (select count(*) from orders) as n_orders from orders where o_custkey not in (select c_custkey from customer)")(
    lambda s, d: TB.orphans(A.table(s, d, "orders"), "o_custkey", A.table(s, d, "customer"), "c_custkey").agg(F.count(F.lit(1)).alias("n_orphans")).join(F.broadcast(A.table(s, d, "orders").agg(F.count(F.lit(1)).alias("n_orders")))))

# --- aggregates ---------------------------------------------------------------

SPREAD = "count(*) as n_ratings, round(avg(rating), 4) as mean_rating, round(coalesce(stddev_samp(rating), 0), 4) as std_rating, max(rating) as max_rating, min(rating) as min_rating"
query("a1_item_stats", with_("ratings", f"select item_id, {SPREAD} from ratings where rating > 0 group by item_id"))(lambda s, d: R.item_stats(A.ratings(s, d)))
query("a2_user_profile", with_("profile", "select *, max_rating - min_rating as range_rating, round(n_liked / n_ratings, 4) as like_ratio, round(mean_rating + std_rating, 4) as critic_score from profile"))(
    lambda s, d: R.user_profile(A.ratings(s, d)))
query("a3_counters", with_("ratings", "select count(*) filter (where rating > 0) as n_scored, count(*) filter (where rating = -1) as n_unrated, count(distinct case when rating > 0 then item_id end) as n_items, count(distinct case when rating > 0 then user_id end) as n_users from ratings"))(
    lambda s, d: R.counters(A.ratings(s, d)))
_REPORT = """select '{c}' as column_name, round(q1, 6) as q1, round(q3, 6) as q3, round(q1 - 1.5 * (q3 - q1), 6) as low, round(q3 + 1.5 * (q3 - q1), 6) as high,
    (select count(*) from clean where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as n_outliers,
    round(100.0 * (select count(*) from clean where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) / n, 4) as pct_outliers, round(sk, 6) as skewness
    from (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3, count({c}) as n, skewness({c}) as sk from clean) a"""
query("a4_a5_a18_outlier_report", with_("clean", " union all ".join(_REPORT.format(c=c) for c in ("members", "episodes", "rating", "members_log"))))(
    lambda s, d: C.outlier_report(cleaned(s, d), ["members", "episodes", "rating", "members_log"]))
query("a6_f13_f14_scale", with_("clean", """select item_id, round((rating - (select min(rating) from clean)) / (select max(rating) - min(rating) from clean), 6) as rating_minmax,
    round((rating - (select avg(rating) from clean)) / (select stddev_pop(rating) from clean), 6) as rating_zscore,
    round((members_log - (select min(members_log) from clean)) / (select max(members_log) - min(members_log) from clean), 6) as members_log_minmax,
    round((members_log - (select avg(members_log) from clean)) / (select stddev_pop(members_log) from clean), 6) as members_log_zscore from clean"""))(
    lambda s, d: C.scale(cleaned(s, d), ["rating", "members_log"]).select("item_id", "rating_minmax", "rating_zscore", "members_log_minmax", "members_log_zscore"))
query("a7_group_stats_back", with_("clean", "select item_id, round(avg(rating) over (partition by type), 6) as type_mean, median(members) over (partition by type) as type_median from clean"))(
    lambda s, d: (lambda c: c.join(c.groupBy("type").agg(F.round(F.avg("rating"), 6).alias("type_mean"), F.median("members").alias("type_median")), "type").select("item_id", "type_mean", "type_median"))(cleaned(s, d)))


@query("a8_value_counts", with_("clean", "select b.value, cast(b.ord as integer) as ord, count(c.item_id) as n from (values ('tiny', 0), ('small', 1), ('medium', 2), ('large', 3), ('huge', 4)) b(value, ord) left join clean c on c.members_band = b.value group by 1, 2"))
def a8(s, d):
    bands = F.array(*[F.struct(F.lit(n).alias("value"), F.lit(i).alias("ord")) for i, (_, n) in enumerate(S.MEMBER_BANDS)])
    return R.value_counts(cleaned(s, d), "members_band", s.range(1).select(F.inline(bands)))


query("a9_user_baskets", with_("favourites titles", "select user_id, items from (select f.user_id, list_sort(list(distinct t.name)) as items from favourites f join titles t on t.item_id = f.item_id group by 1) a where len(items) >= 3"))(
    lambda s, d: R.user_baskets(R.favourites(A.ratings(s, d), A.titles(s, d))))


def segments(s, d):
    return A.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 5).cast("int").alias("segment"))


for _by in ("primary_genre", "type"):
    query(f"a10_affinity_{_by}", with_("segmented", f"select segment, {_by}, count(*) as n, round(avg(rating), 6) as affinity from segmented group by 1, 2"))(
        lambda s, d, by=_by: R.affinity(A.ratings(s, d), segments(s, d), cleaned(s, d), by).select("segment", by, "n", *r6("affinity")))
query("a11_global_affinity", with_("segmented", "select primary_genre, round(avg(a), 6) as overall from (select segment, primary_genre, avg(rating) as a from segmented group by 1, 2) x group by 1"))(
    lambda s, d: R.global_affinity(R.affinity(A.ratings(s, d), segments(s, d), cleaned(s, d))).select("primary_genre", *r6("overall")))
query("a12_type_means", with_("clean", "select type, round(avg(rating), 6) as mean_rating, median(members) as median_members, median(episodes) as median_episodes from clean group by type"))(
    lambda s, d: cleaned(s, d).groupBy("type").agg(F.round(F.avg("rating"), 6).alias("mean_rating"), F.median("members").alias("median_members"), F.median("episodes").alias("median_episodes")))
_BANDS = ", ".join(f"count(*) filter (where members_band = '{n}') as {n}" for _, n in S.MEMBER_BANDS)
query("a15_u5_crosstab", with_("clean", f"select type, {_BANDS} from clean group by type"))(
    lambda s, d: R.crosstab(cleaned(s, d), "type", "members_band", [n for _, n in S.MEMBER_BANDS]))
query("a19_latest", "select max(ts) as last_ts, count(*) as n, arg_max(event_type, event_id) as last_type from events")(
    lambda s, d: A.table(s, d, "events").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), F.max_by("event_type", "event_id").alias("last_type")))
query("a20_distinct_ids", "select distinct user_id from events order by user_id")(lambda s, d: A.table(s, d, "events").select("user_id").distinct().orderBy("user_id"))
query("a21_group_count", "select c_mktsegment, count(*) as n, round(sum(c_acctbal), 2) as total from customer group by 1 order by n desc, c_mktsegment")(
    lambda s, d: A.table(s, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")).orderBy(F.desc("n"), "c_mktsegment"))
query("a22_histogram", "select cast(least(floor((l_quantity - 0.0) / 5), 10) + 1 as bigint) as bin, count(*) as n from lineitem group by 1")(
    lambda s, d: R.histogram(A.table(s, d, "lineitem"), "l_quantity", 10, 0.0, 50.0))
query("a23_five_numbers", with_("clean", "select type, " + ", ".join(f"round(quantile_cont(rating, {q}), 6) as {n}" for q, n in ((0, "minimum"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1, "maximum"))) + " from clean group by type"))(
    lambda s, d: R.five_numbers(cleaned(s, d), "rating", "type"))
query("a24_class_moments", with_("clean", "select score_tier, round(avg(z), 6) as z_mean, round(coalesce(stddev_samp(z), 0), 6) as z_std from (select score_tier, (members_log - (select avg(members_log) from clean)) / (select stddev_pop(members_log) from clean) as z from clean) a group by 1"))(
    lambda s, d: R.class_moments(cleaned(s, d), "score_tier", "members_log"))
query("a25_champions", with_("clean", "select type, arg_max(item_id, (members, -item_id)) as best from clean group by type"))(
    lambda s, d: cleaned(s, d).groupBy("type").agg(F.max_by("item_id", F.struct("members", -F.col("item_id"))).alias("best")))
query("a26_segment_profile", with_("segmented", "select segment, primary_genre, round(a, 6) as affinity, round(avg(a) over (partition by primary_genre), 6) as overall, round(a - avg(a) over (partition by primary_genre), 6) as delta from (select segment, primary_genre, avg(rating) as a from segmented group by 1, 2) x"))(
    lambda s, d: R.segment_profile(R.affinity(A.ratings(s, d), segments(s, d), cleaned(s, d))))
query("a27_basket_stats", with_("", "select count(*) as n_baskets, round(avg(k), 6) as mean_size, max(k) as max_size from (select cast(count(distinct p_type) as integer) as k from lineitem join part on l_partkey = p_partkey group by l_orderkey) a"))(
    lambda s, d: R.basket_stats(A.order_lines(s, d).groupBy("basket").agg(F.collect_set("item").alias("items"))))
query("ext_cube", with_("clean", "select type, score_tier, cast(grouping(type) * 2 + grouping(score_tier) as integer) as level, count(*) as n, round(avg(rating), 6) as mean from clean group by cube (type, score_tier)"))(
    lambda s, d: R.cube(cleaned(s, d), "type", "score_tier", "rating"))

# --- windows, sorts, samples --------------------------------------------------

query("w1_w2_favourites", with_("favourites titles", "select f.user_id, f.rank, f.item_id, t.name as item, f.rating from favourites f join titles t on t.item_id = f.item_id"))(
    lambda s, d: R.favourites(A.ratings(s, d), A.titles(s, d)))


@query("w9_history", "select event_id, user_id, round(value, 6) as value, round(value - lag(value) over (partition by user_id order by ts, event_id), 6) as delta from events")
def w9(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return A.table(s, d, "events").select("event_id", "user_id", F.round("value", 6).alias("value"), F.round(F.col("value") - F.lag("value").over(w), 6).alias("delta"))


query("w5_t1_rank", "select s_suppkey, cast(row_number() over (order by s_acctbal desc, s_suppkey) as integer) as rank from supplier order by rank limit 50")(
    lambda s, d: A.table(s, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(50).select("s_suppkey", F.row_number().over(Window.orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("rank")))
query("t2_top_k", with_("titles", "select item_id, members from titles order by members desc, item_id limit 25"))(
    lambda s, d: A.titles(s, d).orderBy(F.desc("members"), "item_id").limit(25).select("item_id", "members"))
query("t3_page", "select c_custkey, c_name from customer order by c_custkey limit 50 offset 100")(
    lambda s, d: TB.page(A.table(s, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], 3, 500))
query("t4_t5_t6_sample", "select c_custkey from customer order by md5('42:' || c_custkey), c_custkey limit 200")(
    lambda s, d: C.sample(A.table(s, d, "customer"), "c_custkey", 200).select("c_custkey"))
_HASH = "cast(('0x' || substr(md5('42:' || {k}), 1, 8)) as bigint)"
query("t7_split", with_("", f"select p_partkey, case when u < 0.2 then 'test' when u < 0.2 + 0.8 * 0.25 then 'validation' else 'train' end as split from (select p_partkey, {_HASH.format(k='p_partkey')} / 4294967296.0 as u from part) a"))(
    lambda s, d: C.split(A.table(s, d, "part"), "p_partkey").select("p_partkey", "split"))
query("t8_stratified_split", "select p_partkey, case when u < 0.2 then 'test' when u < 0.2 + 0.8 * 0.25 then 'validation' else 'train' end as split from (select p_partkey, (row_number() over (partition by p_type order by md5('42:' || p_partkey), p_partkey) - 1) / count(*) over (partition by p_type) as u from part) a")(
    lambda s, d: C.split(A.table(s, d, "part"), "p_partkey", stratify="p_type").select("p_partkey", "split"))
query("t9_folds", f"select p_partkey, cast({_HASH.format(k='p_partkey')} % 5 as integer) as fold, cast((row_number() over (partition by p_type order by md5('42:' || p_partkey), p_partkey) - 1) % 5 as integer) as fold_by_type from part")(
    lambda s, d: (lambda p: C.folds(p, "p_partkey").select("p_partkey", "fold").join(C.folds(p, "p_partkey", stratify="p_type").select("p_partkey", F.col("fold").alias("fold_by_type")), "p_partkey"))(A.table(s, d, "part")))
query("t10_dedup_sorted", with_("clean", "select name, item_id from (select primary_genre || ' ' || type as name, item_id, row_number() over (partition by primary_genre || ' ' || type order by rating desc, item_id) as rn from clean) a where rn = 1"))(
    lambda s, d: C.first_by_key(cleaned(s, d).select(F.concat_ws(" ", "primary_genre", "type").alias("name"), "item_id", "rating"), "name", [F.desc("rating"), "item_id"]).select("name", "item_id"))

# --- sets and shapes ----------------------------------------------------------

query("u1_union_all", "select c_nationkey as nation, c_acctbal as bal from customer union all select s_nationkey, s_acctbal from supplier")(
    lambda s, d: A.table(s, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal")).unionByName(A.table(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"))))
query("u2_tag_union", with_("clean", "select distinct unnest(tags) as genre from clean where item_id <= 20"))(
    lambda s, d: cleaned(s, d).where("item_id <= 20").select(F.explode("tags").alias("genre")).distinct())
query("u3_set_operations", "(select c_nationkey as k, 'both' as side from customer intersect select s_nationkey, 'both' from supplier) union all (select n_nationkey, 'neither' from nation except select c_nationkey, 'neither' from customer)")(
    lambda s, d: A.table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(A.table(s, d, "supplier").select("s_nationkey")).withColumn("side", F.lit("both")).unionByName(A.table(s, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(A.table(s, d, "customer").select("c_nationkey")).withColumn("side", F.lit("neither"))))
query("u4_melt", "select p_partkey, 'p_size' as variable, cast(p_size as double) as value from part union all select p_partkey, 'p_retailprice', p_retailprice from part")(
    lambda s, d: TB.melt(A.table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_partkey"], ["p_size", "p_retailprice"]))
query("u6_transpose", "select 'n' as metric, cast(count(*) as double) as value from part union all select 'mean_price', round(avg(p_retailprice), 6) from part union all select 'max_size', max(p_size) from part")(
    lambda s, d: A.table(s, d, "part").agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean_price"), F.max("p_size").cast("double").alias("max_size")).unpivot([], ["n", "mean_price", "max_size"], "metric", "value"))
query("u7_flatten", "select * from (values ('rows', '3'), ('best.name', 'ridge'), ('best.score', '0.5'), ('sizes[0]', '1'), ('sizes[1]', '2.25'), ('done', 'True'), ('note', '')) t(metric, value)")(
    lambda s, d: TB.summary(s, {"rows": 3, "best": {"name": "ridge", "score": 0.5}, "sizes": [1, 2.25], "done": True, "note": None}))


@query("u8_coerce", "select episodes, case when try_cast(episodes as bigint) is not null then 'int' else 'text' end as kind, try_cast(episodes as double) as number from (select distinct case when p_partkey % 37 = 0 then 'Unknown' else cast(p_size as varchar) end as episodes from part) a")
def u8(s, d):
    c = A.titles(s, d).select("episodes").distinct().withColumn("v", S.coerce("episodes"))
    return c.select("episodes", "v.kind", "v.number")


query("u9_onehot_baskets", "select l_orderkey as basket, " + ", ".join(f"cast(max(case when p_type = '{t}' then 1 else 0 end) as integer) as \"{t}\"" for t in C.TYPES) + " from lineitem join part on l_partkey = p_partkey group by 1")(
    lambda s, d: A.order_lines(s, d).groupBy("basket").agg(*[F.max((F.col("item") == t).cast("int")).alias(t) for t in C.TYPES]))
query("u10_onehot", "select p_partkey, " + ", ".join(f"cast(p_type = '{t}' as integer) as \"t_{t}\"" for t in C.TYPES) + " from part")(
    lambda s, d: C.one_hot(A.table(s, d, "part"), "p_type", C.TYPES, "t_").select("p_partkey", *[f"t_{t}" for t in C.TYPES]))

# --- scalar functions ---------------------------------------------------------

query("f1_f2_tags", with_("clean", "select item_id, array_to_string(tags, '|') as tags, cast(genre_count as integer) as genre_count, primary_genre, is_multi_genre from clean"))(
    lambda s, d: cleaned(s, d).select("item_id", F.array_join("tags", "|").alias("tags"), "genre_count", "primary_genre", "is_multi_genre"))
query("f3_flags", with_("clean", "select item_id, cast(contains(genre, 'Brand#1') as integer) as g_any, cast(list_contains(tags, 'Brand#11') as integer) as g_tag from clean"))(
    lambda s, d: cleaned(s, d).select("item_id", S.has_text("genre", "Brand#1").alias("g_any"), S.has_tag("tags", "Brand#11").alias("g_tag")))
query("f4_f5_f6_text", with_("clean", "select item_id, replace(lower(name), ' ', '_') as slug, len(genre) - len(replace(genre, ',', '')) as commas, substr(upper(trim(name)), 1, 6) as head, cast(starts_with(name, 'a') as integer) as a from clean"))(
    lambda s, d: cleaned(s, d).select("item_id", F.replace(F.lower("name"), F.lit(" "), F.lit("_")).alias("slug"), F.regexp_count("genre", F.lit(",")).cast("long").alias("commas"), F.substring(F.upper(F.trim("name")), 1, 6).alias("head"), F.startswith("name", F.lit("a")).cast("int").alias("a")))
query("f8_f9_derived", with_("clean", "select item_id, round(members_log, 6) as members_log, round(episodes_log, 6) as episodes_log, round(members_per_episode, 6) as members_per_episode, round(engagement_index, 6) as engagement_index from clean"))(
    lambda s, d: cleaned(s, d).select("item_id", *r6("members_log", "episodes_log", "members_per_episode", "engagement_index")))
query("f10_f11_f12_numeric", "select l_orderkey, l_linenumber, round(sqrt(abs(l_extendedprice - 20000)), 4) as root, greatest(l_discount, l_tax) as most, least(greatest(l_quantity, 5), 40) as clipped from lineitem")(
    lambda s, d: A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sqrt(F.abs(F.col("l_extendedprice") - 20000)), 4).alias("root"), F.greatest("l_discount", "l_tax").alias("most"), S.clip("l_quantity", 5.0, 40.0).alias("clipped")))
query("f15_f16_bands", with_("clean", "select item_id, members_band, episodes_band, score_tier from clean"))(lambda s, d: cleaned(s, d).select("item_id", "members_band", "episodes_band", "score_tier"))
query("f17_quantile_bins", "select l_partkey % 100 as k, cast(least(greatest(len(list_filter(e, lambda x: x <= q)) - 1, 0), len(e) - 2) as integer) as bin, count(*) as n from (select l_partkey, l_extendedprice as q from lineitem) a, (select list_sort(list_distinct(list_transform(quantile_cont(l_extendedprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]), lambda x: round(x, 6)))) as e from lineitem) b group by 1, 2")(
    lambda s, d: (lambda li: li.join(F.broadcast(C.quantile_edges(li, ["l_extendedprice"]).select("edges"))).groupBy((F.col("l_partkey") % 100).alias("k"), S.bin_of("l_extendedprice", F.col("edges")).alias("bin")).agg(F.count(F.lit(1)).alias("n")))(A.table(s, d, "lineitem").select("l_partkey", "l_extendedprice")))


@query("f18_f19_codes", "select p.p_partkey, cast(case when p.p_type = 'PROMO' then -1 else c.code end as integer) as code from part p left join (select p_type, dense_rank() over (order by p_type) - 1 as code from (select distinct p_type from part where p_type <> 'PROMO') x) c on c.p_type = p.p_type")
def f18(s, d):
    part = A.table(s, d, "part")
    return C.encode(part, "p_type", C.ordinal_codes(part.where("p_type <> 'PROMO'"), "p_type"), "code").select("p_partkey", "code")


_FENCE = {c: f"(select quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) from clean)" for c in ("members", "episodes", "rating")}
_ABOVE = {c: f"(select quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) from clean)" for c in _FENCE}
query("f20_outlier_flag", with_("clean", "select item_id, cast(members < 50 or " + " or ".join(f"{c} < {_FENCE[c]} or {c} > {_ABOVE[c]}" for c in _FENCE) + " as integer) as is_outlier from clean"))(
    lambda s, d: C.flag_outliers(cleaned(s, d), ["members", "episodes", "rating"]).select("item_id", "is_outlier"))
query("f21_cutoff", "select event_id from events where ts >= timestamp '2024-01-25 00:00:00' - interval 3 day")(
    lambda s, d: A.table(s, d, "events").where(F.col("ts") >= F.expr("timestamp_ntz'2024-01-25 00:00:00' - interval 3 day")).select("event_id"))
query("f22_iso", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at from events")(
    lambda s, d: A.table(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at")))
query("f24_number_text", "select p_partkey, cast(p_size as varchar) as size_text from part")(
    lambda s, d: A.table(s, d, "part").select("p_partkey", S.show_number(F.col("p_size").cast("double")).alias("size_text")))
query("f25_labels", with_("profile", "select user_id, printf('%d - %d items rated - mean %.2f - segment %d', user_id, n_ratings, mean_rating, user_id % 5) as label from profile"))(
    lambda s, d: R.user_profile(A.ratings(s, d)).withColumn("segment", F.col("user_id") % 5).select("user_id", S.user_label("user_id", "n_ratings", "mean_rating", "segment").alias("label")))
query("f26_int_text", with_("grouped", "select item_id, cast(cast(e0 as bigint) as varchar) as shown from grouped"))(
    lambda s, d: A.titles(s, d).select("item_id", S.number("episodes").cast("long").cast("string").alias("shown")))
