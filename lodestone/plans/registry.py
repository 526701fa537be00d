"""Registers queries with the SQL that checks them, and the common table expressions that both sides' views have in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TAGS = "list_filter(list_transform(string_split(genre, ','), lambda t: trim(t)), lambda t: t <> '' and t <> 'Unknown')"

CTES = {
    "titles": """select p_partkey as item_id, p_name || ' ' || p_partkey as name,
        split_part(p_name, ' ', 1) || ', ' || split_part(p_name, ' ', 2) || ', ' || p_brand as genre, p_type as type,
        case when p_partkey % 37 = 0 then 'Unknown' else cast(p_size as varchar) end as episodes,
        case when p_partkey % 53 <> 0 then (p_retailprice - 900) / 10 end as rating,
        cast(greatest(coalesce(cnt, 0) - 13, 0) as bigint) * greatest(coalesce(cnt, 0) - 13, 0) * greatest(coalesce(cnt, 0) - 13, 0) as members
        from part left join (select l_partkey as k, count(*) as cnt from lineitem group by 1) l on k = p_partkey""",
    "ratings": """select o_custkey as user_id, l_partkey as item_id,
        cast(case when l_returnflag = 'R' then -1 else 1 + floor((l_quantity - 1) / 5) end as integer) as rating
        from lineitem join orders on l_orderkey = o_orderkey""",
    "typed": """select item_id, name, trim(coalesce(genre, 'Unknown')) as genre, trim(coalesce(type, 'Unknown')) as type,
        try_cast(episodes as double) as e0, rating as r0, cast(members as bigint) as members from titles""",
    "grouped": """select *, coalesce(e0, median(e0) over (partition by type), (select median(e0) from typed)) as episodes,
        coalesce(r0, avg(r0) over (partition by type)) as r1 from typed""",
    "clean0": """select item_id, name, genre, type, episodes, members, round(coalesce(r1, (select avg(r1) from grouped)), 2) as rating,
        {TAGS} as tags from grouped""",
    "clean": """select *, len(tags) as genre_count, coalesce(tags[1], 'Unknown') as primary_genre, case when len(tags) > 1 then 1 else 0 end as is_multi_genre,
        ln(1 + greatest(members, 0)) as members_log, ln(1 + greatest(episodes, 0)) as episodes_log,
        members / greatest(episodes, 1.0) as members_per_episode, rating * ln(1 + greatest(members, 0)) as engagement_index,
        case when members > -1 then case when members <= 100 then 'tiny' when members <= 1000 then 'small' when members <= 10000 then 'medium'
          when members <= 100000 then 'large' when members <= 1000000000 then 'huge' end end as members_band,
        case when episodes > -1 then case when episodes <= 1 then 'single' when episodes <= 12 then 'short' when episodes <= 26 then 'mid'
          when episodes <= 52 then 'long' when episodes <= 1000000 then 'series' end end as episodes_band,
        case when rating >= 0 then case when rating < 6.1 then 'Low' when rating < 6.8 then 'Medium' when rating < 7.3 then 'High' when rating < 11 then 'Top' end end as score_tier
        from clean0""",
    "profile": """select user_id, count(*) as n_ratings, round(avg(rating), 4) as mean_rating, round(coalesce(stddev_samp(rating), 0), 4) as std_rating,
        max(rating) as max_rating, min(rating) as min_rating, count(*) filter (where rating >= 8) as n_liked, count(*) filter (where rating <= 4) as n_disliked
        from ratings where rating > 0 group by user_id""",
    "segmented": """select r.user_id, r.rating, cast(r.user_id % 5 as integer) as segment, c.primary_genre, c.type, c.item_id
        from ratings r join clean c on c.item_id = r.item_id where r.rating > 0""",
    "favourites": """select user_id, cast(rank as integer) as rank, item_id, rating from (
        select *, row_number() over (partition by user_id order by rating desc, item_id) as rank
        from (select user_id, item_id, max(rating) as rating from ratings where rating >= 8 group by 1, 2) a) b where rank <= 12""",
    "taglines": "select item_id as basket, unnest(tags) as item from clean",
    "itemcounts": "select item, count(*) as freq from (select distinct basket, item from lines) a group by item having count(*) >= {LEAST}",
    "vecs": "select vec_id as id, label, list_transform(embedding, lambda v: cast(v as double)) as x from embeddings",
    "dims": "select id, label, unnest(x) as v, generate_subscripts(x, 1) as dim from vecs",
    "outcome": "select d.doc_id as id, l.quality as actual, d.lang, d.source, d.n_chars from documents d join labels l on l.doc_id = d.doc_id",
}
NEEDS = {
    "typed": ["titles"], "grouped": ["typed"], "clean0": ["grouped"], "clean": ["clean0"], "profile": ["ratings"], "segmented": ["ratings", "clean"],
    "favourites": ["ratings"], "taglines": ["clean"], "dims": ["vecs"],
}


def with_(names: str, select: str, **more: str) -> str:
    """`select` behind the named expressions and what they need; more: expressions of its own, in order."""
    order: list[str] = []

    def add(n: str) -> None:
        for k in NEEDS.get(n, []):
            add(k)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    parts = [f"{n} as ({CTES[n].replace('{TAGS}', TAGS)})" for n in order] + [f"{n} as ({s})" for n, s in more.items()]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + select


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep
