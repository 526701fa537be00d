"""The ten operators as queries on the driver's tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, line_dedup, mixing, passage_dedup, quality, simhash, token_counts, token_files, url_filter
from .shared import fresh_path, read

TOKENIZER, VOCABULARY = "byte_bpe_50k.json", 50257
#: Lines in at least so many documents go.
LINE_DOCS = 10
#: Host and path rules.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: The list has these hosts of these domains, with all their pages.
LISTED_HOSTS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_DOMAINS = ("example.com", "example.net", "example.org")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    bitmaps = line_dedup.keep_bitmaps(docs, LINE_DOCS, "all")
    kept = line_dedup.apply_bitmaps(docs, bitmaps)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = f"""
with lines as (
  select doc_id, i, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(a) as l, generate_subscripts(a, 1) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents) d) x
), gone as (select k from lines where k <> '' group by k having count(distinct doc_id) >= {LINE_DOCS})
select d.doc_id, cast(count(*) as bigint) as n_lines, cast(count(g.k) as bigint) as n_dropped,
       sha256(coalesce(string_agg(l.l, chr(10) order by l.i) filter (where g.k is null), '')) as kept_sha256
from documents d join lines l on l.doc_id = d.doc_id left join gone g on g.k = l.k
group by d.doc_id
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.repeated_passages(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # The text itself need not come back from the scan.
    scanned = decontaminate.verdicts(decontaminate.scan(docs, read(spark, sf_dir, "benchmark")))
    items = F.sha2(F.array_join("scan.items", ",").cast("binary"), 256)
    return scanned.select("doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated")


_WORDS3 = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP3_SQL = f"""
with items as (select cast(item_id as varchar) as item, {_WORDS3} as w from benchmark where item_id is not null),
windows as (
  select distinct item, len(win) as n, array_to_string(win, ' ') as win from (
    select item, w[s:s + least(len(w), {decontaminate.WINDOW}) - 1] as win
    from (select item, w, unnest(generate_series(1, greatest(len(w) - {decontaminate.WINDOW} + 1, 1))) as s from items where len(w) > 0) a) b),
sizes as (select distinct n from windows),
docs as (select doc_id, {_WORDS3} as w from documents),
runs as (
  select doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as s from docs, sizes where len(w) >= n) a),
hits as (select r.doc_id, r.s, r.n, x.item from runs r join windows x on x.n = r.n and x.win = r.win),
hit_words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(s, s + n - 1)) as p from hits) a group by doc_id),
hit_items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) a group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs d left join hit_words h on h.doc_id = d.doc_id left join hit_items i on i.doc_id = d.doc_id
"""


def listed_urls(spark: SparkSession) -> DataFrame:
    """The canonical URLs on the list: whole hosts."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(f"{h}.{d}/") for h in LISTED_HOSTS for d in LISTED_DOMAINS])).alias("url"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), listed_urls(spark), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


_RULES4 = ", ".join(f"('{v}', '{r}', '{r.split('/')[0]}', '{r[r.index('/'):]}')" for v, r in URL_RULES)
_LISTED4 = "'^(" + "|".join(LISTED_HOSTS) + ")[.](" + "|".join(d.replace(".", "[.]") for d in LISTED_DOMAINS) + ")$'"
OP4_SQL = f"""
with parsed as (
  select page_id, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
parts as (
  select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from parsed),
ruled as (
  select p.page_id, arg_max(x.rule, length(x.rule)) as rule, arg_max(x.verdict, length(x.rule)) as verdict
  from parts p join (values {_RULES4}) x(verdict, rule, host, path)
    on (p.host = x.host or ends_with(p.host, '.' || x.host)) and starts_with(p.path, x.path) group by p.page_id)
select p.page_id, p.host, p.path, u.rule,
       coalesce(u.verdict, case when regexp_matches(regexp_replace(p.host, '^(www|m|blog)[.]', ''), {_LISTED4}) then 'block' else 'allow' end) as verdict
from parts p left join ruled u on u.page_id = p.page_id
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_quality")
    return scored.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in counts])


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, tokenizer_path())
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(spark, read(spark, sf_dir, "documents"))


def token_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs written as token files and read back."""
    at = fresh_path(spark, "tokens")
    token_files.write(docs, at, tokenizer_path(), VOCABULARY)
    return token_files.read(spark, at).withColumnRenamed("doc", "doc_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"), notices=license_scan.NOTICES, whole=license_scan.TEXTS).withColumnRenamed("doc", "doc_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return mixing.Mix(read(spark, sf_dir, "documents")).counted(shards).withColumnRenamed("doc", "doc_id")


def queries() -> dict:
    ops = (op1_line_dedup, op2_substring_dedup, op3_decontamination, op4_url_filter, op5_quality_rules, op6_token_counts, op7_token_files, op8_simhash, op9_license_scan, op10_mixing)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op3_decontamination": OP3_SQL, "op4_url_filter": OP4_SQL}
