"""URL filters: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter.

Hosts, paths and rules are plain expressions. URLs that no rule decides are
canonicalised and probed in Arrow batches against a Bloom filter of the list,
each with its whole URL and with its host; only possible hits go to the exact
hash join with the list, which removes the false positives. All other rows never
move. Pages are read and probed once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .shared import ascii_lower, cut, ship

#: Rules that one expression holds at most.
MAX_RULES = 1000
#: Leading labels of a host that canonical URLs leave out.
LABELS = ("www.", "m.", "blog.")


def _after_scheme(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, lower-cased A-Z; empty for null or without ://."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """host/path without a leading www., m. or blog., a trailing slash or .html; null for an empty host."""
    bare = F.regexp_replace(host, "^(www|m|blog)\\.", "")
    short = F.regexp_replace(path, r"(\.html|/)$", "")
    return F.when(host != "", F.concat(bare, short))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as it is written (host and path), and its verdict; null for none.

    A rule fits its host and all subdomains, if the path starts with the
    rule's. Of rules of one length the first named wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; one expression holds {MAX_RULES} at most")
    named, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + rest))
        named, verdict = F.when(fits, F.lit(rule)).otherwise(named), F.when(fits, F.lit(what)).otherwise(verdict)
    return named, verdict


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", listed_url: str = "url", max_bytes: int = bloom.MAX_BYTES) -> DataFrame:
    """pages with host, path, rule, canonical and verdict: the rule's, else block if the list has the canonical URL or its host, else allow.

    listed: a table of canonical URLs; one of a host and a slash, such as
    `example.com/`, lists all URLs of that host. Null and repeated ones don't
    matter. Null URLs and URLs without :// have an empty host and path, fit no
    rule and are allowed. Input columns of the added names are replaced.
    """
    spark = pages.sparkSession
    ship(spark)
    pages = pages.drop("host", "path", "rule", "canonical", "verdict", "__site", "__h", "__s", "__may")
    own = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    named, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": named, "verdict": verdict, "canonical": canonical(F.col("host"), F.col("path")), "__site": F.concat(canonical(F.col("host"), F.lit("")), F.lit("/"))})
    exact = listed.where(F.col(listed_url).isNotNull()).select(F.col(listed_url).alias("listed")).distinct()
    bits = bloom.build(exact.select(F.xxhash64("listed").alias("h")), "h", max_bytes)
    sent = spark.sparkContext.broadcast(bits)
    open_ = F.col("rule").isNull() & F.col("canonical").isNotNull()
    own = own.withColumns({"__h": F.when(open_, F.xxhash64("canonical")), "__s": F.when(open_, F.xxhash64("__site"))})
    names = own.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = names.index("__h"), names.index("__s")
        for b in batches:
            asked = b.column(places[0]).is_valid().to_numpy(zero_copy_only=False)
            may = np.zeros(b.num_rows, bool)
            for place in places:
                may |= bloom.probe(sent.value, b.column(place).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(may & asked)], [*names, "__may"])

    probed = cut(own.mapInArrow(run, own.withColumn("__may", F.lit(False)).schema))
    out = [c for c in names if c not in ("__site", "__h", "__s")]
    rest = probed.where(~F.col("__may")).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    hits = probed.where("__may")
    for key, found in (("canonical", "__url"), ("__site", "__host")):
        hits = hits.join(exact.select(F.col("listed").alias(key), F.lit(True).alias(found)), key, "left")
    hits = hits.withColumn("verdict", F.when(F.coalesce("__url", "__host"), "block").otherwise("allow"))
    return rest.select(out).unionByName(hits.select(out))
