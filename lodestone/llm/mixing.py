"""Mixing sources to target weights, with DataFrame operations only.

Every source's documents are dealt by hash into blocks. What a source gives is
a quota of block draws: each full pass draws all of its blocks, and the rest of
its target is drawn in a permuted order of the blocks, the last one in part. A
splitting tree deals the quotas of all sources among the output shards: at each
node the draws of the left half are a multivariate hypergeometric sample of the
node's, down to one shard, so that every shard is an exact random sample of the
mix. A shard then takes its quota of each source's permuted blocks, disjoint
from all others', and shuffles its rows by hash.

The driver sees one row per source (at most MAX_SOURCES) and runs the tree on
their quotas. Windows run over block rows, or over the documents of one block
per source; no group of documents meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD_RE, cut, text_key

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Documents of a block, about; blocks of a source and sources at most.
BLOCK_ROWS, MAX_BLOCKS, MAX_SOURCES = 512, 1 << 20, 10_000
SEED = 42
#: Draws that the library's own hypergeometric distribution takes.
LIBRARY_RANGE = 1_000_000_000


@dataclass
class Source:
    name: str | None
    rows: int
    size: int
    weight: float
    target: float = 0.0

    @property
    def passes(self) -> int:
        return int(self.target // self.size) if self.size else 0

    @property
    def rest(self) -> int:
        return round(self.target - self.passes * self.size)

    @property
    def blocks(self) -> int:
        return max(1, min(MAX_BLOCKS, -(-self.rows // BLOCK_ROWS)))


def set_targets(sources: list[Source], total: float | None = None, most: float = MAX_REPEATS) -> None:
    """Share `total` (all sizes) by weight; no target is over `most` times its size, the excess is reshared by weight."""
    left = float(sum(s.size for s in sources) if total is None else total)
    left = min(left, most * sum(s.size for s in sources))
    free = [s for s in sources if s.size > 0]
    while free:
        weights = sum(s.weight for s in free)
        over = [s for s in free if left * s.weight / weights > most * s.size]
        if not over:
            for s in free:
                s.target = left * s.weight / weights
            break
        for s in over:
            s.target = float(most * s.size)
            left -= s.target
        free = [s for s in free if s not in over]


def _hypergeometric(random, good: int, bad: int, want: int) -> int:
    """How many of `want` draws from good + bad are good. Beyond the library's range: by the inverse of the distribution, 12 deviations about the mode."""
    import numpy as np

    if not want or not good:
        return 0
    total = good + bad
    if total < LIBRARY_RANGE:
        return int(random.hypergeometric(good, bad, want))
    low, high = max(0, want - bad), min(good, want)
    share = want / total
    deviation = (good * share * (1 - share) * bad / max(total - 1, 1)) ** 0.5
    mode = min(max((want + 1) * (good + 1) // (total + 2), low), high)
    reach = int(12 * deviation) + 30
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(want - k) - np.log(k + 1) - np.log(bad - want + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.cumsum(np.exp(logs - logs.max()))
    return low + int(min(np.searchsorted(p, random.random() * p[-1], "right"), high - low))


def split_quotas(quotas: Sequence[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """For each shard its exact number of draws from each source, by the splitting tree. Quotas may be of any size."""
    import numpy as np

    random = np.random.Generator(np.random.PCG64(seed))
    out: list[list[int]] = [[]] * shards

    def split(counts: list[int], a: int, b: int) -> None:
        if b - a == 1:
            out[a] = counts
            return
        middle, total = (a + b) // 2, sum(counts)
        want = total * (middle - a) // (b - a)
        left, others = [], total
        for n in counts:  # one source after the other: hypergeometric given those before
            others -= n
            x = _hypergeometric(random, n, others, want)
            left.append(x)
            want -= x
        split(left, a, middle)
        split([n - x for n, x in zip(counts, left, strict=True)], middle, b)

    split(list(quotas), 0, shards)
    return out


def _literal(x) -> str:
    if x is None:
        return "cast(null as string)"
    if isinstance(x, str):
        return f"cast(X'{x.encode().hex()}' as string)"
    return f"cast({x!r} as double)" if isinstance(x, float) else f"cast({x} as long)"


def _table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.sql("select * from values " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f" as t({columns})")


def _order(*parts: Column) -> Column:
    return F.xxhash64(F.lit(SEED), *parts)


class Mix:
    """The plan of one mix: `documents` with what is taken of each, and `rows` of the mixed corpus."""

    def __init__(self, docs: DataFrame, weights: Sequence[float] = WEIGHTS, total: float | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source"):
        """Sizes are counted in words (null: none). Sources stand in code-point order, null last, and weigh `weights`, repeating.

        Documents of no words are never drawn by the rest of a target, but by
        full passes as all others. Rows alike in id and text lie in one block.
        An empty table, or one without words, takes nothing.
        """
        self.docs, self.doc_id, self.text, self.source = docs, doc_id, text, source
        size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_RE)), F.lit(0)).cast("long")
        # The plan needs ids, hashes and sizes: a small table, kept so that the texts are read once.
        self.sized = cut(docs.select(F.col(doc_id).alias("doc"), text_key(F.col(text)).alias("tk"), F.col(source).cast("string").alias("source"), size.alias("size")))
        stats = self.sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
        if len(stats) > MAX_SOURCES:
            raise ValueError(f"over {MAX_SOURCES} sources; group them before mixing")
        stats.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
        self.sources = [Source(r.source, r.n, r["size"], weights[i % len(weights)]) for i, r in enumerate(stats)]
        set_targets(self.sources, total)
        spark = docs.sparkSession
        rows = [(i, s.name, s.size, s.target, s.passes, s.rest, s.blocks) for i, s in enumerate(self.sources)]
        columns = "no, source, source_size, target, passes, rest, blocks"
        self.plan = _table(spark, rows or [(0, "", 0, 0.0, 0, 0, 1)], columns)
        if not rows:
            self.plan = self.plan.where("false")
        self._draw()

    def _placed(self, rows: DataFrame, source: Column, doc: Column, tk: Column) -> DataFrame:
        """rows with the columns of their source's plan, and their block."""
        plan = F.broadcast(self.plan.withColumnRenamed("source", "__source"))
        joined = rows.join(plan, source.eqNullSafe(F.col("__source"))).drop("__source")
        return joined.withColumn("block", F.pmod(_order(doc, tk), F.col("blocks")))

    def _draw(self) -> None:
        own = self._placed(self.sized, self.sized["source"], F.col("doc"), F.col("tk"))
        blocks = own.groupBy("no", "block").agg(F.sum("size").alias("bsize"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
        order = Window.partitionBy("no").orderBy(_order(F.col("no"), F.col("block")), "block")
        before = F.coalesce(F.sum("bsize").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        blocks = blocks.withColumn("before", before).withColumn("room", F.col("rest") - F.col("before"))
        #: extra: 1 for a block that the rest of the target takes whole; room: what it takes of the block at its end.
        self.blocks = cut(blocks.select("no", "block", "passes", (F.col("bsize") <= F.col("room")).cast("int").alias("extra"), F.when((F.col("room") > 0) & (F.col("bsize") > F.col("room")), F.col("room")).alias("room")))
        part = own.join(self.blocks.where("room is not null").select("no", "block", "room"), ["no", "block"]).where("size > 0").select("no", "block", "doc", "tk", "size", "room")
        # Documents of the last block in random order while they fit, then of the others the shortest ones that still fit.
        random = Window.partitionBy("no", "block").orderBy(_order(F.lit(1), F.col("doc"), F.col("tk")), "doc", "tk").rowsBetween(Window.unboundedPreceding, 0)
        part = part.withColumn("sum", F.sum("size").over(random))
        whole = Window.partitionBy("no", "block")
        part = part.withColumn("left", F.col("room") - F.coalesce(F.max(F.when(F.col("sum") <= F.col("room"), F.col("sum"))).over(whole), F.lit(0)))
        fits = F.col("sum") <= F.col("room")
        short = Window.partitionBy("no", "block", fits).orderBy("size", _order(F.lit(2), F.col("doc"), F.col("tk")), "doc", "tk").rowsBetween(Window.unboundedPreceding, 0)
        part = part.withColumn("short", F.sum("size").over(short)).where(fits | (F.col("short") <= F.col("left")))
        #: (no, block, doc, tk, picks): documents that the last block gives; picks of rows alike.
        self.picks = cut(part.groupBy("no", "block", "doc", "tk").agg(F.count(F.lit(1)).alias("picks")))

    def documents(self) -> DataFrame:
        """(doc, size, source_size, target, taken): of every row, the words that the mix takes of it."""
        own = self._placed(self.sized, self.sized["source"], F.col("doc"), F.col("tk"))
        own = own.join(self.blocks.select("no", "block", "extra", "room"), ["no", "block"])
        picked = self._pick(own.where("room is not null"))
        times = F.col("passes") + F.col("extra")
        cols = ["doc", "size", "source_size", "target"]
        return own.where("room is null").select(*cols, (F.col("size") * times).alias("taken")).unionAll(picked.select(*cols, (F.col("size") * (times + F.col("picked"))).alias("taken")))

    def _pick(self, rows: DataFrame) -> DataFrame:
        """rows of last blocks with `picked` 0 or 1; of rows alike as many as were picked."""
        picks = self.picks.select(F.col("no").alias("__no"), F.col("block").alias("__b"), F.col("doc").alias("__d"), F.col("tk").alias("__t"), "picks")
        on = (rows["no"] == picks["__no"]) & (rows["block"] == picks["__b"]) & rows["doc"].eqNullSafe(picks["__d"]) & (rows["tk"] == picks["__t"])
        nth = F.row_number().over(Window.partitionBy("no", "block", "doc", "tk").orderBy(F.lit(1)))
        return rows.withColumn("nth", nth).join(picks, on, "left").withColumn("picked", (F.coalesce("picks", F.lit(0)) >= F.col("nth")).cast("int"))

    def rows(self, shards: int) -> DataFrame:
        """The mixed corpus: the input's columns, every document as often as it is drawn, in `shards` shuffled partitions."""
        spark = self.docs.sparkSession
        full = self.blocks.select("no", "block", F.lit(False).alias("part"), F.explode(F.when(F.col("passes") + F.col("extra") > 0, F.sequence(F.lit(1), F.col("passes") + F.col("extra")))).alias("draw"))
        partial = self.blocks.where("room is not null").select("no", "block", F.lit(True).alias("part"), F.lit(0).cast("long").alias("draw"))
        draws = full.select("no", "block", "part", F.col("draw").cast("long").alias("draw")).unionAll(partial)
        counts = {r.no: r.n for r in draws.groupBy("no").agg(F.count(F.lit(1)).alias("n")).collect()}
        numbers = sorted(counts)
        quotas = split_quotas([counts[n] for n in numbers], shards)
        # Where each shard's draws of a source end: one text for each source, so that the plan stays small.
        ends = [(n, ",".join(map(str, accumulate(own)))) for n, own in zip(numbers, zip(*quotas, strict=True), strict=True)]
        bounds = _table(spark, ends or [(0, "0")], "no, ends").select("no", F.split("ends", ",").cast("array<bigint>").alias("ends"))
        place = F.row_number().over(Window.partitionBy("no").orderBy(_order(F.lit(3), F.col("no"), F.col("block"), F.col("draw")), "block", "draw"))
        dealt = draws.withColumn("place", place).join(F.broadcast(bounds), "no")
        dealt = dealt.select("no", "block", "part", "draw", F.size(F.filter("ends", lambda e: e < F.col("place"))).alias("shard"))
        names = self.docs.columns
        own = self.docs.select(F.struct(*[F.col(c) for c in names]).alias("__row"), F.col(self.doc_id).alias("doc"), text_key(F.col(self.text)).alias("tk"), F.col(self.source).cast("string").alias("source"))
        own = self._placed(own, own["source"], F.col("doc"), F.col("tk")).select("__row", "doc", "tk", "no", "block")
        whole = own.join(dealt.where(~F.col("part")), ["no", "block"]).select("__row", "doc", "tk", "draw", "shard")
        part = self._pick(own.join(F.broadcast(dealt.where("part")), ["no", "block"])).where("picked = 1").select("__row", "doc", "tk", "draw", "shard")
        mixed = whole.unionAll(part).repartitionById(shards, "shard")
        return mixed.sortWithinPartitions("shard", _order(F.lit(4), F.col("doc"), F.col("tk"), F.col("draw")), "doc", "tk", "draw").select("__row.*")

    def counted(self, shards: int) -> DataFrame:
        """The rows of `documents`, with `taken` counted from the mixed shards."""
        source = F.col(self.source).cast("string")
        drawn = self.rows(shards).select(F.col(self.doc_id).alias("__d"), text_key(F.col(self.text)).alias("__t"), source.alias("__s")).groupBy("__d", "__t", "__s").agg(F.count(F.lit(1)).alias("draws"))
        # Of rows alike, the first ones have a draw more.
        alike = Window.partitionBy("doc", "tk", "source")
        own = self.sized.withColumns({"alike": F.count(F.lit(1)).over(alike), "nth": F.row_number().over(alike.orderBy(F.lit(1)))})
        on = own["doc"].eqNullSafe(drawn["__d"]) & (own["tk"] == drawn["__t"]) & own["source"].eqNullSafe(drawn["__s"])
        own = own.join(drawn, on, "left").withColumn("draws", F.coalesce("draws", F.lit(0)))
        times = F.floor(F.col("draws") / F.col("alike")) + (F.col("nth") <= F.col("draws") % F.col("alike")).cast("int")
        placed = self._placed(own, own["source"], F.col("doc"), F.col("tk"))
        return placed.select("doc", "size", "source_size", "target", (F.col("size") * times).alias("taken"))
