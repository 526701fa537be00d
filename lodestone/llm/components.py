"""Connected components of a graph given as a table of links, by alternating large and small stars.

Each round rewires the links by two joins until nothing changes (Kiveris and
others, "Connected Components in MapReduce and Beyond", 2014). A node with a
third of all links is dealt to salts, both where the minimum of its neighbours
is found and where it is joined back. Each round is checkpointed in the shared
folder; the driver sees counts and checksums only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Parts that the rows of one key are dealt to.
SALTS = 64

def with_least(rows: DataFrame, key: str, value: str, by: str, name: str, salts: int = SALTS) -> DataFrame:
    """rows with the least `value` of all rows of the same `key` as `name`.

    A key's rows are dealt to salts by the hash of column `by`. The least value
    of each (key, salt) is a partial aggregate; a second one over at most
    `salts` rows per key gives the key's, which goes back to just the salts that
    the key has. So no task gathers a hot key, and the table that is joined back
    has no more rows than `rows`. Rows with a null key are left out; null values
    never are the least unless a key has no others.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    parts = salted.groupBy(key, "__salt").agg(F.min(value).alias(name))
    least = parts.groupBy(key).agg(F.min(name).alias(name), F.collect_set("__salt").alias("__salt"))
    return salted.join(least.withColumn("__salt", F.explode("__salt")), [key, "__salt"]).drop("__salt")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v), u > v. The large star links a node's larger neighbours to its least one, the small star its smaller ones."""
    # Each node x with its neighbours y: all of them for the large star, only the smaller ones for the small star.
    near = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if large:
        near = near.unionAll(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    joined = with_least(near, "x", "y", "y", "m").withColumn("m", F.least("m", "x"))
    if large:
        new = joined.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        new = joined.select(F.explode(F.array("y", "x")).alias("u"), F.col("m").alias("v"))
    return new.where("u <> v").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, root): every node that has a link, with the smallest node it reaches.

    Links are undirected, may repeat and may join a node to itself; rows with
    a null end are left out. An empty table gives an empty result.
    """
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = cut(pairs.distinct())
    alone = edges.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("root"))
    edges = edges.where("u <> v")
    seen = _digest(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        edges = cut(_star(_star(edges, True), False))
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    # At the end the links are stars: each node but the root has one link, to its root.
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return found.unionAll(roots).unionAll(alone).groupBy("node").agg(F.min("root").alias("root"))
