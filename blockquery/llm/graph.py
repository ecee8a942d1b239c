"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockquery.session import stored

MAX_ROUNDS = 60


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every node in ``links(a, b)``, root being the smallest node reachable.

    Each round hangs larger neighbours on the smallest one, then smaller ones,
    and is written to the shared folder; a star, however many nodes it has, is
    only ever aggregated, never gathered. An empty table gives an empty result.
    """
    edges = stored(_oriented(links.select("a", "b")), label)
    seen = _state(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = _oriented(large)
        small_least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(_oriented(small.unionAll(small_least.select("a", F.col("m").alias("b")))), label)
        now = _state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges with the larger node first, without loops."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
