"""Connected components of a graph of ids, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.session import stage

#: a path of n ids needs about log2(n) rounds; this many rounds serve any graph
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """Every id of ``edges`` (a, b) with the smallest id it can reach: (id, component).

    Alternates two steps until every component is flat: every id hands its smallest neighbour to its larger
    neighbours, then to its smaller ones. Each step groups by id with a minimum, which is combined
    before the shuffle, and joins it back; a hot id is split by adaptive execution. Each round is
    written to the shared folder, so a lost executor costs one round. Loops (a = b), repeated and
    missing ends are ignored; an id without another neighbour is not returned.
    """
    links = stage(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    for _ in range(MAX_ROUNDS):
        if _is_flat(links):
            break
        links = stage(_small_star(_large_star(links)))
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def _is_flat(links: DataFrame) -> bool:
    """Whether every id has one smaller neighbour at most, which has none itself."""
    ups = links.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    downs = links.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    seen = ups.unionByName(downs).groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or up = 1 and down = 1").isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return (
        both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        .where("a <> b").distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    lowest = links.groupBy("a").agg(F.min("b").alias("low"))
    handed = links.join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    own = lowest.select("a", F.col("low").alias("b"))
    return handed.unionByName(own).where("a <> b").distinct()
