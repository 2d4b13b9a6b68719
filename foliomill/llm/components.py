"""Connected components of a link table, by alternating large and small stars.

Every round is two joins with pre-aggregated minima; nothing is gathered in one place. Rounds are
of the order of the logarithm of the longest chain. A round's links are written, and those of the round
before deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import forget, written

MAX_ROUNDS = 60


def _with_minima(arcs: DataFrame) -> DataFrame:
    """(a, b, m): m is the smallest of a and its neighbours.

    The minima are dealt anew for the join (hence the key written another way), so that adaptive
    execution can split the arcs of a hub over many tasks.
    """
    minima = arcs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    minima = minima.select(F.bitwise_not(F.bitwise_not("a")).alias("hub"), "m")
    return arcs.join(minima, F.col("a") == F.col("hub")).drop("hub")


def _large_star(links: DataFrame) -> DataFrame:
    """For each node, its larger neighbours are tied to the smallest neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return (
        _with_minima(both)
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Links (a, b) with b < a: a and all its smaller neighbours are tied to the smallest."""
    tied = _with_minima(links)
    return (
        tied.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(tied.select("a", F.col("m").alias("b")))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def components(links: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, root) for every node of links (a, b) of long ids; root is the smallest of its component."""
    now = written(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    before = None
    for _ in range(max_rounds):
        stars = written(_small_star(_large_star(now)), "links")
        forget(now)
        now = stars
        # The sum of roots falls with every change of the stars, and their count with merged links.
        mark = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = mark
    raise RuntimeError(f"components are not stable after {max_rounds} rounds")
