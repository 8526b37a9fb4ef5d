"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, forget

#: Pairs for each task of a round.
PAIRS = 250_000


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on pairs (a, b) with a > b. Minima are partial sums; the join back is on single rows, which may be split."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))  # AQE may broadcast it where it is small
    joined = both.join(least, "a")
    moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the pairs (a, b); the root is the component's smallest node.

    Each round is written in the shared folder. Rounds end when the pairs no longer change, which takes
    about the logarithm of the longest path.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    state, last, tasks = None, None, 1 + edges.count() // PAIRS
    while True:
        pairs = cut(_stars(_stars(pairs, True).coalesce(tasks), False).coalesce(tasks))
        if last:
            forget(last)
        last = pairs
        r = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (r.n, r.s) == state:
            break
        state = (r.n, r.s)
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
