"""Connected components of a table of links, by joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import drop_stash, stash


def _larger(links: DataFrame) -> DataFrame:
    """Each node's neighbours above it, linked with the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m"))
    above = both.where(F.col("b") > F.col("a"))
    return above.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _smaller(links: DataFrame) -> DataFrame:
    """Each node and its neighbours below it, linked with the least of them. links: a > b."""
    least = links.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    below = links.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return below.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component: the least node that links(a, b) lead to, for each node that has a link.

    Large-star and small-star rounds until nothing changes; each round's links are
    written to the shared folder. Links of a node with itself don't count.
    """
    now = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % (1 << 40)), F.lit(0))).first())
    before = mark(now)
    while before[0]:
        new = stash(_smaller(_larger(now)), "links")
        drop_stash(now)
        now, after = new, mark(new)
        if after == before:
            break
        before = after
    heads = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads)
