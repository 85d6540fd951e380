"""Lines that a site repeats.

For each host, the pages that hold a line are divided by the host's pages. A line above
the ratio is boilerplate of that host and goes from all its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import stash

TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _key(line: Column) -> Column:
    """A 128-bit key of a line without white space at its ends: as text, so that it is compared as a whole."""
    line = F.regexp_replace(line, TRIM, "")
    return F.when(line != "", F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.1, min_pages: int = 10) -> DataFrame:
    """host and keys: the lines in more than max_ratio of a host's pages, and in min_pages of them at least.

    The ratios of a host's lines sum to its mean lines a page, so at most 1 / max_ratio
    times as many lines can be above max_ratio: the array of a host is short however
    many pages it has. Lines are counted once a page. A null host is a host of its own.
    """
    each = docs.select(F.col(host).alias("_host"), F.array_distinct(F.transform(_lines(F.col(text)), _key)).alias("keys"))
    each = each.select("_host", F.explode(F.filter("keys", lambda k: k.isNotNull())).alias("key"))
    counted = each.groupBy("_host", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    hosts = docs.groupBy(F.col(host).alias("_of")).agg(F.count("*").alias("host_pages"))
    found = counted.join(hosts, F.col("_host").eqNullSafe(F.col("_of"))).where(F.col("pages") > F.col("host_pages") * max_ratio)
    return found.groupBy("_host").agg(F.collect_list("key").alias("keys"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.1, min_pages: int = 10) -> DataFrame:
    """docs with text less its host's boilerplate lines, and _n_lines and _n_dropped.

    Blank lines stay. Null text stays null with no lines; empty text has one blank line.
    Other columns and repeated rows pass through; an empty table gives an empty result.
    """
    # written, so that its size is known when the join is planned: hosts below the broadcast threshold spare the texts a shuffle
    found = stash(boilerplate(docs, host, text, max_ratio, min_pages).select(F.col("_host"), F.col("keys").alias("_keys")), "boilerplate")
    joined = docs.join(found, F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host")
    lines = _lines(F.col(text))
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("_keys"), _key(x)), F.lit(False)))
    affected = F.col("_keys").isNotNull() & F.col(text).isNotNull()
    joined = joined.withColumn("_kept", F.when(affected, kept))
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
    return joined.withColumns(
        {
            "_n_lines": n,
            "_n_dropped": F.when(affected, n - F.size("_kept")).otherwise(0).cast("long"),
            text: F.when(affected, F.array_join("_kept", "\n")).otherwise(F.col(text)),
        }
    ).drop("_kept", "_keys")
