"""Quality rules of texts, and verdicts on their hosts.

Each text is measured and held against fixed rules. Failures are then summed by host and
each host's failure rate is shrunk to the rate of all hosts by a beta prior whose
strength comes from the hosts themselves (moments), so that a host with few documents
is not condemned by them. A host whose shrunk rate is above max_rate is rejected, and
that verdict is joined back to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.llm import text as X
from docflow.llm.common import stash

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True


def _measured(chunk: X.Chunk) -> dict[str, np.ndarray]:
    data, offsets = chunk.data, chunk.offsets
    by_row = lambda marks: np.diff(np.append(0, np.cumsum(marks))[offsets])
    inside = ~X.SEPARATOR[data]
    keys, at = X.runs(chunk.word_keys(), chunk.row, 3)
    many, _ = X.repeated(keys, chunk.row[at])
    covered = np.zeros(len(chunk.starts), dtype=bool)
    for i in range(3):
        covered[at[many] + i] = True
    # lines: a text of n line feeds has n + 1
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], feeds]), kind="stable")
    row = np.repeat(np.arange(chunk.rows), by_row(data == 10) + 1)
    worded = np.searchsorted(chunk.starts, ends) > np.searchsorted(chunk.starts, starts)
    starts, ends, row = starts[worded], ends[worded], row[worded]
    _, later = X.repeated(chunk.keys(starts, ends), row)
    return {
        "n_words": chunk.per_row(chunk.row),
        "word_chars": by_row(inside & ((data & 0xC0) != 0x80)),
        "n_symbols": by_row(SYMBOL[data]),
        "n_dup_lines": chunk.per_row(row[later]),
        "n_repeat_words": chunk.per_row(chunk.row[covered]),
    }


def measure(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep and the five measures of each row's whole text.

    n_words; word_chars, code points in words; n_symbols, characters of #*$%&|<>;
    n_dup_lines, lines with a word that equal an earlier line; n_repeat_words, words
    within 3-word windows that the text holds twice or more. Null is empty text, with
    all measures 0. The columns of keep must not bear the measures' names.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_measured(c) for c in X.chunks(batch.column(len(keep)))]
            out = {m: pa.array(np.concatenate([p[m] for p in parts]) if parts else [], pa.int64()) for m in MEASURES}
            yield X.passed(batch, keep, out)

    schema = T.StructType([*(docs.schema[k] for k in keep), *(T.StructField(m, T.LongType()) for m in MEASURES)])
    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(work, schema)


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    """The fixed rules: too few words, or too many of them in repeated windows."""
    n, r = F.col("n_words"), F.col("n_repeat_words")
    return (n < min_words) | (100 * r > max_repeat_percent * n)


def host_rates(judged: DataFrame, host: str, failed: str) -> DataFrame:
    """One row per host: n, n_failed, rate and shrunk_rate.

    The prior of the rates is a beta distribution with the mean m of all documents and
    the strength k = m (1 - m) / t - 1, where t is the variance between hosts (weighted
    by documents) less what sampling explains. Where t leaves no strength above 0 the
    hosts are taken to differ by chance only and shrunk_rate is m. A null host is a
    host of its own.
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    hosts = stash(hosts, "hosts")
    m = (F.sum("n_failed") / F.sum("n")).alias("m")
    mean = hosts.agg(m, F.count("*").alias("hosts"), F.sum("n").alias("docs"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n")).alias("squares")).first()
    if not mean.docs:
        return hosts.selectExpr("*", "cast(null as double) rate", "cast(null as double) shrunk_rate")
    rate, spread = mean.m, mean.m * (1 - mean.m)
    between = mean.squares / mean.docs - rate * rate - spread * mean.hosts / mean.docs
    strength = spread / between - 1 if between > 1e-12 else -1.0
    shrunk = (F.col("n_failed") + rate * strength) / (F.col("n") + strength) if strength > 0 else F.lit(rate)
    return hosts.select("*", (F.col("n_failed") / F.col("n")).alias("rate"), shrunk.alias("shrunk_rate"))


def judge(docs: DataFrame, keep: list[str], host: str = "source", text: str = "text", max_rate: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Each row's columns keep (host among them), measures, base_failed, host_rate and kept.

    kept is false where the row's own text fails, or where its host is rejected. Empty
    and null texts fail (no words). Equal rows are counted and returned each. An empty
    table gives an empty result. Other columns of docs are not read, whatever their names.
    """
    judged = stash(measure(docs, keep, text).withColumn("base_failed", base_failed(min_words, max_repeat_percent)), "measures")
    hosts = host_rates(judged, host, "base_failed").select(F.col("host").alias("_host"), F.col("shrunk_rate").alias("host_rate"))
    joined = judged.join(hosts, F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("host_rate"), F.lit(0.0)) <= max_rate))
