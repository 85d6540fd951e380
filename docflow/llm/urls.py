"""URL filters: host and path rules first, then a ratio of two character models.

URLs that a rule decides teach two variable-order Markov models, one for accepted and
one for rejected URLs. A URL that no rule fits is scored by the difference of its mean
log10 likelihoods a character, and accepted from a threshold on that is calibrated on
rule-decided URLs kept out of the training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.llm import text as X
from docflow.llm.common import fold

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols: 0 the bounds of a URL, letters, digits, slash, dot, any other byte.
SYMBOLS = 40
SYMBOL = np.full(256, 39, dtype=np.int64)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[48:58] = np.arange(27, 37)
SYMBOL[[47, 46]] = 37, 38
ORDER = 3
#: Scores are calibrated in bins of this width.
BIN = 0.005


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, SMALL)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct<rule, verdict>, or null. rules: a list written by hand, not a table."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(column: pa.Array) -> Iterator[tuple[X.Chunk, np.ndarray, np.ndarray]]:
    """Codes of each character with the ORDER before it and of the end, with the row of each."""
    for c in X.chunks(column):
        n = np.diff(c.offsets) + 1
        row = np.repeat(np.arange(c.rows), n)
        first = np.cumsum(n) - n
        at = np.arange(n.sum()) - first[row]  # position within the row
        symbols = np.zeros(len(row), dtype=np.int64)
        symbols[at < n[row] - 1] = SYMBOL[c.data]
        code = symbols.copy()
        for k in range(1, ORDER + 1):
            before = np.zeros(len(row), dtype=np.int64)
            before[k:] = symbols[:-k] if k < len(symbols) else 0
            code += np.where(at >= k, before, 0) * SYMBOLS**k
        filled = n[row] > 1  # an empty URL has no symbols
        yield c, code[filled], row[filled]


def counted(urls: DataFrame) -> DataFrame:
    """label, code, n: how often each run of ORDER + 1 symbols occurs. urls: url, label."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=np.int64)
            for c, code, row in _grams(batch.column(0)):
                both, n = np.unique(code * 2 + label[c.first + row], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both % 2), pa.array(both // 2), pa.array(n)], ["label", "code", "n"])

    rows = urls.select("url", "label").mapInArrow(work, "label long, code long, n long")
    return rows.groupBy("label", "code").agg(F.sum("n").alias("n"))


def smoothed(counts: np.ndarray) -> np.ndarray:
    """log10 P(symbol | the ORDER before it) of counts of that shape.

    Each context's distribution is mixed with that of the context one symbol shorter,
    by the Witten-Bell weight: the more different symbols have followed, the more the
    shorter one counts. Contexts that were not seen leave all to the shorter one.
    """
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for k in range(ORDER + 1):
        n = counts.sum(axis=tuple(range(ORDER - k)), dtype=float)
        seen, kinds = n.sum(axis=-1, keepdims=True), (n > 0).sum(axis=-1, keepdims=True)
        lower = np.broadcast_to(p, n.shape)
        p = np.where(seen > 0, (n + kinds * lower) / np.maximum(seen + kinds, 1), lower)
    return np.log10(p)


def ratio_table(counts: DataFrame) -> np.ndarray:
    """log10 P(accepted) - log10 P(rejected) by code: SYMBOLS ** (ORDER + 1) figures, 10 MB, whatever the corpus."""
    both = np.zeros((2, SYMBOLS ** (ORDER + 1)))
    rows = counts.toArrow()  # at most 2 * SYMBOLS ** (ORDER + 1) rows
    both[rows["label"].to_numpy(), rows["code"].to_numpy()] = rows["n"].to_numpy()
    accepted, rejected = (smoothed(x.reshape([SYMBOLS] * (ORDER + 1))) if x.any() else 0 for x in (both[1], both[0]))
    table = np.zeros([SYMBOLS] * (ORDER + 1)) + (accepted - rejected if both.any(axis=1).all() else 0)
    return table.astype(np.float32).ravel()


def scored(urls: DataFrame, ratio: np.ndarray, url: str = "url") -> DataFrame:
    """urls with score, the mean of the ratio over a URL's characters; 0 for empty or null."""
    shared = urls.sparkSession.sparkContext.broadcast(ratio)
    names = urls.columns
    at = names.index(url)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [c.per_row(row, shared.value[code]) / np.maximum(c.per_row(row), 1) for c, code, row in _grams(batch.column(at))]
            yield X.passed(batch, names, {"score": pa.array(np.concatenate(parts) if parts else [], pa.float64())})

    return urls.mapInArrow(work, T.StructType([*urls.schema.fields, T.StructField("score", T.DoubleType())]))


def calibrated(held: DataFrame) -> float:
    """The threshold with the best mean of the two classes' hit rates, in the middle of equally good ones; 0 without both."""
    rows = held.groupBy("label", F.least(F.greatest(F.round(F.col("score") / BIN), F.lit(-2000)), F.lit(2000)).cast("int").alias("bin")).count().toArrow()
    n = np.zeros((2, 4001))
    n[rows["label"].to_numpy(), rows["bin"].to_numpy() + 2000] = rows["count"].to_numpy()  # at most 2 * 4001 rows
    if not n.any(axis=1).all():
        return 0.0
    accepted = n[1][::-1].cumsum()[::-1] / n[1].sum()  # from a bin on
    rejected = (n[0].cumsum() - n[0]) / n[0].sum()  # below it
    best = np.flatnonzero(np.isclose(accepted + rejected, (accepted + rejected).max()))
    return float((best[0] + best[-1] - 4000) / 2 * BIN - BIN / 2)


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] = RULES, folds: int = 5) -> DataFrame:
    """key, host, path, rule, verdict, score of each row.

    Rule-decided URLs of all but one of the folds (by crc32 of the key) are learnt, those
    of that one calibrate the threshold. Null, empty and odd URLs have an empty host and
    path, no rule and score 0. Where either class is missing, no rule means allow. Equal
    rows are judged each; an empty table gives an empty result.
    """
    known = pages.select(F.col(key), F.col(url).cast("string").alias("url"))
    known = known.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = known.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("_rule"))
    taught = known.where(F.col("_rule").isNotNull()).select("url", F.col("_rule.verdict").eqNullSafe("allow").cast("long").alias("label"), (fold(key, folds) == 0).alias("held"))
    ratio = ratio_table(counted(taught.where(~F.col("held"))))
    threshold = calibrated(scored(taught.where("held"), ratio))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored(known, ratio).select(key, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")
