"""Passages that another document has too, found by Rabin-Karp hashes of every window of words.

A window is WIDTH consecutive words of one document. Its hash is the polynomial of its words' keys at
two bases modulo 2^31 - 1, drawn for each job, taken from sums before each place; so it costs the
same at any width. Spark counts the hashes. Three steps keep what it shuffles small, and none changes the result:

1. Rows of one text (by SHA-256) are one class; only its least document takes part.
2. A window's anchor is the least hash of the runs of WIDTH / 2 words in it. Equal windows have equal
   anchors, and consecutive windows mostly share one, so there is about one anchor for each 13 words.
   Anchors are counted first: a window whose anchor only one class has is in no other document.
3. The hashes of all other windows are counted; each learns the least document that it starts in.

A window that starts in a lesser document is repeated; repeated windows that overlap or touch merge into
maximal intervals, which are removed. Windows are judged on the texts as they came.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm import text as X
from docflow.llm.common import drop_stash, met, small_batches, stash

WIDTH = 50
RUNS = "array<struct<first:int,last:int>>"


def bases() -> tuple[int, int]:
    """Two bases for one job, so that no text can be written to collide."""
    draw = random.SystemRandom()
    return draw.randrange(1 << 20, (1 << 31) - 2), draw.randrange(1 << 20, (1 << 31) - 2)


class Rolling:
    """Rabin-Karp hashes of the windows of any width over a chunk's words."""

    def __init__(self, chunk: X.Chunk, of: tuple[int, int]):
        keys, self.row, self.n, self.of = chunk.word_keys(), chunk.row, len(chunk.row), of
        self.sums = []
        for k, base in enumerate(of):
            values = X.reduced(keys >> np.uint64(32 * k) & np.uint64((1 << 32) - 1)) + np.uint64(1)
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(X.reduced(X.powers(base, self.n) * values), out=sums[1:])
            self.sums.append(sums)

    def at(self, width: int) -> np.ndarray:
        """The hash of the width words from each place that has so many after it in the chunk."""
        m = max(0, self.n - width + 1)
        out = np.zeros(m, dtype=np.uint64)
        for base, sums in zip(self.of, self.sums, strict=True):
            down = X.powers(pow(base, -1, int(X.PRIME)), self.n + 1)[:m]
            out = (out << np.uint64(32)) | X.reduced(X.reduced(sums[width:] - sums[:m]) * down)
        return X.mix(out)

    def windows(self, width: int) -> np.ndarray:
        """The places where a window of one row begins."""
        return np.flatnonzero(self.row[: max(0, self.n - width + 1)] == self.row[width - 1 :]) if self.n >= width else np.zeros(0, np.int64)

    def anchors(self, width: int) -> np.ndarray:
        """The least hash of the runs of width // 2 words within the window at each place."""
        least = self.at(max(1, width // 2))
        take, have = width - max(1, width // 2) + 1, 1  # runs in a window; runs that least covers
        while have < take:
            step = min(have, take - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        return least


def _words(text: str | None) -> list[bytes]:
    """bytes.split() cuts at 0x20 and 0x09-0x0D alone."""
    return (text or "").encode().split()


def _lists(values: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    offsets = np.append(0, np.cumsum(np.bincount(row, minlength=rows)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def _measured(docs: DataFrame, width: int, of: tuple[int, int]) -> DataFrame:
    """_id, _sha, n_words, whole (the digest of all words) and anchors of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            found = [_words(t) for t in texts.to_pylist()]
            whole = [hashlib.sha256(b" ".join(w)).hexdigest() for w in found]
            lists = []
            for c in X.chunks(texts):
                rolling = Rolling(c, of)
                at = rolling.windows(width)
                value, row = (rolling.anchors(width)[at], c.row[at]) if len(at) else (np.zeros(0, np.uint64), at)
                new = np.append(True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])) if len(at) else np.zeros(0, bool)
                lists.append(_lists(value[new], row[new], c.rows))
            anchors = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, found), pa.int64()), pa.array(whole, pa.string()), anchors], ["_id", "_sha", "n_words", "whole", "anchors"])

    return docs.select("_id", "_sha", "_text").mapInArrow(work, "_id long, _sha binary, n_words long, whole string, anchors array<long>")


def _hashed(docs: DataFrame, width: int, of: tuple[int, int]) -> DataFrame:
    """_id, _sha, at and key: the windows whose anchors are among the row's shared ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column(3)
            for c in X.chunks(batch.column(2)):
                rolling = Rolling(c, of)
                at = rolling.windows(width)
                if not len(at):
                    continue
                anchors = rolling.anchors(width)[at].view(np.int64)
                mine = shared.slice(c.first, c.rows)
                owner = np.repeat(np.arange(c.rows), np.diff(mine.offsets.to_numpy()))
                known = X.mix(mine.flatten().to_numpy().view(np.uint64) + owner.astype(np.uint64) * X.STEPS[0])
                at = at[np.isin(X.mix(anchors.view(np.uint64) + c.row[at].astype(np.uint64) * X.STEPS[0]), known)]
                row = c.row[at]
                first = np.searchsorted(c.row, np.arange(c.rows))
                take = pa.array(row + c.first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(at - first[row], pa.int32()), pa.array(rolling.at(width)[at].view(np.int64))], ["_id", "_sha", "at", "key"])

    return docs.select("_id", "_sha", "_text", "shared").mapInArrow(work, "_id long, _sha binary, at int, key long")


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """key, least and n of the keys that rows of two or more _id have, written."""
    found = rows.groupBy(key).agg(F.min("_id").alias("least"), F.max("_id").alias("most"), F.count("*").alias("n"))
    return stash(found.where("least < most").drop("most"), "shared")


def _merged(places: DataFrame, width: int) -> DataFrame:
    """_id, _sha and runs: windows at places, merged where they overlap or touch, as intervals of words [first, last)."""
    order = Window.partitionBy("_id", "_sha").orderBy("at")
    new = F.coalesce(F.col("at") > F.lag("at").over(order) + width, F.lit(True)).cast("int")
    numbered = places.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    runs = numbered.groupBy("_id", "_sha", "run").agg(F.min("at").alias("first"), (F.max("at") + width).alias("last"))
    return runs.groupBy("_id", "_sha").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """A row for each row of docs: key, sha (of its text), n_words, whole (the digest of its words), runs.

    runs are the maximal intervals [first, last) of words covered by windows that also start in a document
    of a smaller key; empty if there are none. Null text is empty text. A row without a key is
    before and after none: its words stay, and it makes no other's go. Rows of one key, of equal texts or not, don't
    count against each other. A text of fewer than width words has no window. Other columns aren't read.
    An empty table gives an empty result.
    """
    return _repeats(docs, key, text, width)[0]


def _repeats(docs: DataFrame, key: str, text: str, width: int) -> tuple[DataFrame, DataFrame]:
    """repeats(), and the texts of the rows that have an interval found by windows: _id, _sha, _text."""
    small_batches(docs.sparkSession)
    of = bases()
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.unhex(F.sha2(value, 256)).alias("_sha"), value.alias("_text"))
    measured = stash(_measured(rows, width, of), "measured")

    able = measured.where((F.col("n_words") >= width) & F.col("_id").isNotNull())
    classes = stash(able.groupBy("_sha").agg(F.min("_id").alias("_id"), F.first("anchors").alias("anchors")), "classes")
    anchors = classes.select("_id", "_sha", F.explode(F.array_distinct("anchors")).alias("anchor"))
    found = _shared(anchors, "anchor")
    wanted = met(anchors, found, "anchor", ["least"]).groupBy("_id", "_sha").agg(F.collect_set("anchor").alias("shared"))
    texts = stash(rows.where("_id is not null").join(wanted, ["_id", "_sha"]).dropDuplicates(["_id", "_sha"]), "texts")
    hashed = stash(_hashed(texts, width, of), "windows")
    drop_stash(found)
    least = _shared(hashed, "key")
    places = met(hashed, least, "key", ["least"]).where(F.col("least") < F.col("_id")).select("_id", "_sha", "at")
    merged = stash(_merged(places, width), "runs")
    drop_stash(hashed, least)

    copies = classes.select("_sha", F.col("_id").alias("_least"))
    out = measured.drop("anchors").join(copies, "_sha", "left").join(merged, ["_id", "_sha"], "left")
    all_words = F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("last")))
    runs = F.when(F.col("_least") < F.col("_id"), all_words).otherwise(F.coalesce("runs", F.array().cast(RUNS)))
    return out.select(F.col("_id").alias(key), F.col("_sha").alias("sha"), "n_words", "whole", runs.cast(RUNS).alias("runs")), texts.join(merged, ["_id", "_sha"]).select("_id", "_sha", "_text", "runs")


def _kept(texts: DataFrame) -> DataFrame:
    """_id, _sha and kept_sha256: of the words outside runs, joined by one space."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words, kept, at = _words(text), [], 0
                for run in runs:
                    kept += words[at : run["first"]]
                    at = run["last"]
                out.append(hashlib.sha256(b" ".join(kept + words[at:])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["_id", "_sha", "kept_sha256"])

    return texts.mapInArrow(work, "_id long, _sha binary, kept_sha256 string")


def _length(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda acc, r: acc + (r["last"] - r["first"]))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """key, n_words, n_removed and kept_sha256 of each row: repeats(), with the words left."""
    found, texts = _repeats(docs, key, text, width)
    left = _kept(texts).withColumnsRenamed({"_id": "_key"})
    rows = found.join(left, (F.col(key) == F.col("_key")) & (F.col("sha") == F.col("_sha")), "left")
    removed = _length(F.col("runs"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    kept = F.when(removed == 0, F.col("whole")).when(removed == F.col("n_words"), none).otherwise(F.col("kept_sha256"))
    return rows.select(key, "n_words", removed.alias("n_removed"), kept.alias("kept_sha256"))
