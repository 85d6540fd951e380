"""Maximum inner product search over four-bit codes with a score-aware loss.

Vectors are cut into pairs of components; each pair is coded by one of 16 centres. What
matters for an inner product is the error along the vector itself, as queries that
score high point that way; so centres and codes minimise (error across)^2 + ETA *
(error along)^2. Codes of two pairs make a byte; a query adds up one table of 256
figures a byte. Rows whose sum comes near enough to the best ones' are scored exactly.

Queries and rows meet in blocks of bounded size, every block of queries with every block
of rows, each by a task of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CENTRES = 16
#: Rows in a block, queries in a block, and vectors in the sample that the centres are fitted to.
ROWS, QUERIES, SAMPLE = 16_384, 1_024, 8_192
#: Scores from this share of a vector's norm on are what the loss is weighted for.
SHARE = 0.2
#: Rows are scored exactly where their sum is within so many standard errors of the k-th best exact score known.
ERRORS = 3.0


@dataclass(frozen=True)
class Codebook:
    """centres: (pairs, CENTRES, 2); eta: weight of the error along; error: root mean square of a vector's whole error, as a share of its norm."""

    dim: int
    centres: np.ndarray
    eta: float
    error: float


def _pairs(vectors: np.ndarray) -> np.ndarray:
    """Vectors as (rows, pairs, 2), filled with zeros to whole bytes of two pairs."""
    n, d = vectors.shape
    wide = np.zeros((n, -(-d // 4) * 4), dtype=np.float64)
    wide[:, :d] = vectors
    return wide.reshape(n, -1, 2)


def encoded(vectors: np.ndarray, centres: np.ndarray, eta: float, passes: int = 2) -> np.ndarray:
    """The code of each pair: nearest centres first, then pair by pair what lowers the loss of the whole vector."""
    x = _pairs(vectors)
    u = x / np.maximum(np.linalg.norm(vectors, axis=1), 1e-300)[:, None, None]
    miss = centres[None] - x[:, :, None]  # rows, pairs, centres, 2
    own = (miss**2).sum(axis=-1)
    along = (miss * u[:, :, None]).sum(axis=-1)
    codes = own.argmin(axis=-1)
    rows = np.arange(len(x))
    total = np.take_along_axis(along, codes[..., None], axis=2)[..., 0].sum(axis=1)
    for _ in range(passes):
        for m in range(x.shape[1]):
            rest = total - along[rows, m, codes[:, m]]
            codes[:, m] = (own[:, m] + (eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
            total = rest + along[rows, m, codes[:, m]]
    return codes


def fitted(sample: np.ndarray, rounds: int = 6, seed: int = 7) -> Codebook:
    """Centres for the sample: k-means by pair, then codes and centres in turns under the weighted loss."""
    d = sample.shape[1]
    eta = max(1.0, (d - 1) * SHARE**2 / (1 - SHARE**2))
    x = _pairs(sample)
    u = x / np.maximum(np.linalg.norm(sample, axis=1), 1e-300)[:, None, None]
    pairs = x.shape[1]
    pick = np.random.default_rng(seed).choice(len(x), CENTRES, replace=len(x) < CENTRES)
    centres = x[pick].transpose(1, 0, 2).copy()
    for _ in range(12):
        near = ((centres[None] - x[:, :, None]) ** 2).sum(axis=-1).argmin(axis=-1)
        for m in range(pairs):
            n = np.bincount(near[:, m], minlength=CENTRES)
            for k in range(2):
                mean = np.bincount(near[:, m], x[:, m, k], CENTRES) / np.maximum(n, 1)
                centres[m, :, k] = np.where(n > 0, mean, centres[m, :, k])
    for _ in range(rounds):
        codes = encoded(sample, centres, eta)
        miss = centres[np.arange(pairs), codes] - x
        total = (miss * u).sum(axis=(1, 2))
        for m in range(pairs):
            c, um, xm = codes[:, m], u[:, m], x[:, m]
            rest = total - (miss[:, m] * um).sum(axis=1)
            target = xm + (eta - 1) * um * ((um * xm).sum(axis=1) - rest)[:, None]
            weight = np.eye(2) + (eta - 1) * um[:, :, None] * um[:, None]
            a, b = np.zeros((CENTRES, 2, 2)), np.zeros((CENTRES, 2))
            np.add.at(a, c, weight)
            np.add.at(b, c, target)
            used = np.bincount(c, minlength=CENTRES) > 2
            centres[m, used] = np.linalg.solve(a[used] + 1e-9 * np.eye(2), b[used][..., None])[..., 0]
            miss[:, m] = centres[m, c] - xm
            total = rest + (miss[:, m] * um).sum(axis=1)
    codes = encoded(sample, centres, eta)
    miss = centres[np.arange(pairs), codes] - x
    error = np.sqrt(((miss**2).sum(axis=(1, 2)) / np.maximum((x**2).sum(axis=(1, 2)), 1e-300)).mean())
    return Codebook(d, centres, eta, float(error))


def packed(codes: np.ndarray) -> np.ndarray:
    return (codes[:, 0::2] * CENTRES + codes[:, 1::2]).astype(np.uint8)


def tables(query: np.ndarray, book: Codebook) -> np.ndarray:
    """For each byte of a code, what each of its 256 values adds to the inner product with the query."""
    each = (_pairs(query[None])[0][:, None] * book.centres).sum(axis=-1)
    return (each[0::2, :, None] + each[1::2, None]).reshape(-1, CENTRES * CENTRES).astype(np.float32)


def searched(query: np.ndarray, own: int, vectors: np.ndarray, ids: np.ndarray, norms: np.ndarray, codes: np.ndarray, book: Codebook, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the k best rows of a block, but for the query's own. codes: bytes by rows."""
    table = tables(query, book)
    near = np.zeros(len(ids), dtype=np.float32)
    for j in range(len(table)):
        near += table[j].take(codes[j])
    slack = ERRORS * book.error / np.sqrt(book.dim) * np.linalg.norm(query) * norms
    exact = lambda at: (vectors[at] * query).sum(axis=1)
    first = 4 * (k + 1)
    if len(ids) > first:  # the k-th best exact score of the nearest by their sums bounds that of all from below
        top = np.argpartition(near, -first)[-first:]
        known = np.sort(exact(top[ids[top] != own]))
        at = np.flatnonzero(near + slack >= (known[-k] if len(known) >= k else -np.inf))
    else:
        at = np.arange(len(ids))
    at = at[ids[at] != own]
    score = exact(at)
    best = np.lexsort((ids[at], -score))[:k]
    return ids[at][best], score[best]


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product for each row that queries holds for.

    A query's own row is no candidate of it. Ties go to the smaller key. Null and zero
    vectors, those with null or non-finite components and those of another length than
    most take no part, nor do null keys. Where keys repeat, each row is a candidate
    (equal keys may fill several ranks), and a query is answered once. A search is
    approximate only in that a row whose code errs by more than ERRORS standard errors
    can be missed.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(key).isNotNull() & _valid(F.col(vector))).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("asked"))
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if("asked").alias("asked")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == lengths.dim)
    part = (1 << 20) * SAMPLE // lengths.n
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < part).select("v") if lengths.n > SAMPLE else rows.select("v")
    book = fitted(np.array(sample.toArrow()["v"].to_pylist() or [[1.0] * lengths.dim]))
    shared = spark.sparkContext.broadcast(book)

    def encode(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            codes = np.concatenate([packed(encoded(x[i : i + 2048], shared.value.centres, shared.value.eta)) for i in range(0, len(x), 2048)]) if len(x) else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "v", "code"])

    row_blocks, query_blocks = -(-lengths.n // ROWS), -(-max(1, lengths.asked) // QUERIES)
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    coded = rows.select("vec_id", "v").mapInArrow(encode, "vec_id long, v array<double>, code binary")
    coded = coded.withColumn("r", block(row_blocks, 1)).withColumn("q", every(query_blocks))
    asked = rows.where("asked").dropDuplicates(["vec_id"]).select("vec_id", "v").withColumn("q", block(query_blocks, 2)).withColumn("r", every(row_blocks))

    def scan(questions: pa.Table, answers: pa.Table) -> pa.Table:
        found = []
        if questions.num_rows and answers.num_rows:
            answers = answers.sort_by("vec_id")
            ids = answers["vec_id"].to_numpy()
            x = answers["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            norms = np.linalg.norm(x, axis=1).astype(np.float32)
            codes = np.frombuffer(b"".join(answers["code"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1).T.copy()
            y = questions["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(questions.num_rows, -1)
            for own, query in zip(questions["vec_id"].to_pylist(), y, strict=True):
                best, score = searched(query, own, x, ids, norms, codes, shared.value, k)
                found.append((np.full(len(best), own), best, score))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[], [], []]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    hits = asked.groupBy("r", "q").cogroup(coded.groupBy("r", "q")).applyInArrow(scan, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
