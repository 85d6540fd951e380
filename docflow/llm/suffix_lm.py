"""Language-model scores by a probabilistic suffix tree over words.

The root is the distribution of single tokens, smoothed by adding ALPHA. The tree grows
by a word at a time: a context is a candidate where its last words but the first are a
kept context (of one word: always) and it is seen least times or more, and is kept where
its next-token distribution diverges from that of its longest kept suffix by more than
chance does. It ends with the first length of which no context is kept, or at depth
words. Within a kept context, each next token seen least times or more has its own discounted
share, and what is left goes to the suffix; so each state's probabilities sum to 1. A
token is scored in the state of the longest kept suffix of what precedes it.

All counts are over all training texts, and no share of the corpus bounds the tree: it
grows with the input, as written tables. A score is a sum over the runs of one to depth + 1 words of
a text: a word has its root probability, a run that is a kept context has the share that
it leaves to its suffix, and a run that ends in a token with its own share has what this
adds. So scoring is a join of runs with one table of weights. What is broadcast only saves
transport: filters of FILTER_BITS bits a length, by which runs that are in no table are
not moved, and the HOT weights used most. All other runs are joined to the table by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm import text as X
from docflow.llm.common import drop_stash, fold, stash

ALPHA = 0.1
END = np.int64(0x3C6EF372FE94F82A)
#: Weights in the broadcast table, 24 bytes each.
HOT = 1 << 16
#: Bits of a filter, 8 MB a length whatever the corpus. A chance hit costs only transport.
FILTER_BITS = 1 << 26
#: Positions that are counted together in a task.
COUNTED = 1 << 19
#: By how many bits a key is turned for each word that follows.
TURN = 23


@dataclass(frozen=True)
class Settings:
    """folds: texts of the fold 0 are not learnt. least: how often a context, and a next token in it, is seen at least. divergence is in nats, less what chance explains."""

    folds: int = 10
    depth: int = 3
    divergence: float = 0.01
    discount: float = 0.5
    least: int = 4


@dataclass(frozen=True)
class Root:
    """Total tokens and kinds of tokens in training."""

    total: int
    kinds: int

    @property
    def below(self) -> float:
        return self.total + ALPHA * (self.kinds + 1)


def tokens(c: X.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a chunk's words, each row's followed by END, and the row of each."""
    out = np.full(len(c.row) + c.rows, END, dtype=np.int64)
    out[np.arange(len(c.row)) + c.row] = c.word_keys().view(np.int64)
    return out, np.repeat(np.arange(c.rows), c.per_row(c.row) + 1)


def runs_of(keys: np.ndarray, row: np.ndarray, filters: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the places at which a run ends that may be in the table of that length, as its suffixes are in theirs, and the runs' keys at all places."""
    words, run, at = keys.view(np.uint64), np.zeros(len(keys), dtype=np.uint64), np.arange(len(keys))
    for n, bits in enumerate(filters):
        turned = words << np.uint64(TURN * n % 64) | words >> np.uint64(-TURN * n % 64) if n else words
        run[n:] ^= turned[: len(turned) - n]
        at = at[at >= n]
        at = at[row[at] == row[at - n]]
        bit = run[at] & np.uint64(FILTER_BITS - 1)
        at = at[(bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0]
        yield at, run.view(np.int64).copy()


def longer(context: Column, word: Column) -> Column:
    """The key of a run and the word after it."""
    return F.shiftleft(context, TURN).bitwiseOR(F.shiftrightunsigned(context, 64 - TURN)).bitwiseXOR(word)


def filter_of(keys: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, those of the values of the column key set."""
    bit = F.col("key").bitwiseAND(FILTER_BITS - 1)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    words = keys.groupBy(F.floor(bit / 64).cast("int").alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """key, n: how often each token occurs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = X.Tally()
        for batch in batches:
            for c in X.chunks(batch.column(0), lower=True):
                yield from map(_counts, tally.add(tokens(c)[0]))
        yield from map(_counts, tally.rest())

    rows = docs.select(F.col(text).cast("string").alias("_text")).mapInArrow(work, "key long, n long")
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


def _counts(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["key", "n"])


def next_counts(docs: DataFrame, text: str, filters: list[np.ndarray], least: int) -> DataFrame:
    """ctx, word, n: how often each token follows each context that passes the filters, where that is least times or more."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def merged(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        run, ctx, word = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, first, n = np.unique(run, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ctx[first], word[first], n)], ["ctx", "word", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for c in X.chunks(batch.column(0), lower=True):
                keys, row = tokens(c)
                *_, (at, run) = runs_of(keys, row, shared.value)
                at = at[keys[at] != END]
                ctx, word = run[at], keys[at + 1]
                turned = ctx.view(np.uint64) << np.uint64(TURN) | ctx.view(np.uint64) >> np.uint64(64 - TURN)
                parts.append((turned.view(np.int64) ^ word, ctx, word))
                size += len(at)
                if size > COUNTED:
                    yield merged(parts)
                    parts, size = [], 0
        if size:
            yield merged(parts)

    rows = docs.select(F.col(text).cast("string").alias("_text")).mapInArrow(work, "ctx long, word long, n long")
    return rows.groupBy("ctx", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def compared(counts: DataFrame, candidates: DataFrame, lower: DataFrame) -> DataFrame:
    """run, ctx, sub (the run without its first word), n, seen (the context's count) and p (of the token in the context's suffix) of each token in each candidate."""
    known = candidates.select(F.col("key").alias("_ctx"), F.col("n").alias("seen"), "suffix")
    both = counts.join(known, F.col("ctx") == F.col("_ctx"))
    both = both.select(longer(F.col("ctx"), F.col("word")).alias("run"), "ctx", longer(F.col("suffix"), F.col("word")).alias("sub"), "n", "seen")
    return both.join(lower.select(F.col("key").alias("_sub"), "p"), F.col("sub") == F.col("_sub")).drop("_sub")


def kept(grams: DataFrame, s: Settings) -> DataFrame:
    """key, n and rest (the share that goes to the suffix) of the contexts that pass the divergence test. Tokens without a share of their own count as one."""
    n, p, seen = F.col("n"), F.col("p"), F.col("seen")
    sums = grams.groupBy("ctx").agg(F.max("seen").alias("seen"), F.count("*").alias("kinds"), F.sum("n").alias("listed"), F.sum("p").alias("mass"), F.sum(n * F.log(n / p)).alias("gain"))
    left = seen - F.col("listed")
    gain = F.col("gain") - F.col("listed") * F.log(seen) + F.when(left > 0, left * F.log(left / seen / F.greatest(1 - F.col("mass"), F.lit(1e-12)))).otherwise(0.0)
    passed = sums.where((gain - F.col("kinds") / 2) / seen > s.divergence)
    return passed.select(F.col("ctx").alias("key"), seen.alias("n"), ((left + s.discount * F.col("kinds")) / seen).alias("rest"))


def modelled(docs: DataFrame, text: str, s: Settings) -> tuple[list[DataFrame], Root]:
    """By length of runs, the weights (key, n, w, b, known) of those that have one, and the totals."""
    counts = stash(word_counts(docs, text), "counts")
    root = Root(*counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first())
    none = F.lit(0.0)
    own = F.log10((F.col("n") + ALPHA) / F.lit(ALPHA))  # more than an unknown token has
    weights = [counts.select("key", "n", own.alias("w"), own.alias("b"), F.lit(1).alias("known"))]
    lower = counts.select("key", ((F.col("n") + ALPHA) / root.below).alias("p"))
    candidates = counts.where((F.col("n") >= s.least) & (F.col("key") != F.lit(int(END)))).select("key", "n", F.lit(0).cast("long").alias("suffix"))
    filters = []
    for _ in range(s.depth):
        filters.append(filter_of(candidates))
        if not filters[-1].any():
            break
        found = stash(next_counts(docs, text, filters, s.least), "next")
        grams = stash(compared(found, candidates, lower), "grams")
        drop_stash(found)
        contexts = stash(kept(grams, s), "contexts")
        inside = grams.join(contexts.select(F.col("key").alias("ctx"), "rest"), "ctx")
        level = stash(inside.select(F.col("run").alias("key"), "n", (F.col("rest") * F.col("p") + (F.col("n") - s.discount) / F.col("seen")).alias("p"), (F.col("rest") * F.col("p")).alias("from_suffix")), "level")
        suffixes = contexts.select(F.col("key").alias("sub"))
        candidates = stash(grams.join(suffixes, "sub", "left_semi").select(F.col("run").alias("key"), "n", F.col("sub").alias("suffix")), "candidates")
        drop_stash(grams)
        lower = level
        weights[-1] = weights[-1].unionByName(contexts.select("key", "n", F.log10("rest").alias("w"), none.alias("b"), F.lit(0).alias("known")))
        weights.append(level.select("key", "n", F.log10(F.col("p") / F.col("from_suffix")).alias("w"), none.alias("b"), F.lit(0).alias("known")))
    return weights, root


def hottest(weights: DataFrame) -> tuple[pa.Table, int]:
    """The weights of the runs seen most, and the least count of these: the smallest at which there are HOT rows at most."""
    level = F.floor(F.log2("n") * 8).cast("int").alias("level")
    rows = weights.groupBy(level).agg(F.count("*").alias("runs"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()  # some hundred rows
    size, least = 0, 1 << 62
    for r in rows:
        size += r.runs
        if size > HOT:
            break
        least = r.least
    found = weights.where(F.col("n") >= least).groupBy("key").agg(F.sum("w").alias("w"), F.sum("b").alias("b"), F.sum("known").alias("known"))
    return found.toArrow(), least


def partial(docs: DataFrame, root: Root, filters: list[np.ndarray], hot: pa.Table, key: str, text: str) -> DataFrame:
    """row, key, held_out, n_tokens; n_known, base and score by the hot weights; and tail, the runs that may have other ones."""
    index = X.Index(hot["key"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast((filters, index, [hot[x].to_numpy()[index.order] for x in ("w", "b", "known")]))
    unknown = float(np.log10(ALPHA / root.below))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, index, (w, b, known) = shared.value
        for batch in batches:
            for c in X.chunks(batch.column(3), lower=True):
                keys, row = tokens(c)
                n = c.per_row(row)
                score, base, n_known = n * unknown, n * unknown, np.zeros(c.rows, dtype=np.int64)
                tails, of = [], []
                for at, run in runs_of(keys, row, filters):
                    place = index.find(run[at])
                    here, there = place[place >= 0], row[at[place >= 0]]
                    score += c.per_row(there, w[here])
                    base += c.per_row(there, b[here])
                    n_known += c.per_row(there[known[here] > 0])
                    tails.append(run[at[place < 0]])
                    of.append(row[at[place < 0]])
                tails, of = np.concatenate(tails), np.concatenate(of)
                order = np.argsort(of, kind="stable")
                tail = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(c.per_row(of))), pa.int32()), pa.array(tails[order]))
                own = [batch.column(i).slice(c.first, c.rows) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, (n, n_known, base, score)), tail], ["row", "key", "held_out", "n_tokens", "n_known", "base", "score", "tail"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), (~F.col("_learns")).alias("held_out"), F.col(text).cast("string").alias("_text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(work, f"row long, key {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<long>")


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    Tokens are words (runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased) and an
    end. base_score is the log10 probability by single tokens, score that by the tree. A
    null text is empty: its end is its only token. Words and runs of words are told apart by 64-bit
    keys. Repeated rows are scored each; an empty table gives an empty result; where nothing
    is learnt, all tokens have the probability 1. Other columns are not read.
    """
    own = docs.select(key, text, (fold(key, settings.folds) != 0).alias("_learns"))
    weights, root = modelled(own.where("_learns"), text, settings)
    every = weights[0]
    for more in weights[1:]:
        every = every.unionByName(more)
    hot, least = hottest(every)
    rows = stash(partial(own, root, [filter_of(w) for w in weights], hot, key, text), "partial")
    rare = every.where(F.col("n") < least).select(F.col("key").alias("run"), "w", "b", "known")
    tails = rows.select("row", F.explode("tail").alias("run")).join(rare, "run")
    tails = tails.groupBy(F.col("row").alias("_row")).agg(F.sum("b").alias("_base"), F.sum("w").alias("_score"), F.sum("known").alias("_known"))
    both = rows.drop("tail").join(tails, F.col("row") == F.col("_row"), "left")
    total = lambda x: (F.col(x) + F.coalesce(f"_{x}", F.lit(0.0)))
    known = (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known")
    return both.select(F.col("key").alias(key), "held_out", "n_tokens", known, F.lit(root.total).cast("long").alias("train_tokens"), total("base").alias("base_score"), total("score").alias("score"))
