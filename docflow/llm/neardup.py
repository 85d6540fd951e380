"""Exact n-gram Jaccard join by signature trees.

A text's set is its distinct word shingles. Two sets link when their Jaccard similarity
is at least PERCENT / 100. The tree has three kinds of levels:

1. Cells, the nodes below the root. Sizes fall into bands. Two linked sets whose smaller
   one is in band j differ in at most D(j) shingles. Shingles are dealt by hash over
   D(j) + 1 + E(j) parts; so linked sets have equal, filled shares in a part, unless both
   have more than E(j) empty parts, and then they also enter the cells of those. Every
   linked pair meets in a cell, and sets that share only common passages hardly do.
2. In a cell the set with the most company is compared with all others first. The links
   found make components, and no pair within a component needs to be compared again.
3. Cells that still hold more than one component are cut into leaves of about LEAF sets,
   pairs of leaves are traversed together: nodes over leaves' sets hold the OR of their
   token bitmaps and their range of sizes, and a pair of nodes is left as soon as the
   largest overlap that the bitmaps allow is below what the sizes ask for.

What remains is verified on the whole shingle sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.llm import text as X
from docflow.llm.common import drop_stash, stash
from docflow.llm.graph import components

LEAF = 64
FAN = 8
BITS = 4096
#: Bits of the filter of ids whose texts are wanted: 1 MB, whatever the corpus. A chance hit costs only transport.
FILTER_BITS = 1 << 23


def bands(percent: int, top: int = 1 << 40) -> np.ndarray:
    """Lower bounds of the bands of sizes: in each, sizes grow by the square of 100 / percent."""
    low = [1]
    while low[-1] < top:
        low.append(max(low[-1] + 1, int(low[-1] * (100 / percent) ** 2)))
    return np.array(low, dtype=np.int64)


def parts_of(low: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each band: in how many parts shingles are dealt (0 where no two different sets link), and how many may be empty."""
    small = low[1:] - 1
    differ = (100 - percent) * (small + 100 * small // percent) // (100 + percent)
    n = differ + 1
    mean = n * np.exp(-low[:-1] / n)
    empty = np.ceil(mean + 2 * np.sqrt(mean)).astype(np.int64)
    return np.where(differ > 0, n + empty, 0), empty


def shingle_sets(c: X.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of runs of n words, by row and key, and the row of each; a text of fewer words is one run."""
    words = c.word_keys()
    keys, at = X.runs(words, c.row, n)
    row = c.row[at]
    count = c.per_row(c.row)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(c.row, short)
        own = np.zeros(len(short), dtype=np.uint64)
        for i in range(n - 1):
            inside = count[short] > i
            own[inside] += words[first[inside] + i] * X.STEPS[i % 5] * np.uint64(2 * (i // 5) + 1)
        keys, row = np.append(keys, X.mix(own + count[short].astype(np.uint64))), np.append(row, short)
    order = np.argsort(keys)
    order = order[np.argsort(row[order].astype(np.uint16) if c.rows < 1 << 16 else row[order], kind="stable")]
    keys, row = keys[order], row[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    return keys[new], row[new]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums, modulo 2**64, of the runs that begin at first."""
    total = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
    return total[np.append(first[1:], len(values))] - total[first]


def set_keys(keys: np.ndarray, row: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A key of each row's set; 0 of an empty one. size: of each row's set."""
    first = np.searchsorted(row, np.arange(len(size)))
    own = np.zeros(len(size), dtype=np.uint64)
    own[size > 0] = X.mix(_sums(X.mix(keys + X.STEPS[2]), first[size > 0]) + size[size > 0].astype(np.uint64))
    return own


def cells_of(keys: np.ndarray, row: np.ndarray, size: np.ndarray, low: np.ndarray, parts: np.ndarray, empty: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each row's set, and the row of each. size: of each row's set."""
    band = np.searchsorted(low, size, "right") - 1
    out, rows = [], []
    for down in (0, 1):  # as the smaller of a pair; as the larger of one whose smaller is a band below
        j = np.maximum(band - down, 0)
        n = np.where(size > 0, parts[j], 0)
        if down:
            n = np.where((band > 0) & (size * percent < low[band] * 100), n, 0)
        used = n[row] > 0
        k, r = keys[used], row[used]
        if not len(k):
            continue
        part = ((k >> np.uint64(32)) * n[r].astype(np.uint64)) >> np.uint64(32)
        first = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (r[1:] != r[:-1])))
        share = _sums(X.mix(k + X.STEPS[3]), first)
        seed = lambda r, p: j[r].astype(np.uint64) * X.STEPS[0] + p.astype(np.uint64) * X.STEPS[1]  # noqa: B023, E731
        out.append(X.mix(share + X.mix(seed(r[first], part[first]))))
        rows.append(r[first])
        filled = np.bincount(r[first], minlength=len(size))
        for i in np.flatnonzero((n > 0) & (n - filled > empty[j])):
            p = np.setdiff1d(np.arange(n[i]), part[first][r[first] == i].astype(np.int64))
            out.append(X.mix(X.mix(seed(np.full(len(p), i), p)) + X.STEPS[4]))
            rows.append(np.full(len(p), i))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(rows)


def _lists(values: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    order = np.argsort(row, kind="stable")
    offsets = np.append(0, np.cumsum(np.bincount(row, minlength=rows)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[order].view(np.int64)))


def signatures(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """key, n_shingles, set_key and cells of each row; the cells of equal sets are given once a task, with a row whose key isn't null."""
    low = bands(percent)
    parts, empty = parts_of(low, percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for c in X.chunks(batch.column(1), lower=True):
                keys, row = shingle_sets(c, n)
                size = c.per_row(row)
                own = set_keys(keys, row, size)
                names = own.tolist()
                ids = batch.column(0).slice(c.first, c.rows)
                named = ids.is_valid().to_pylist()
                new = np.zeros(c.rows, dtype=bool)
                for i, name in enumerate(names):
                    if size[i] and named[i] and name not in seen:
                        seen.add(name)
                        new[i] = True
                cells, of = cells_of(keys[new[row]], row[new[row]], np.where(new, size, 0), low, parts, empty, percent)
                yield pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(own.view(np.int64)), _lists(cells, of, c.rows)], ["key", "n_shingles", "set_key", "cells"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *(T.StructField(x, T.LongType()) for x in ("n_shingles", "set_key")), T.StructField("cells", T.ArrayType(T.LongType()))])
    return docs.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(work, schema)


def _wanted(ids: DataFrame) -> np.ndarray:
    """A filter of the ids in column id: bits by a hash of each, of a fixed number."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.groupBy(F.floor(bit / 64).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out


def texts_of(docs: DataFrame, key: str, text: str, sets: DataFrame, n: int) -> DataFrame:
    """set_key, text (whole, packed) of the rows with the id and the set of each of sets(set_key, id). Rows that the filter excludes are not moved."""
    shared = docs.sparkSession.sparkContext.broadcast(_wanted(sets.select("id")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(2).to_numpy(zero_copy_only=False)
            found = batch.filter(pa.array((shared.value[bit // 64] >> (bit % 64)) & 1 > 0))
            for c in X.chunks(found.column(1), lower=True):
                keys, row = shingle_sets(c, n)
                own = set_keys(keys, row, c.per_row(row)).view(np.int64)
                ids, texts = (found.column(i).slice(c.first, c.rows) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, _packed(texts), pa.array(own)], ["_id", "_text", "_own"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text"), F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)).alias("_bit"))
    kept = rows.mapInArrow(work, T.StructType([rows.schema["_id"], T.StructField("_text", T.BinaryType()), T.StructField("_own", T.LongType())]))
    return kept.join(sets, (F.col("_id") == F.col("id")) & (F.col("_own") == F.col("set_key"))).select("set_key", F.col("_text").alias("text"))


def _packed(texts: pa.Array) -> pa.Array:
    """Texts deflated, as they are moved for each pair. A null is an empty text."""
    return pa.array([zlib.compress((t or "").encode(), 1) for t in texts.to_pylist()], pa.binary())


def _sets(packed: pa.Array, n: int) -> list[np.ndarray]:
    """The set of each packed text."""
    out: list[np.ndarray] = []
    texts = pa.array([zlib.decompress(t).decode() for t in packed.to_pylist()], pa.string())
    for c in X.chunks(texts, lower=True):
        keys, row = shingle_sets(c, n)
        out.extend(np.split(keys, np.searchsorted(row, np.arange(1, c.rows))))
    return out


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of set keys, those whose whole sets link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            _, first, which = np.unique(a, return_index=True, return_inverse=True)
            heads = _sets(batch.column(2).take(pa.array(first)), n)
            linked = np.zeros(len(a), dtype=bool)
            for i, s in enumerate(_sets(batch.column(3), n)):
                h = heads[which[i]]
                if len(h) and len(s):
                    both = int((h[np.minimum(np.searchsorted(h, s), len(h) - 1)] == s).sum())
                    linked[i] = 100 * both >= percent * (len(h) + len(s) - both)
            yield batch.select([0, 1]).filter(pa.array(linked))

    one = texts.select(F.col("set_key").alias("b"), F.col("text").alias("_tb"))
    two = texts.select(F.col("set_key").alias("a"), F.col("text").alias("_ta"))
    rows = pairs.join(one, "b").join(two, "a").select("a", "b", "_ta", "_tb")
    return rows.mapInArrow(work, "a long, b long")


class Node:
    """Sets below it: the OR of their bitmaps, their range of sizes, the most shingles that share a bit with another of their own set, and their component if it is one.

    A node of the lowest level has no nodes below, but sets: their places, and bits, size, slack and label of each.
    """

    __slots__ = ("bits", "low", "high", "slack", "label", "below", "sets")

    def __init__(self, bits: np.ndarray, low: int, high: int, slack: int, label: int | None, below: list[Node], sets: tuple[np.ndarray, ...] | None = None):
        self.bits, self.low, self.high, self.slack, self.label, self.below, self.sets = bits, low, high, slack, label, below, sets


def tree(bitmaps: np.ndarray, size: np.ndarray, label: np.ndarray) -> Node:
    """A tree over sets in order of component and size, FAN to a node."""
    slack = size - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
    order = np.lexsort((size, label))
    level = []
    for i in range(0, len(order), FAN):
        at = order[i : i + FAN]
        own = int(label[at[0]]) if label[at[0]] == label[at[-1]] else None
        level.append(Node(np.bitwise_or.reduce(bitmaps[at]), int(size[at].min()), int(size[at].max()), int(slack[at].max()), own, [], (at, bitmaps[at], size[at], slack[at], label[at])))
    while len(level) > 1:
        groups = [level[i : i + FAN] for i in range(0, len(level), FAN)]
        one = [g[0].label if all(x.label == g[0].label for x in g) else None for g in groups]
        level = [Node(np.bitwise_or.reduce([x.bits for x in g]), min(x.low for x in g), max(x.high for x in g), max(x.slack for x in g), own, g) for g, own in zip(groups, one, strict=True)]
    return level[0]


def enough(common, slack, low, high, low2, high2, percent: int):
    """Whether the largest possible overlap reaches what the sizes ask for: of two nodes, or of arrays of two sets each."""
    least = np.maximum(-(-percent * (low + low2) // (100 + percent)), -(-percent * np.maximum(low, low2) // 100))
    return np.minimum(np.minimum(common + slack, high), high2) >= least


def may_link(x: Node, y: Node, percent: int) -> bool:
    """Whether any set of x and any of y may link."""
    if x.high * 100 < y.low * percent or y.high * 100 < x.low * percent:
        return False
    common = int(np.bitwise_count(x.bits & y.bits).sum(dtype=np.int64))
    return bool(enough(common, min(x.slack, y.slack), x.low, x.high, y.low, y.high, percent))


def _met(x: Node, y: Node, percent: int) -> Iterator[tuple[int, int]]:
    """Of two nodes of the lowest level, the pairs of sets of different components that may link."""
    (at, bits, size, slack, label), (at2, bits2, size2, slack2, label2) = x.sets, y.sets
    common = np.bitwise_count(bits[:, None] & bits2[None]).sum(axis=2, dtype=np.int64)
    n, m = size[:, None], size2[None]
    ok = enough(common, np.minimum(slack[:, None], slack2[None]), n, n, m, m, percent) & (label[:, None] != label2[None])
    if x is y:
        ok &= np.triu(np.ones(ok.shape, dtype=bool), 1)
    i, j = np.nonzero(ok)
    yield from zip(at[i].tolist(), at2[j].tolist(), strict=True)


def traverse(x: Node, y: Node, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of sets below x and y, of different components, that may link; of a tree with itself each pair once."""
    todo = [(x, y)]
    while todo:
        x, y = todo.pop()
        if x.label is not None and x.label == y.label or not may_link(x, y, percent):
            continue
        if x.sets and y.sets:
            yield from _met(x, y, percent)
        elif x is y:
            todo.extend((a, b) for i, a in enumerate(x.below) for b in x.below[i:])
        elif x.below and len(x.below) >= len(y.below):
            todo.extend((a, y) for a in x.below)
        else:
            todo.extend((x, b) for b in y.below)


def bitmaps(texts: DataFrame, n: int) -> DataFrame:
    """set_key, n_shingles and a bitmap of BITS bits of each text's set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch.column(1), n)
            marks = []
            for s in sets:
                bits = np.zeros(BITS, dtype=bool)
                bits[(s & np.uint64(BITS - 1)).astype(np.int64)] = True
                marks.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary())], ["set_key", "n", "bits"])

    return texts.select("set_key", "text").mapInArrow(work, "set_key long, n long, bits binary")


def traversed(leaves: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of different components, left by the traversal of each two leaves of a cell. leaves: cell, leaf, n_leaves (of the cell), sets, low, high (labels). The only leaf of a cell meets itself where it is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[tuple[int, int], tuple[list[int], Node]] = {}  # the pairs of a cell come together

        def side(batch: pa.RecordBatch, i: int, k: int) -> tuple[list[int], Node]:
            name = (batch.column(0)[i].as_py(), batch.column(k)[i].as_py())
            if name not in trees:
                if len(trees) >= 2 * LEAF:
                    trees.clear()
                sets = batch.column(k + 1)[i].values
                bits = np.frombuffer(b"".join(sets.field("bits").to_pylist()), dtype=np.uint64).reshape(len(sets), -1)
                trees[name] = sets.field("set_key").to_pylist(), tree(bits, sets.field("n").to_numpy(), sets.field("label").to_numpy())
            return trees[name]

        for batch in batches:
            found: set[tuple[int, int]] = set()
            for i in range(batch.num_rows):
                (left, x), (right, y) = side(batch, i, 1), side(batch, i, 3)
                found.update(tuple(sorted((left[p], right[q]))) for p, q in traverse(x, y, percent))
            pairs = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    alone = leaves.where("n_leaves = 1 and low < high").select("cell", "leaf", "sets", F.col("leaf").alias("_leaf"), F.lit(None).cast(leaves.schema["sets"].dataType).alias("_sets"))  # its tree is known from the left side
    leaves = leaves.where("n_leaves > 1")
    other = leaves.select("cell", F.col("leaf").alias("_leaf"), F.col("sets").alias("_sets"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    two = leaves.join(other, "cell").where(F.col("leaf") <= F.col("_leaf"))
    two = two.where(F.least("low", "_low") < F.greatest("high", "_high"))  # within one component nothing is left to find
    return alone.unionByName(two.select("cell", "leaf", "sets", "_leaf", "_sets")).mapInArrow(work, "a long, b long")


def central(shared: DataFrame) -> DataFrame:
    """a, b: in each cell the set with the most company, and each other set.

    A set's company is the number of sets in its cells: a text that many others were made
    from has more of it than they have, and is the one that most of them link with.
    """
    sizes = shared.groupBy(F.col("cell").alias("_cell")).agg(F.count("*").alias("size"))
    company = shared.join(sizes, F.col("cell") == F.col("_cell")).groupBy(F.col("set_key").alias("_k")).agg(F.sum("size").alias("company"))
    ranked = shared.join(company, F.col("set_key") == F.col("_k"))
    leads = ranked.groupBy(F.col("cell").alias("_cell")).agg(F.max_by("set_key", F.struct("company", "set_key")).alias("lead"))
    pairs = shared.join(leads, F.col("cell") == F.col("_cell")).where("lead <> set_key")
    return pairs.select(F.col("lead").alias("a"), F.col("set_key").alias("b")).distinct()


def clusters(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """key, n_shingles and component_id (the least key that links lead to, itself included) of each row.

    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A
    null, empty or blank text has no shingles and links with nothing. Rows with the same
    key are one document; a null key is returned with a null component. Shingles and sets
    are told apart by 64-bit hashes. An empty table gives an empty result; other columns
    of docs are not read.
    """
    signed = stash(signatures(docs, key, text, n, percent), "signatures")
    filled = signed.where((F.col("n_shingles") > 0) & F.col("key").isNotNull())
    in_cell = Window.partitionBy("cell")
    cells = filled.select(F.explode("cells").alias("cell"), "set_key")
    cells = cells.withColumns({"_low": F.min("set_key").over(in_cell), "_high": F.max("set_key").over(in_cell)})
    shared = stash(cells.where("_low <> _high").select("cell", "set_key").distinct(), "cells")  # cells with one set go
    firsts = stash(central(shared), "pairs")
    wanted = firsts.select(F.col("a").alias("_k")).unionByName(firsts.select(F.col("b").alias("_k"))).distinct()
    heads = filled.groupBy("set_key").agg(F.min("key").alias("id"))
    texts = stash(texts_of(docs, key, text, heads.join(wanted, F.col("set_key") == F.col("_k"), "left_semi"), n).dropDuplicates(["set_key"]), "texts")
    links = verified(firsts, texts, n, percent)
    labels = stash(components(links).select(F.col("node").alias("_k"), F.col("component").alias("label")), "labels")

    labelled = shared.join(labels, F.col("set_key") == F.col("_k"), "left").select("cell", "set_key", F.coalesce("label", "set_key").alias("label"))
    mixed = labelled.groupBy(F.col("cell").alias("_cell")).agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count("*").alias("sets_here")).where("_low <> _high and sets_here > 2")  # of two sets the only pair is compared
    marks = bitmaps(texts, n).withColumnRenamed("set_key", "_k")
    members = labelled.join(mixed, F.col("cell") == F.col("_cell")).join(marks, F.col("set_key") == F.col("_k"))
    n_leaves = F.ceil(F.col("sets_here") / LEAF)
    leaf = F.pmod(F.xxhash64("set_key"), n_leaves).alias("leaf")
    leaves = members.groupBy("cell", leaf, n_leaves.alias("n_leaves")).agg(F.collect_list(F.struct("set_key", "label", "n", "bits")).alias("sets"), F.min("label").alias("low"), F.max("label").alias("high"))
    seconds = stash(traversed(stash(leaves, "leaves"), percent).distinct(), "pairs")
    more = verified(seconds, texts, n, percent)
    named = labels.select(F.col("_k"), F.col("label"))
    more = more.join(named.toDF("a", "_la"), "a", "left").join(named.toDF("b", "_lb"), "b", "left")
    more = more.select(F.coalesce("_la", "a").alias("a"), F.coalesce("_lb", "b").alias("b"))
    merged = components(more).select(F.col("node").alias("_n"), F.col("component").alias("_c"))

    # of sets, then of keys that stand with more than one set
    sets = heads.join(labels, F.col("set_key") == F.col("_k"), "left").select("set_key", F.coalesce("label", "set_key").alias("label"))
    sets = sets.join(merged, F.col("label") == F.col("_n"), "left").select("set_key", F.coalesce("_c", "label").alias("label"))
    rows = signed.select("key", "n_shingles", "set_key").join(sets.withColumnRenamed("set_key", "_s"), (F.col("set_key") == F.col("_s")) & (F.col("n_shingles") > 0), "left").drop("_s")
    rows = stash(rows, "rows")
    known = rows.where("label is not null and key is not null")
    twice = known.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b")
    joined = components(twice.select("a", "b")).select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    final = rows.join(joined, F.col("label") == F.col("_n"), "left").select("key", "n_shingles", F.coalesce("_c", "label").alias("label"))
    least = final.where("label is not null").groupBy(F.col("label").alias("_l")).agg(F.min("key").alias("least"))
    out = final.join(least, F.col("label") == F.col("_l"), "left")
    out = stash(out.select(F.col("key").alias(key), "n_shingles", F.when(F.col("key").isNotNull(), F.coalesce("least", "key")).alias("component_id")), "clusters")
    drop_stash(signed, shared, firsts, texts, labels, seconds, rows)
    return out
