"""A Merkle manifest of a dataset: one tree for each source, and one over the sources' roots.

A node carries the interval [lo, hi) of leaf ranks that it covers. Ranks follow the order of
keys in a tree, by ranges (common.ranked), so a source with a third of all rows lies in many
partitions. Levels are dealt into storeys of STOREY levels: a bucket is a node of a storey's top
with the FAN ** STOREY nodes of its floor at most, and is the largest group that a task holds. A storey's
levels are made in its buckets, its tops are the floor of the next storey; so 10^11
leaves take five rounds.

Proofs go the other way. A bucket is joined to the node above that contains its interval, by the
number of the bucket and so without comparing unrelated nodes; in a bucket a node's parent
is the one that contains its interval, and its siblings cover what is left of the parent's
interval: those that end before it are on its left, those that begin after it on its right.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import drop_stash, fold, ranked, stash

#: Children of a node, and levels of a storey: a bucket has 243 nodes at its floor at most.
FAN, STOREY = 3, 5


def field(column: str | Column) -> Column:
    """A value as bytes that can't be mistaken: its UTF-8 length, a colon and itself; null is a dash."""
    value = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*columns: str | Column) -> Column:
    """The digest of a row's columns."""
    return F.sha2(F.concat(*map(field, columns)), 256)


def _whole(number: Column, by: int) -> Column:
    return F.floor(number / by).cast("int")


def _storey(floor: DataFrame, body: list[str]) -> DataFrame:
    """A row for each bucket: its floor's nodes as kids, its levels l0 to lSTOREY as nodes, its top's lo, hi and digest, and its height.

    floor: tree, rank, lo, hi, digest and the columns of body. A bucket that isn't its tree's only one has all
    levels, even above a single node; the only one ends where one node remains. A first bucket
    that isn't full is the only one.
    """
    width = FAN**STOREY
    kid = F.struct("rank", "lo", "hi", "digest", *([F.struct(*body).alias("body")] if body else []))
    rows = floor.groupBy("tree", F.floor(F.col("rank") / width).cast("long").alias("bucket")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
    rows = rows.withColumn("l0", F.transform("kids", lambda k: F.struct(k["lo"].alias("lo"), k["hi"].alias("hi"), k["digest"].alias("digest"))))
    more = (F.col("bucket") > 0) | (F.size("kids") == width)

    def parent(run: Column) -> Column:
        text = F.array_join(F.transform(run, lambda x: x["digest"]), "")
        return F.struct(F.element_at(run, 1)["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"), F.sha2(text, 256).alias("digest"))

    for k in range(STOREY):
        below = F.col(f"l{k}")
        runs = F.transform(F.sequence(F.lit(0), _whole(F.size(below) - 1, FAN)), lambda i: parent(F.slice(below, i * FAN + 1, FAN)))  # noqa: B023
        rows = rows.withColumn(f"l{k + 1}", F.when((F.size(below) > 1) | (more & (F.size(below) > 0)), runs).otherwise(F.slice(below, 1, 0)))
    levels = [F.col(f"l{k}") for k in range(STOREY + 1)]
    height = sum((F.size(x) > 0).cast("int") for x in levels[1:])
    top = F.element_at(F.filter(F.array(*levels), lambda x: F.size(x) > 0), -1)
    return rows.withColumn("height", height).withColumn("top", F.element_at(top, 1)).select("*", "top.lo", "top.hi", "top.digest").drop("top")


def _storeys(floor: DataFrame, body: list[str]) -> list[DataFrame]:
    """Written storeys of all trees, from the leaves up; the last has one bucket a tree."""
    built = [stash(_storey(floor, body), "storey")]
    while not built[-1].where("bucket > 0").isEmpty():
        built.append(stash(_storey(built[-1].select("tree", F.col("bucket").alias("rank"), "lo", "hi", "digest"), []), "storey"))
    return built


def _beside(k: int) -> Column:
    """For each node of a bucket's level k: the digests of its siblings on the left (l) and on the right (r)."""
    level = F.col(f"l{k}")

    def step(own: Column, i: Column) -> Column:
        run = F.slice(level, _whole(i, FAN) * FAN + 1, FAN)  # what the parent's interval covers
        text = lambda nodes: F.array_join(F.transform(nodes, lambda x: x["digest"]), "")
        return F.struct(text(F.filter(run, lambda x: x["hi"] <= own["lo"])).alias("l"), text(F.filter(run, lambda x: x["lo"] >= own["hi"])).alias("r"))

    return F.transform(level, step)


def _path(i: Column) -> Column:
    """For the node at place i of a bucket's floor, the siblings of its ancestor on each level."""
    return F.slice(F.array(*(F.get(f"s{k}", _whole(i, FAN**k)) for k in range(STOREY))), F.lit(1), F.col("height"))


def _descended(storeys: list[DataFrame], heads: DataFrame, carried: list[str]) -> DataFrame:
    """The leaves of storeys with their way to the root: heads(tree, rank, lo, hi, path, carried) are the trees' tops."""
    for storey in reversed(storeys):
        above = heads.select(F.col("tree").alias("_tree"), F.col("rank").alias("_rank"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("path").alias("_path"), *carried)
        inside = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("bucket") == F.col("_rank")) & (F.col("lo") >= F.col("_lo")) & (F.col("hi") <= F.col("_hi"))
        found = storey.join(above, inside).withColumns({f"s{k}": _beside(k) for k in range(STOREY)})
        ways = F.transform("kids", lambda kid, i: F.struct(kid.alias("kid"), F.concat(_path(i), F.col("_path")).alias("path")))
        heads = found.select("tree", *carried, F.explode(ways).alias("way")).select("tree", *carried, "way.kid.*", "way.path")
    return heads


@dataclass
class Manifest:
    """Written storeys of the sources' trees, and of the tree over their roots."""

    trees: list[DataFrame]
    top: list[DataFrame]

    def nodes(self) -> DataFrame:
        """tree, level, lo, hi, digest of every node of the sources' trees."""
        out = []
        for s, storey in enumerate(self.trees):
            first = 0 if s == 0 else 1  # a storey's floor is the top of the one below
            out += [storey.select("tree", F.lit(s * STOREY + k).alias("level"), F.inline(f"l{k}")) for k in range(first, STOREY + 1)]
        rows = out[0]
        for df in out[1:]:
            rows = rows.unionByName(df)
        return rows

    def roots(self) -> DataFrame:
        """tree, subroot, root, and path, the siblings between them."""
        head = self.top[-1].select("tree", F.lit(0).cast("long").alias("rank"), "lo", "hi", F.col("digest").alias("root"))
        head = head.withColumn("path", F.expr("cast(array() as array<struct<l:string,r:string>>)"))
        found = _descended(self.top, head, ["root"])
        return found.select(F.col("body.source").alias("tree"), "body.size", F.col("digest").alias("subroot"), "root", "path")

    def proofs(self) -> DataFrame:
        """tree, rank, digest, body, subroot, root and path of every leaf."""
        heads = self.roots().select("tree", F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi"), "path", "subroot", "root")
        return _descended(self.trees, heads, ["subroot", "root"])


def build(leaves: DataFrame, tree: str, key: str) -> Manifest:
    """The manifest of leaves(tree, key, leaf, ...): in a tree leaves ascend by key, nulls first, and equal keys by leaf. Further columns become the leaves' body."""
    body = [c for c in leaves.columns if c not in (tree, "leaf")]
    rows = ranked(leaves, [tree], [key, "leaf"])
    floor = rows.select(F.col(tree).alias("tree"), "rank", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.col("leaf").alias("digest"), *body)
    trees = _storeys(floor, body)
    drop_stash(rows)
    tops = trees[-1].select(F.col("tree").alias("source"), F.col("hi").alias("size"), "digest")
    rows = ranked(tops, [], ["source"])
    top = _storeys(rows.select(F.lit(0).alias("tree"), "rank", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", "source", "size"), ["source", "size"])
    return Manifest(trees, top)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(path, start, lambda acc, step: F.sha2(F.concat(step["l"], acc, step["r"]), 256))


def proof_digest(path: Column) -> Column:
    """One digest for all siblings, level by level and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["l"], step["r"])), ""), 256)


def verified(docs: DataFrame, changed: Column, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text: str = "text") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    Where changed is true, text loses its line feeds after the manifest is made; folded_root comes from
    the row as it then is and the siblings kept, and verified tells whether it is the root. Only
    columns are read, whatever else docs has, and any of them may be null. Rows of one doc_id in a source, equal
    or not, are leaves of their own, in the order of their digests. A null source is a source of its own. An
    empty table gives an empty result.
    """
    after = F.when(changed, F.replace(F.col(text), F.lit("\n"))).otherwise(F.col(text))
    now = leaf(*(after if c == text else c for c in columns))
    before = leaf(*columns)
    rows = docs.select("source", "doc_id", before.alias("leaf"), F.when(now != before, now).alias("tampered"))
    found = build(rows, "source", "doc_id").proofs()
    back = folded(F.coalesce("body.tampered", "digest"), F.col("path"))
    found = found.select(F.col("body.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(key: str = "doc_id") -> Column:
    """Rows to tamper with: crc32 of the key as decimal text is even. A null key is empty text."""
    return fold(key, 2) == 0
