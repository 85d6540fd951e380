"""Moving about in the nodes table: children, descendants, attributes, subtree text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions import strings as S

KEY = ["doc_id", "part"]


def named(nodes: DataFrame, *names: str, part: str | None = None) -> DataFrame:
    """Elements by local name, in one part or in all."""
    found = nodes.where((F.col("kind") == "elem") & F.col("name").isin(*names)) if names else nodes.where("kind = 'elem'")
    return found.where(F.col("part") == part) if part else found


def attr(name: str, attrs: str = "attrs") -> Column:
    """The attribute with exactly this name, else the first (by qualified name) with it as its local name."""
    local = F.element_at(F.map_values(F.map_filter(F.col(attrs), lambda k, _: k.endswith(f":{name}"))), 1)
    return F.coalesce(F.col(attrs)[name], F.when(F.size(F.map_filter(F.col(attrs), lambda k, _: k.endswith(f":{name}"))) > 0, local))


def matches(local: str) -> Column:
    """Whether a node is an element of that local name, or, where it has none, of that name after the colon of its qualified name."""
    return (F.col("kind") == "elem") & (F.coalesce("name", F.substring_index("qname", ":", -1)) == local)


def children(heads: DataFrame, nodes: DataFrame, *names: str) -> DataFrame:
    """heads' element children, each with the head's pre as head."""
    own = named(nodes, *names).withColumnRenamed("parent", "head")
    return own.join(heads.select(*KEY, F.col("pre").alias("head")), [*KEY, "head"], "left_semi")


def first_child(heads: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """head and the first child of that name: its pre and attrs."""
    found = children(heads, nodes, name)
    return found.groupBy(*KEY, "head").agg(F.min("pre").alias("pre"), F.min_by("attrs", "pre").alias("attrs"))


def steps() -> Column:
    """The local names of what a node stands in, from the root to its parent: names for the pres of anc."""
    return F.split("path", "/")


def enclosing(*of: str, start: Column | None = None, way: Column | None = None) -> Column:
    """The pres of the elements of those names that a node stands in, outermost first; with start, those from that step on. way: steps() where a column has them."""
    way = steps() if way is None else way
    here = lambda i: F.get(way, i).isin(*of)
    return F.filter("anc", (lambda _, i: here(i)) if start is None else (lambda _, i: here(i) & (i >= start)))


def nearest(*of: str) -> Column:
    """The pre of the innermost element of those names that a node stands in, or null."""
    return F.try_element_at(enclosing(*of), F.lit(-1))


def below(nodes: DataFrame, *names: str, of: list[str]) -> DataFrame:
    """Elements of those names once for each element of the names `of` that they stand in, which is head. A node's path tells that, so nothing else is made of its row."""
    return named(nodes, *names).withColumn("head", F.explode(enclosing(*of)))


def descendants(heads: DataFrame, nodes: DataFrame, *names: str, of: list[str]) -> DataFrame:
    """heads' descendants, each with the head's pre as head, the head itself not among them; `of`: the names that heads have.

    Heads and candidates meet in one exchange, by (doc_id, part, head).
    """
    found = below(nodes, *names, of=of)
    own = heads.select(*KEY, F.col("pre").alias("head"), F.lit(True).alias("_head"))
    both = found.withColumn("_head", F.lit(False)).unionByName(own, allowMissingColumns=True)
    known = F.bool_or("_head").over(Window.partitionBy(*KEY, "head"))
    return both.withColumn("_known", known).where("_known and not _head").select(*found.columns)


def in_order(value: str, order: str, sep: str = "") -> Column:
    """The values of a group as one text in that order."""
    return F.expr(f"listagg({value}, '{sep}') WITHIN GROUP (ORDER BY {order})")


def subtree_text(heads: DataFrame, nodes: DataFrame, *of: str, part: str | None = None) -> DataFrame:
    """heads, which have the names `of`, with value, the trimmed text of all text nodes below; blank where there are none.

    Heads and texts meet in one exchange. part: where all heads are in one part.
    """
    texts = nodes.where("kind = 'text'") if part is None else nodes.where((F.col("kind") == "text") & (F.col("part") == part))
    texts = texts.select(*KEY, F.col("pre").alias("_at"), F.col("text").alias("_text"), F.explode(enclosing(*of)).alias("pre"))
    both = heads.withColumn("_head", F.lit(True)).unionByName(texts, allowMissingColumns=True)
    more = [F.first(c, ignorenulls=True).alias(c) for c in heads.columns if c not in (*KEY, "pre")]
    value = S.ktrim(F.coalesce(in_order("_text", "_at"), F.lit("")))
    return both.groupBy(*KEY, "pre").agg(*more, value.alias("value"), F.bool_or("_head").alias("_head")).where("_head").drop("_head")


def first_per(df: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """The first row of each group, as it is."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
