"""Elements as one ordered table, and the questions asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.functions import strings as S
from docflow.operators import body as B
from docflow.operators.tree import KEY

COLUMNS = f"doc_id string, phase int, pre int, sub int, ordinal int, type string, text string, level int, label string, rows array<array<string>>, kind string, name string, summary string, color string, spans {B.SPAN_TYPE}, style {B.STYLE_TYPE}"


def as_elements(df: DataFrame, phase: int, sub: int | Column, type_: str | Column, **columns: Column) -> DataFrame:
    """df as rows of the elements table; columns that aren't given are null."""
    have = {"phase": F.lit(phase), "sub": F.lit(sub) if isinstance(sub, int) else sub, "ordinal": F.lit(0), "type": F.lit(type_) if isinstance(type_, str) else type_} | columns
    out = []
    for field in T.StructType.fromDDL(COLUMNS).fields:
        value = have.get(field.name, F.col(field.name) if field.name in df.columns else F.lit(None))
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out)


def body_rows(nodes: DataFrame, blank: bool = False) -> DataFrame:
    """The body's elements, unnumbered: paragraphs and headers, page breaks after their paragraph, tables. blank: paragraphs without text too."""
    found = B.blocks(nodes)
    text, is_p = F.coalesce("text", F.lit("")), F.col("name") == "p"
    head, kept = B.element_of(blank)
    kind = F.when(~is_p, "table").when(head, "header").otherwise("paragraph")
    kept = F.when(is_p, kept).otherwise(F.size("rows") > 0)
    here = F.when(kept, F.struct(F.lit(4).alias("sub"), F.lit(0).alias("ordinal"), kind.alias("type")))
    count = F.coalesce(F.col("breaks"), F.lit(0)).cast("int")
    breaks = F.transform(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.lit(5).alias("sub"), i.alias("ordinal"), F.lit("page_break").alias("type")))
    rows = found.select("*", F.explode(F.concat(F.array_compact(F.array(here)), breaks)).alias("e"))
    kind = F.col("e.type")
    whole = F.when(kind == "header", S.ktrim(text)).when(kind == "paragraph", text)
    first = F.coalesce(F.get("spans", F.lit(0))["color"], F.lit("000000"))
    of = lambda value, *kinds: F.when(kind.isin(*kinds), value)
    return as_elements(
        rows, 2, F.col("e.sub"), kind, ordinal=F.col("e.ordinal"), text=whole, level=of(F.col("heading_level"), "header"), label=of(F.col("label"), "header", "paragraph"), rows=of(F.col("rows"), "table"),
        name=F.lit(None), color=of(first, "paragraph"), spans=of(F.col("spans"), "paragraph"), style=of(F.col("style"), "paragraph"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """rows with seq, their place in the document from 0."""
    order = Window.partitionBy("doc_id").orderBy("phase", "pre", "sub", "ordinal")
    return rows.withColumn("seq", F.row_number().over(order) - 1)


def document_elements(nodes: DataFrame, *more: DataFrame, blank: bool = False) -> DataFrame:
    """All elements of each document in order: the rows of more (phases 0 and 1), then the body. blank: paragraphs without text too, which are otherwise dropped."""
    rows = body_rows(nodes, blank)
    for df in more:
        rows = rows.unionByName(df)
    return numbered(rows)


def of_type(elements: DataFrame, type_: str) -> DataFrame:
    return elements.where(F.col("type") == type_)


def _table_text(cell: str, row: str) -> Column:
    return F.array_join(F.transform("rows", lambda r: F.array_join(r, cell)), row)


def element_text() -> Column:
    """What an element is as plain text."""
    kind = F.col("type")
    labelled = F.concat(F.coalesce(F.concat("label", F.lit(" ")), F.lit("")), F.coalesce("text", F.lit("")))
    return (
        F.when(kind == "paragraph", labelled).when(kind.isin("header", "section", "note", "comment", "header_footer"), F.coalesce("text", F.lit(""))).when(kind == "table", _table_text("\t", "\n"))
        .when(kind == "metadata", F.concat(F.coalesce(F.col("name"), F.col("kind")), F.lit(": "), F.coalesce("summary", F.lit("")))).when(kind == "bookmark", F.col("name")).when(kind == "field", F.col("text"))
        .when(kind == "drawing", F.col("kind")).when(kind == "object", F.coalesce("summary", "kind")).when(kind == "image", F.coalesce("text", "summary", F.lit(""))).otherwise("")
    )


def _listed(rows: DataFrame, value: Column, sep: str, out: str) -> DataFrame:
    pairs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", value.alias("v")))).alias("all"))
    return pairs.select("doc_id", F.array_join(F.transform("all", lambda s: s["v"]), sep).alias(out))


def to_plain_text(elements: DataFrame) -> DataFrame:
    """doc_id, text: the texts of a document's elements, joined by line feeds."""
    return _listed(elements, element_text(), "\n", "text")


def extract_all_text(elements: DataFrame) -> DataFrame:
    """doc_id, text: paragraphs, headers marked by their level, and tables, each ended by a line feed."""
    value = F.when(F.col("type") == "header", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text")).when(F.col("type") == "table", _table_text(" | ", "\n")).otherwise(F.col("text"))
    rows = elements.where(F.col("type").isin("paragraph", "header", "table"))
    return _listed(rows, F.concat(value, F.lit("\n")), "", "text")


def metadata_map(elements: DataFrame) -> DataFrame:
    """doc_id, kind, summary: of a document's metadata of one kind the last."""
    return of_type(elements, "metadata").groupBy("doc_id", "kind").agg(F.max_by("summary", "seq").alias("summary"))


def outline(elements: DataFrame) -> DataFrame:
    """doc_id, seq, entry: headers, indented by their level."""
    return of_type(elements, "header").select("doc_id", "seq", F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- "), "text").alias("entry"))


def display_text(elements: DataFrame) -> DataFrame:
    """doc_id, seq, shown: annotations as a reader shows them."""
    kind = F.col("type")
    shown = (
        F.when(kind == "comment", F.concat(F.lit("comment by "), F.coalesce(S.non_blank(F.col("name")), F.lit("unknown")), F.lit(": "), "text"))
        .when(kind == "note", F.concat("kind", F.lit(" "), F.coalesce("name", F.lit("")), F.lit(": "), "text")).when(kind == "header_footer", F.concat("kind", F.lit(" ("), "name", F.lit("): "), "text"))
        .when(kind == "bookmark", F.concat(F.lit("bookmark "), "kind", F.lit(": "), "name")).when(kind == "field", F.concat(F.lit("field "), "kind", F.lit(": "), "text"))
        .when(kind == "object", F.concat(F.lit("embedded object: "), F.coalesce("name", "kind"))).when(kind == "image", F.coalesce("summary", "name", F.lit("Image unavailable"))).otherwise(element_text())
    )
    return elements.select("doc_id", "seq", shown.alias("shown"))


def parse_color(color: Column) -> Column:
    """A hexadecimal colour as ARGB in a long: six digits are opaque, eight have their own alpha, all else is black."""
    digits = F.regexp_replace(color, "^#", "")
    value = F.conv(digits, 16, 10).cast("long")
    return F.when(digits.rlike("^[0-9A-Fa-f]{6}$"), value + 0xFF000000).when(digits.rlike("^[0-9A-Fa-f]{8}$"), value).otherwise(F.lit(0xFF000000))


def merged_edits(edits: DataFrame) -> DataFrame:
    """doc_id, seq, edit, new_text: of a log's edits of one place the last, by its number edit (0 where the log has none), then by text."""
    numbered_ = edits if "edit" in edits.columns else edits.withColumn("edit", F.lit(0))
    last = numbered_.groupBy("doc_id", "seq").agg(F.max(F.struct("edit", F.coalesce("new_text", F.lit("")).alias("new_text"))).alias("last"))
    return last.select("doc_id", "seq", "last.*")


def apply_edits(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """elements with the texts of a log of edits(doc_id, seq, new_text, and edit, their number in the log) in the paragraphs at those places; of one place the last edit counts.

    A place that is no paragraph is left alone. An edited paragraph is one span without formats but for color, that of the paragraph's first span. Null text is empty text.
    """
    joined = elements.join(merged_edits(edits).drop("edit"), ["doc_id", "seq"], "left")
    edited = (F.col("type") == "paragraph") & F.col("new_text").isNotNull()
    text = F.when(edited, F.col("new_text")).otherwise(F.col("text"))
    if "spans" in elements.columns:
        color = F.coalesce(F.get("spans", F.lit(0))["color"], F.lit("000000"))
        plain = F.array(F.struct(*(F.col("new_text").alias(x) if x == "text" else color.alias(x) if x == "color" else (F.lit(None) if x in B.UNSET else F.lit(False)).alias(x) for x in B.SPAN))).cast(B.SPAN_TYPE)
        joined = joined.withColumn("spans", F.when(edited, plain).otherwise(F.col("spans")))
    return joined.withColumn("text", text).drop("new_text")


def rejected_edits(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, seq, edit, new_text, reason of the edits that apply_edits leaves out: out of range, no paragraph, or stale, where a later edit of the place counts. Equal edits are one edit."""
    numbered_ = (edits if "edit" in edits.columns else edits.withColumn("edit", F.lit(0))).withColumn("new_text", F.coalesce("new_text", F.lit(""))).select("doc_id", "seq", "edit", "new_text").distinct()
    places = elements.select("doc_id", "seq", F.col("type").alias("_type"))
    last = merged_edits(edits).select("doc_id", "seq", F.struct("edit", "new_text").alias("_last"))
    joined = numbered_.join(places, ["doc_id", "seq"], "left").join(last, ["doc_id", "seq"])
    reason = F.when(F.col("_type").isNull(), "out of range").when(F.col("_type") != "paragraph", "no paragraph").when(F.struct("edit", "new_text") != F.col("_last"), "stale")
    return joined.select("doc_id", "seq", "edit", "new_text", reason.alias("reason")).where("reason is not null")


def element_counts(elements: DataFrame) -> DataFrame:
    """type, kind, n over the corpus."""
    return elements.groupBy("type", "kind").agg(F.count("*").alias("n"))


def flatten_spans(nodes: DataFrame, rels: DataFrame | None = None, blank: bool = False) -> DataFrame:
    """doc_id, para, ordinal and the fields of each span, with its paragraph's alignment, list level and format, and, given relationships, the address and anchor of the paragraph's first link. blank: of paragraphs of white space too."""
    rows = B.heading_or_paragraph(nodes, blank).where("type = 'paragraph'")
    more = ["alignment", "list_level", "format"]
    if rels is not None:
        links = B.hyperlinks(nodes, rels).select(*KEY, F.col("p").alias("pre"), F.col("address").alias("link_address"), F.col("anchor").alias("link_anchor"))
        rows, more = rows.join(links, [*KEY, "pre"], "left"), [*more, "link_address", "link_anchor"]
    return rows.select("doc_id", "para", *more, F.posexplode("spans").alias("ordinal", "s")).select("doc_id", "para", "ordinal", *more, "s.*")
