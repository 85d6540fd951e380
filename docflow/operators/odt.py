"""Elements of OpenDocument texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions import strings as S
from docflow.operators import body as B
from docflow.operators import elements as E
from docflow.operators.tree import KEY, attr, enclosing, first_per, in_order, named, steps, subtree_text

PART = "content.xml"
STOPS = ["h", "p", "table", "frame"]
INLINE = ["span", "s", "tab", "line-break", "a"]


def _placed(rows: DataFrame) -> DataFrame:
    """rows of content.xml, the elements of STOPS and office:text among them, with root (the place on their way, as names, after the document's first office:text; null outside it),
    top and top_name: the outermost of STOPS that they stand in or are; and ord, that one's number in the document. One exchange by document; no join.
    """
    doc, way = Window.partitionBy("doc_id"), F.col("way")
    rows = rows.withColumn("way", steps())
    first = F.min(F.when((F.col("name") == "text") & (F.col("qname") == "office:text"), F.col("pre"))).over(doc)
    rows = rows.withColumn("root", F.nullif(F.array_position("anc", first).cast("int"), F.lit(0)))
    at = F.get(F.filter(F.sequence(F.lit(0), F.size("anc")), lambda i: (i >= F.col("root")) & F.get(way, i).isin(STOPS)), F.lit(0))
    rows = rows.withColumn("at", F.when(F.col("root").isNotNull(), at))
    own = F.col("root").isNotNull() & F.col("at").isNull() & F.col("name").isin(STOPS)
    rows = rows.withColumns({"is_top": F.coalesce(own, F.lit(False)), "top": F.when(own, F.col("pre")).otherwise(F.get("anc", F.col("at"))), "top_name": F.when(own, F.col("name")).otherwise(F.get(way, F.col("at")))})
    return rows.withColumn("ord", F.sum(F.col("is_top").cast("int")).over(doc.orderBy("pre")) - 1)


def _content(nodes: DataFrame, *names: str, texts: bool = False) -> DataFrame:
    """What _placed needs of content.xml, elements of further names and, if asked for, texts."""
    wanted = F.coalesce(F.col("name").isin(*STOPS, *names) | (F.col("qname") == "office:text"), F.lit(False))
    return nodes.where((F.col("part") == PART) & (wanted | (F.col("kind") == "text") if texts else wanted))


def odt_body(nodes: DataFrame) -> DataFrame:
    """doc_id, part, pre, name, attrs, ord: headings, paragraphs, tables and frames of office:text that stand in none of these, however deep in sections and lists."""
    return _placed(_content(nodes)).where("is_top").select(*KEY, "pre", "name", "attrs", F.col("ord").cast("int").alias("ord"))


def odt_styles(nodes: DataFrame) -> DataFrame:
    """doc_id, style, bold, italic, underline, color, size of each named style, of equal names the last."""
    rows = named(nodes, "style", "text-properties", part=PART)
    is_style = F.col("name") == "style"
    grouped = rows.groupBy("doc_id", F.when(is_style, F.col("pre")).otherwise(F.col("parent")).alias("pre")).agg(
        F.max(F.when(is_style, attr("style:name"))).alias("style"), F.min_by("attrs", F.when(~is_style, F.col("pre"))).alias("attrs")
    )
    rows = grouped.where("style is not null")
    color = attr("color")
    rows = rows.select(
        "doc_id", "style", "pre", F.coalesce(attr("font-weight") == "bold", F.lit(False)).alias("bold"), F.coalesce(attr("font-style") == "italic", F.lit(False)).alias("italic"),
        attr("text-underline-style").isNotNull().alias("underline"), F.when(color.startswith("#"), S.after_first(color, "#")).alias("color"), S.to_float(attr("font-size")).alias("size"),
    )
    return first_per(rows.withColumn("last", -F.col("pre")), ["doc_id", "style"], "last").drop("pre", "last")


def odt_spans(nodes: DataFrame) -> DataFrame:
    """doc_id, ord, i, text, bold, italic, underline, color, size: the spans of body paragraphs in order.

    Text that isn't blank, styled spans as a whole, spaces, tabs, line breaks and links;
    other elements are descended into. Blank text between spans is lost.
    """
    rows = _placed(_content(nodes, *INLINE, texts=True)).where("top_name = 'p' and not is_top")
    outer = F.get(enclosing(*INLINE, start=F.col("at") + 1, way=F.col("way")), F.lit(0))  # the outermost inline element in the paragraph that a row stands in
    inline = (F.col("kind") == "elem") & F.col("name").isin(INLINE)
    rows = rows.where((F.col("kind") == "text") | inline).withColumn("unit", F.coalesce(outer, "pre"))
    own = inline & (F.col("unit") == F.col("pre"))
    units = rows.groupBy("doc_id", "ord", "unit").agg(
        F.first(F.when(own, F.col("name")), ignorenulls=True).alias("name"), F.first(F.when(own, F.col("attrs")), ignorenulls=True).alias("attrs"), F.coalesce(in_order("text", "pre"), F.lit("")).alias("inner")
    )
    units = units.where(F.col("name").isNotNull() | S.non_blank(F.col("inner")).isNotNull())
    count = F.coalesce(S.to_int(attr("c")), F.lit(1))
    value = F.when(F.col("name") == "s", F.repeat(F.lit(" "), count)).when(F.col("name") == "tab", "\t").when(F.col("name") == "line-break", "\n").otherwise(F.col("inner"))
    style = F.when(F.col("name") == "span", attr("style-name"))
    names = ["bold", "italic", "underline", "color", "size"]
    styles = odt_styles(nodes).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("style", F.struct(*names)))).alias("styles"))
    link, off = F.coalesce(F.col("name") == "a", F.lit(False)), F.lit(False)
    rows = units.withColumn("style", style).join(styles, "doc_id", "left").withColumn("style", F.when(F.col("style").isNotNull(), F.try_element_at("styles", F.col("style"))))
    rows = rows.select("doc_id", "ord", "unit", value.alias("text"), link.alias("link"), "style.*")
    return rows.select(
        "doc_id", F.col("ord").cast("int").alias("ord"), (F.row_number().over(Window.partitionBy("doc_id", "ord").orderBy("unit")) - 1).alias("i"), "text", F.coalesce("bold", off).alias("bold"), F.coalesce("italic", off).alias("italic"),
        (F.col("link") | F.coalesce("underline", off)).alias("underline"), F.when(F.col("link"), "0000EE").otherwise(F.coalesce("color", F.lit("000000"))).alias("color"), F.coalesce(F.col("size").cast("int"), F.lit(12)).alias("size"),
    )


def odt_headings(nodes: DataFrame) -> DataFrame:
    """doc_id, ord, level, text."""
    heads = odt_body(nodes).where("name = 'h'")
    return subtree_text(heads, nodes, "h", part=PART).select("doc_id", "ord", F.coalesce(S.to_int(attr("outline-level")), F.lit(1)).alias("level"), F.col("value").alias("text"))


def odt_tables(nodes: DataFrame) -> DataFrame:
    """doc_id, ord, rows: all rows and cells below a body table, those of inner tables among them; a cell is repeated for the columns it spans."""
    rows = _placed(_content(nodes, "table-cell", texts=True)).where("top_name = 'table'")
    cell = (F.col("kind") == "elem") & (F.col("name") == "table-cell")
    within = F.concat(enclosing("table-cell", start=F.col("at"), way=F.col("way")), F.when(cell, F.array("pre")).otherwise(F.array().cast("array<int>")))
    rows = rows.where(cell | (F.col("kind") == "text")).withColumn("cell", F.explode(within))
    own = cell & (F.col("cell") == F.col("pre"))
    wide = F.greatest(F.coalesce(S.to_int(attr("number-columns-spanned")), F.lit(1)), F.lit(1))
    cells = rows.groupBy("doc_id", "ord", "cell").agg(S.ktrim(F.coalesce(in_order("text", "pre"), F.lit(""))).alias("value"), F.max(F.when(own, wide)).alias("n"), F.first(F.when(own, enclosing("table-row", start=F.col("at"), way=F.col("way"))), ignorenulls=True).alias("trs"))
    by_row = cells.select("doc_id", "ord", "cell", "value", "n", F.explode("trs").alias("tr")).groupBy("doc_id", "ord", "tr")
    by_row = by_row.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("cell", "value", "n"))), lambda s: F.array_repeat(s["value"], s["n"]))).alias("texts"))
    return by_row.groupBy("doc_id", F.col("ord").cast("int").alias("ord")).agg(F.transform(F.array_sort(F.collect_list(F.struct("tr", "texts"))), lambda s: s["texts"]).alias("rows"))


def odt_images(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, ord, uri, alt: the first image of each body frame, if it says where its bytes are and the package has them, with the frame's first description."""
    rows = _placed(_content(nodes, "image", "desc", texts=True)).where("top_name = 'frame'")
    image = F.col("name") == "image"
    desc = F.when(F.col("name") == "desc", F.col("pre")).otherwise(F.get(enclosing("desc", start=F.col("at"), way=F.col("way")), F.lit(0)))
    texts = rows.groupBy("doc_id", "ord", desc.alias("desc")).agg(F.coalesce(in_order("text", "pre"), F.lit("")).alias("text"), F.min(F.when(image, F.struct("pre", F.coalesce(attr("href"), F.lit("")).alias("href")))).alias("image"))
    frames = texts.groupBy("doc_id", F.col("ord").cast("int").alias("ord")).agg(F.min("image")["href"].alias("href"), S.ktrim(F.min_by("text", "desc")).alias("alt"))
    found = frames.where("href <> ''").join(parts.select("doc_id", F.col("part").alias("href")), ["doc_id", "href"], "left_semi")
    return found.select("doc_id", "ord", F.concat("doc_id", F.lit("#"), "href").alias("uri"), "alt")


def odt_metadata(nodes: DataFrame) -> DataFrame:
    """doc_id, title, author, description, created, modified, words of documents whose meta.xml can be read."""
    heads = named(nodes, "title", "creator", "description", "creation-date", "date", part="meta.xml")
    values = subtree_text(heads.select(*KEY, "pre", "name"), nodes, "title", "creator", "description", "creation-date", "date", part="meta.xml")
    value = lambda name: S.non_blank(F.min_by("value", F.when(F.col("name") == name, F.col("pre")))).alias(name)
    words = named(nodes, "document-statistic", part="meta.xml").groupBy("doc_id").agg(F.min(attr("word-count")).alias("words"))
    docs = nodes.where("part = 'meta.xml' and pre = 0").select("doc_id")
    rows = docs.join(values.groupBy("doc_id").agg(*map(value, ["title", "creator", "description", "creation-date", "date"])), "doc_id", "left").join(words, "doc_id", "left")
    return rows.select("doc_id", "title", F.col("creator").alias("author"), "description", F.col("creation-date").alias("created"), F.col("date").alias("modified"), "words")


def odt_elements(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """The elements of OpenDocument texts, numbered: metadata where meta.xml can be read, then headings, paragraphs (empty ones too), tables and images."""
    meta = odt_metadata(nodes)
    rows = E.as_elements(meta, 1, 0, "metadata", pre=F.lit(0), kind=F.lit("ODT Metadata"), name=F.col("title"), summary=F.lit(""))
    rows = rows.unionByName(E.as_elements(odt_headings(nodes), 2, 0, "header", pre=F.col("ord")))
    made = {"font": F.lit(None), "size": F.col("size"), "highlight": F.lit(None), "spacing": F.lit(None), "language": F.lit(None)} | {x: F.col(x) for x in ("text", "bold", "italic", "underline", "color")}
    span = F.struct(F.col("i"), *(made.get(x, F.lit(False)).alias(x) for x in B.SPAN))
    grouped = odt_spans(nodes).groupBy("doc_id", "ord").agg(F.array_sort(F.collect_list(span)).alias("ordered"))
    spans = F.transform("ordered", lambda s: F.struct(*(s[x].alias(x) for x in B.SPAN)))
    paras = odt_body(nodes).where("name = 'p'").select("doc_id", "ord").join(grouped, ["doc_id", "ord"], "left").withColumn("spans", F.coalesce(spans.cast(B.SPAN_TYPE), F.array().cast(B.SPAN_TYPE)))
    text = F.array_join(F.transform("spans", lambda s: s["text"]), "")
    rows = rows.unionByName(E.as_elements(paras, 2, 0, "paragraph", pre=F.col("ord"), text=text, color=F.coalesce(F.get("spans", F.lit(0))["color"], F.lit("000000"))))
    rows = rows.unionByName(E.as_elements(odt_tables(nodes), 2, 0, "table", pre=F.col("ord")))
    images = odt_images(nodes, parts)
    return E.numbered(rows.unionByName(E.as_elements(images, 2, 0, "image", pre=F.col("ord"), kind=F.lower(S.after_last(F.col("uri"), ".")), name=F.col("uri"), summary=F.col("alt"))))
