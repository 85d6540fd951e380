"""The body of word-processing documents: paragraphs, spans, styles, lists, tables, breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions import strings as S
from docflow.operators.tree import KEY, attr, below, first_per, in_order, named, steps

MAIN = "word/document.xml"
FLAGS = {"bold": "b", "italic": "i", "underline": "u", "strikethrough": "strike", "hidden": "vanish", "shadow": "shadow", "embossed": "emboss", "engraved": "imprint"}
BULLET = "•"


def body_elements(nodes: DataFrame) -> DataFrame:
    """doc_id, part, pre, name, ord: the p and tbl children of the body in order, ord from 0. Other children are left out."""
    found = named(nodes, "p", "tbl", part=MAIN).where(F.element_at(steps(), -1) == "body")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")) - 1
    return found.select(*KEY, "pre", "name", order.alias("ord"))


def paragraphs(nodes: DataFrame) -> DataFrame:
    """Body paragraphs with para, their number from 0 among paragraphs."""
    found = body_elements(nodes).where("name = 'p'")
    return found.withColumn("para", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")) - 1)


def runs(nodes: DataFrame) -> DataFrame:
    """doc_id, part, pre, p: each run with its paragraph. Runs stand in a paragraph directly, or in a link, simple field or insertion."""
    up = named(nodes, "p", "hyperlink", "fldSimple", "ins", "smartTag").select(*KEY, F.col("pre").alias("parent"), F.col("name").alias("up"), F.col("parent").alias("above"))
    own = named(nodes, "r").select(*KEY, "pre", "parent").join(up, [*KEY, "parent"])
    return own.select(*KEY, "pre", F.when(F.col("up") == "p", F.col("parent")).otherwise(F.col("above")).alias("p"))


def run_texts(nodes: DataFrame) -> DataFrame:
    """doc_id, part, pre, text of each run: its t, tabs as tabs, line breaks as line feeds; page breaks have no text."""
    pieces = named(nodes, "t", "tab", "br", "cr").select(*KEY, "pre", "parent", "name", attr("type").alias("type"))
    texts = nodes.where("kind = 'text'").select(*KEY, F.col("parent").alias("pre"), "text")
    pieces = pieces.join(texts, [*KEY, "pre"], "left")
    value = F.when(F.col("name") == "t", F.coalesce("text", F.lit(""))).when(F.col("name") == "tab", "\t").when(F.col("type") == "page", "").otherwise("\n")
    pieces = pieces.withColumn("value", value)
    return pieces.groupBy(*KEY, F.col("parent").alias("pre")).agg(in_order("value", "pre").alias("text"))


def _on(value: Column) -> Column:
    return F.coalesce(~F.lower(value).isin("0", "false", "none", "off"), F.lit(True))


def run_properties(nodes: DataFrame) -> DataFrame:
    """One row per run with properties: the flags and values of its rPr."""
    holder = named(nodes, "rPr").select(*KEY, F.col("pre").alias("parent"))
    names = [*FLAGS.values(), "vertAlign", "rFonts", "sz", "color", "highlight", "spacing", "lang"]
    props = named(nodes, *names).join(holder, [*KEY, "parent"], "left_semi").withColumn("run", F.element_at("anc", -2))
    value = lambda name: F.max(F.when(F.col("name") == name, F.coalesce(attr("val"), F.lit(""))))
    flags = [F.coalesce(F.bool_or(F.when(F.col("name") == tag, _on(attr("val")))), F.lit(False)).alias(flag) for flag, tag in FLAGS.items()]
    place = F.lower(value("vertAlign"))
    fonts = F.max(F.when(F.col("name") == "rFonts", F.coalesce(attr("ascii"), attr("cs"))))
    return props.groupBy(*KEY, F.col("run").alias("pre")).agg(
        *flags, F.coalesce(place == "superscript", F.lit(False)).alias("superscript"), F.coalesce(place == "subscript", F.lit(False)).alias("subscript"),
        fonts.alias("font"), S.to_int(value("sz")).alias("sz"), value("color").alias("rgb"), value("highlight").alias("highlight"), S.to_int(value("spacing")).alias("gap"), value("lang").alias("language"),
    )


def spans(nodes: DataFrame) -> DataFrame:
    """One row per run with text: doc_id, part, p, pre and the fields of a span, defaults filled in."""
    flags = [*FLAGS, "superscript", "subscript"]
    rows = runs(nodes).join(run_texts(nodes), [*KEY, "pre"]).where(F.col("text") != "").join(run_properties(nodes), [*KEY, "pre"], "left")
    points = F.floor(F.col("sz") / 2).cast("int")
    return rows.select(
        *KEY, "p", "pre", "text", *(F.coalesce(f, F.lit(False)).alias(f) for f in flags), F.lit(False).alias("outline"), "font",
        F.when(points > 0, points).otherwise(11).alias("size"), F.coalesce(S.non_blank(F.col("rgb")), F.lit("000000")).alias("color"), "highlight", F.nullif("gap", F.lit(0)).alias("spacing"), "language",
    )


SPAN = ["text", "bold", "italic", "underline", "strikethrough", "superscript", "subscript", "hidden", "shadow", "outline", "embossed", "engraved", "font", "size", "color", "highlight", "spacing", "language"]


def paragraph_spans(nodes: DataFrame) -> DataFrame:
    """doc_id, part, p, spans, text: each paragraph's spans in order and their whole text."""
    rows = spans(nodes)
    ordered = F.array_sort(F.collect_list(F.struct("pre", *SPAN)))
    grouped = rows.groupBy(*KEY, "p").agg(ordered.alias("ordered"))
    whole = F.array_join(F.transform("ordered", lambda s: s["text"]), "")
    own = F.transform("ordered", lambda s: F.struct(*(s[x].alias(x) for x in SPAN)))
    return grouped.select(*KEY, "p", own.alias("spans"), whole.alias("text"))


def map_alignment(jc: Column) -> Column:
    return F.when(jc.isin("right", "end"), "END").when(jc == "center", "CENTER").when(jc == "both", "JUSTIFIED").when(jc == "distribute", "DISTRIBUTED").otherwise("START")


def heading_level(style_id: Column, outline: Column) -> Column:
    """1 to 9 from a style id Heading1..9 in any case, else from the outline level, else null."""
    digit = F.regexp_extract(S.ktrim(style_id), "(?i)^Heading([1-9])$", 1)
    return F.coalesce(F.when(digit != "", digit.cast("int")), F.when((outline + 1).between(1, 9), outline + 1))


def paragraph_style(nodes: DataFrame) -> DataFrame:
    """doc_id, part, p and the properties of each paragraph that has any; zeros count as unset."""
    holder = named(nodes, "pPr").select(*KEY, F.col("pre").alias("parent"), F.col("parent").alias("p"))
    props = named(nodes, "pStyle", "jc", "ind", "spacing", "outlineLvl", "numPr").join(holder, [*KEY, "parent"])
    numbers = named(nodes, "numId", "ilvl").select(*KEY, "name", F.element_at("anc", -3).alias("p"), attr("val").alias("val"), F.element_at("anc", -1).alias("up"))
    lists = named(nodes, "numPr").select(*KEY, F.col("pre").alias("up"))
    numbers = numbers.join(lists, [*KEY, "up"], "left_semi").groupBy(*KEY, "p").agg(
        F.max(F.when(F.col("name") == "numId", F.col("val"))).alias("num_id"), S.to_int(F.max(F.when(F.col("name") == "ilvl", F.col("val")))).alias("ilvl")
    )
    value = lambda name, a: F.max(F.when(F.col("name") == name, attr(a)))
    number = lambda name, a: F.nullif(S.to_int(value(name, a)), F.lit(0))
    grouped = props.groupBy(*KEY, "p").agg(
        value("pStyle", "val").alias("style_id"), value("jc", "val").alias("jc"), number("ind", "left").alias("left"), number("ind", "right").alias("right"),
        number("ind", "firstLine").alias("first_line"), number("ind", "hanging").alias("hanging"), number("spacing", "before").alias("before"), number("spacing", "after").alias("after"),
        number("spacing", "line").alias("line"), S.to_int(value("outlineLvl", "val")).alias("outline_level"),
    )
    level = heading_level(F.col("style_id"), F.col("outline_level"))
    return grouped.join(numbers, [*KEY, "p"], "left").select(
        *KEY, "p", "style_id", F.col("style_id").alias("style_name"), map_alignment(F.col("jc")).alias("alignment"), "left", "right", "first_line", "hanging", "before", "after", "line", "outline_level",
        level.isNotNull().alias("is_heading"), level.alias("heading_level"), "num_id", "ilvl",
    )


def numbering(nodes: DataFrame) -> DataFrame:
    """doc_id, num_id, ilvl, format, level_text, start_override, font: each level that a list number leads to. A link that is missing leaves no row."""
    part = "word/numbering.xml"
    nums = named(nodes, "num", part=part).select("doc_id", F.col("pre").alias("num"), attr("numId").alias("num_id"))
    refs = named(nodes, "abstractNumId", part=part).select("doc_id", F.col("parent").alias("num"), attr("val").alias("abstract"))
    kinds = named(nodes, "abstractNum", part=part).select("doc_id", F.col("pre").alias("up"), attr("abstractNumId").alias("abstract"))
    levels = named(nodes, "lvl", part=part).select("doc_id", F.col("parent").alias("up"), F.col("pre").alias("lvl"), S.to_int(attr("ilvl")).alias("ilvl"))
    props = named(nodes, "numFmt", "lvlText", part=part).groupBy("doc_id", F.col("parent").alias("lvl")).agg(
        F.max(F.when(F.col("name") == "numFmt", attr("val"))).alias("format"), F.max(F.when(F.col("name") == "lvlText", attr("val"))).alias("level_text")
    )
    fonts = named(nodes, "rFonts", part=part).groupBy("doc_id", F.element_at("anc", -2).alias("lvl")).agg(F.max(attr("ascii")).alias("font"))
    over = named(nodes, "lvlOverride", part=part).select("doc_id", F.col("parent").alias("num"), F.col("pre").alias("at"), S.to_int(attr("ilvl")).alias("ilvl"))
    starts = named(nodes, "startOverride", part=part).select("doc_id", F.col("parent").alias("at"), S.to_int(attr("val")).alias("start_override"))
    over = over.join(starts, ["doc_id", "at"]).groupBy("doc_id", "num", "ilvl").agg(F.max("start_override").alias("start_override"))
    chain = nums.join(refs, ["doc_id", "num"]).join(kinds, ["doc_id", "abstract"]).join(levels, ["doc_id", "up"])
    chain = chain.join(props, ["doc_id", "lvl"], "left").join(fonts, ["doc_id", "lvl"], "left").join(over, ["doc_id", "num", "ilvl"], "left")
    return chain.select("doc_id", "num_id", "ilvl", F.coalesce("format", F.lit("bullet")).alias("format"), "level_text", "start_override", "font")


def list_label(fmt: Column, level_text: Column) -> Column:
    """The level's own pattern and a full stop for decimal lists, else a bullet; no running number is computed."""
    return F.when(fmt == "decimal", F.concat(F.coalesce(level_text, F.lit("")), F.lit("."))).when(fmt.isNotNull(), BULLET)


def lists(nodes: DataFrame) -> DataFrame:
    """doc_id, part, p, ilvl, format, level_text, start_override, font, label: paragraphs in lists whose chain is whole."""
    own = paragraph_style(nodes).where(F.col("num_id").isNotNull() & (F.col("num_id") != "-1")).select(*KEY, "p", "num_id", F.coalesce("ilvl", F.lit(0)).alias("ilvl"))
    return own.join(numbering(nodes), ["doc_id", "num_id", "ilvl"]).withColumn("label", list_label(F.col("format"), F.col("level_text")))


#: Fields of a span that are null where nothing is set; the flags are false.
UNSET = ["font", "size", "highlight", "spacing", "language"]
#: Where the body's paragraphs stand: in it, and in cells of its tables.
BODY = "document/body"
PARAGRAPHS = [f"{BODY}/p", f"{BODY}/tbl/tr/tc/p"]
LINKS = ["hyperlink", "fldSimple", "ins", "smartTag"]
PROPERTIES = ["pStyle", "jc", "ind", "spacing", "outlineLvl"]
STYLE = ["style_id", "alignment", "left", "right", "first_line", "hanging", "before", "after", "line"]
STYLE_TYPE = "struct<style_id:string,alignment:string,left:int,right:int,first_line:int,hanging:int,before:int,after:int,line:int>"
SPAN_TYPE = "array<struct<" + ",".join(f"{x}:{'string' if x in ('text', 'font', 'color', 'highlight', 'language') else 'int' if x in ('size', 'spacing') else 'boolean'}" for x in SPAN) + ">>"


def numbering_levels(nodes: DataFrame) -> DataFrame:
    """doc_id, levels: what numbering() has, as one array a document in the order of its definitions. One scan, one exchange."""
    rows = nodes.where((F.col("part") == "word/numbering.xml") & F.col("name").isin("num", "abstractNumId", "abstractNum", "lvl", "numFmt", "lvlText", "rFonts", "lvlOverride", "startOverride"))
    name, val = F.col("name"), attr("val")
    holder = F.when(name.isin("abstractNumId", "numFmt", "lvlText", "startOverride"), F.col("parent")).when(name == "rFonts", F.get("anc", F.size("anc") - 2)).otherwise(F.col("pre"))
    rows = rows.select("doc_id", "name", "parent", "pre", holder.alias("holder"), val.alias("val"), F.when(name == "rFonts", attr("ascii")).otherwise(F.coalesce(attr("numId"), attr("abstractNumId"), attr("ilvl"))).alias("id")).repartition("doc_id")
    value = lambda n, c="val": F.max(F.when(F.col("name") == n, F.col(c)))
    held = rows.groupBy("doc_id", "holder").agg(
        F.max(F.when(F.col("pre") == F.col("holder"), F.col("name"))).alias("what"), F.max(F.when(F.col("pre") == F.col("holder"), F.col("id"))).alias("id"), F.max(F.when(F.col("pre") == F.col("holder"), F.col("parent"))).alias("up"),
        value("abstractNumId").alias("abstract"), value("numFmt").alias("format"), value("lvlText").alias("level_text"), value("rFonts", "id").alias("font"), S.to_int(value("startOverride")).alias("start"),
    )
    of = lambda what, *cols: F.array_sort(F.collect_list(F.when(F.col("what") == what, F.struct("holder", *cols))))
    docs = held.groupBy("doc_id").agg(of("num", "id", "abstract").alias("nums"), of("abstractNum", "id").alias("kinds"), of("lvl", "up", S.to_int(F.col("id")).alias("ilvl"), "format", "level_text", "font").alias("lvls"), of("lvlOverride", "up", S.to_int(F.col("id")).alias("ilvl"), "start").alias("overs"))

    def level(num: Column, lvl: Column) -> Column:
        start = F.array_max(F.transform(F.filter("overs", lambda o: (o["up"] == num["holder"]) & (o["ilvl"] == lvl["ilvl"])), lambda o: o["start"]))
        return F.struct(num["id"].alias("num_id"), lvl["ilvl"].alias("ilvl"), F.coalesce(lvl["format"], F.lit("bullet")).alias("format"), lvl["level_text"].alias("level_text"), start.alias("start_override"), lvl["font"].alias("font"))

    of_kind = lambda num, kind: F.transform(F.filter("lvls", lambda v: v["up"] == kind["holder"]), lambda v: level(num, v))
    chain = F.transform("nums", lambda num: F.flatten(F.transform(F.filter("kinds", lambda kind: kind["id"] == num["abstract"]), lambda kind: of_kind(num, kind))))
    return docs.select("doc_id", F.flatten(chain).alias("levels"))


def blocks(nodes: DataFrame) -> DataFrame:
    """A row for each paragraph and table of the body: doc_id, pre, name, ord, para, spans, text, style, label, list (level, format), breaks (page breaks) and rows (of a table: the texts of its cells).

    One fold over the main part: what counts, told by its path, is dealt out by document once, each row knows its block, cell, paragraph and run from its
    own ancestors, and runs, paragraphs, cells, rows and blocks are aggregates of one another without another exchange. List labels come from numbering_levels, joined by document.
    """
    path, name, kind = F.col("path"), F.col("name"), F.col("kind")
    at = lambda *tails: path.isin([f"{p}{t}" for p in PARAGRAPHS for t in tails])
    runs_ = ["/r", *(f"/{x}/r" for x in LINKS)]
    own_props = [*FLAGS.values(), "vertAlign", "rFonts", "sz", "color", "highlight", "spacing", "lang"]
    in_t, in_r = (kind == "text") & at(*(f"{r}/t" for r in runs_)), name.isin("t", "tab", "br", "cr", "lastRenderedPageBreak") & at(*runs_)
    in_rpr, in_ppr, in_num = name.isin(own_props) & at(*(f"{r}/rPr" for r in runs_)), name.isin(PROPERTIES) & at("/pPr"), name.isin("numId", "ilvl") & at("/pPr/numPr")
    is_p, is_tr, is_tc = (name == "p") & path.isin(BODY, f"{BODY}/tbl/tr/tc"), (name == "tr") & (path == f"{BODY}/tbl"), (name == "tc") & (path == f"{BODY}/tbl/tr")
    rows = nodes.where((F.col("part") == MAIN) & F.coalesce(in_t | in_r | in_rpr | in_ppr | in_num | is_p | is_tr | is_tc | ((name == "tbl") & (path == BODY)), F.lit(False)))
    size, in_table = F.size("anc"), path.startswith(f"{BODY}/tbl")
    up = lambda i: F.coalesce(F.get("anc", F.lit(i)), F.when(size == i, F.col("pre")))  # noqa: E731  the node itself where it is on that step
    block_name = F.when(path == BODY, name).when(in_table, "tbl").otherwise("p")
    tr, tc = F.when(in_table, up(3)), F.when(in_table, up(4))
    p = F.when(in_table, up(5)).when(block_name == "p", up(2))
    run = F.when(in_t | in_rpr, F.get("anc", size - 2)).when(in_r, F.get("anc", size - 1))
    breaks = in_r & ((name == "lastRenderedPageBreak") | ((name == "br") & (attr("type") == "page")))
    value = F.when(kind == "text", F.col("text")).when(name == "tab", "\t").when((name == "cr") | (name == "br"), "\n").when(name == "t", "")
    # what an element says: a value, and further values where it has several attributes that count
    more = F.when(in_ppr & (name == "ind"), F.array(*(attr(x) for x in ("left", "right", "firstLine", "hanging")))).when(in_ppr & (name == "spacing"), F.array(*(attr(x) for x in ("before", "after", "line"))))
    said = F.when(name == "rFonts", F.coalesce(attr("ascii"), attr("cs"))).when(in_rpr | in_ppr | in_num, attr("val")).otherwise(value)
    rows = rows.select(
        "doc_id", up(2).alias("block"), block_name.alias("block_name"), tr.alias("tr"), tc.alias("tc"), p.alias("p"), run.alias("run"), "pre",
        F.when(in_rpr | in_ppr | in_num, name).when(breaks, "break").when(in_t | in_r, "").alias("prop"), said.alias("value"), more.alias("more"),
    ).repartition("doc_id")

    keys = ["doc_id", "block", "block_name", "tr", "tc", "p"]
    by_run = rows.groupBy(*keys, "run").agg(F.array_sort(F.collect_list(F.when(F.col("prop").isNotNull(), F.struct("pre", "prop", "value", "more")))).alias("items"))
    items = lambda n: F.filter("items", lambda x: x["prop"] == n)
    prop = lambda n: F.array_max(F.transform(items(n), lambda x: x["value"]))
    text_of = lambda n: F.array_max(F.transform(items(n), lambda x: F.coalesce(x["value"], F.lit(""))))
    number = lambda n, i: F.nullif(S.to_int(F.array_max(F.transform(items(n), lambda x: F.get(x["more"], F.lit(i))))), F.lit(0))
    flag = lambda n: F.exists("items", lambda x: (x["prop"] == n) & _on(x["value"]))
    place, points = F.lower(text_of("vertAlign")), F.floor(S.to_int(text_of("sz")) / 2).cast("int")
    plain = F.array_join(F.transform(items(""), lambda x: x["value"]), "")
    fields = {x: flag(tag) for x, tag in FLAGS.items()} | {
        "text": plain, "superscript": F.coalesce(place == "superscript", F.lit(False)), "subscript": F.coalesce(place == "subscript", F.lit(False)), "outline": F.lit(False), "font": prop("rFonts"), "size": F.when(points > 0, points).otherwise(11),
        "color": F.coalesce(S.non_blank(text_of("color")), F.lit("000000")), "highlight": text_of("highlight"), "spacing": F.nullif(S.to_int(text_of("spacing")), F.lit(0)), "language": text_of("lang"),
    }
    span = F.struct("run", *(fields[x].alias(x) for x in SPAN))
    own = {"style_id": prop("pStyle"), "jc": prop("jc")} | {c: number("ind", i) for i, c in enumerate(("left", "right", "first_line", "hanging"))} | {c: number("spacing", i) for i, c in enumerate(("before", "after", "line"))}
    own |= {"outline_level": S.to_int(prop("outlineLvl")), "num_id": prop("numId"), "ilvl": S.to_int(prop("ilvl"))}
    of_run = F.col("run").isNotNull()
    by_run = by_run.select(
        *keys, F.when(of_run & (plain != ""), span).alias("span"), F.when(~of_run, F.struct(*(v.alias(k) for k, v in own.items()))).alias("own"), F.when(of_run, F.size(items("break"))).otherwise(0).alias("breaks")
    )
    paras = by_run.groupBy(*keys).agg(F.array_sort(F.collect_list("span")).alias("ordered"), F.sum("breaks").alias("breaks"), F.first("own", ignorenulls=True).alias("own")).select(*keys, "ordered", "breaks", "own.*")
    paras = paras.join(numbering_levels(nodes), "doc_id", "left")
    own_level = F.coalesce("ilvl", F.lit(0))
    listed = F.get(F.filter("levels", lambda v: (v["num_id"] == F.col("num_id")) & (v["ilvl"] == own_level)), F.lit(0))
    listed = F.when(F.col("num_id").isNotNull() & (F.col("num_id") != "-1"), listed)
    style = F.struct(*(map_alignment(F.col("jc")).alias("alignment") if c == "alignment" else F.col(c) for c in STYLE))
    paras = paras.select(
        *keys, F.transform("ordered", lambda s: F.struct(*(s[x].alias(x) for x in SPAN))).alias("spans"), F.array_join(F.transform("ordered", lambda s: s["text"]), "").alias("text"), style.alias("style"),
        heading_level(F.col("style_id"), F.col("outline_level")).alias("heading_level"), listed.alias("list"), "breaks",
    ).withColumn("label", F.when(F.col("list").isNotNull(), list_label(F.col("list.format"), F.col("list.level_text"))))

    line = F.concat(F.coalesce(F.concat("label", F.lit(" ")), F.lit("")), F.col("text"))
    sole = ["spans", "text", "style", "heading_level", "list", "breaks", "label"]
    lone = F.first(F.when(F.col("p").isNotNull() & F.col("tr").isNull(), F.struct(*sole)), ignorenulls=True)
    texts = F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", line.alias("line")))))
    by_cell = paras.groupBy("doc_id", "block", "block_name", "tr", "tc").agg(F.array_join(F.transform(texts, lambda s: s["line"]), "\n").alias("cell"), lone.alias("lone"))
    by_row = by_cell.groupBy("doc_id", "block", "block_name", "tr").agg(F.array_sort(F.collect_list(F.when(F.col("tc").isNotNull(), F.struct("tc", "cell")))).alias("cells"), F.first("lone", ignorenulls=True).alias("lone"))
    whole = by_row.groupBy("doc_id", "block", "block_name").agg(F.array_sort(F.collect_list(F.when(F.size("cells") > 0, F.struct("tr", "cells")))).alias("rows"), F.first("lone", ignorenulls=True).alias("lone"))
    in_doc = Window.partitionBy("doc_id").orderBy("block")
    lone_p = F.col("block_name") == "p"
    return whole.select(
        "doc_id", F.lit(MAIN).alias("part"), F.col("block").alias("pre"), F.col("block_name").alias("name"), (F.row_number().over(in_doc) - 1).alias("ord"), F.when(lone_p, F.sum(lone_p.cast("int")).over(in_doc) - 1).cast("int").alias("para"),
        "lone.*", F.transform("rows", lambda r: F.transform(r["cells"], lambda c: c["cell"])).alias("rows"),
    )


def heading_or_paragraph(nodes: DataFrame, blank: bool = False) -> DataFrame:
    """doc_id, part, ord, para, pre, type, text, level, label, list_level, format, spans, alignment, style: body paragraphs as elements.

    A paragraph without text and label is dropped; one of a heading style with text is a
    header of the trimmed text, and its spans are not kept. blank: keep those without text too, see element_of().
    """
    return as_paragraphs(blocks(nodes).where("name = 'p'"), blank)


def element_of(blank: bool) -> tuple[Column, Column]:
    """Whether a paragraph among blocks is a header, and whether it is an element at all.

    blank: one without text is an element as well, a header where its style is a heading's; only a paragraph that has page breaks and says nothing of its own is left out.
    """
    empty, level = S.is_blank(F.coalesce("text", F.lit(""))), F.col("heading_level").isNotNull()
    listed = F.col("label").isNotNull()
    if not blank:
        return level & ~empty, ~empty | listed
    styled = F.coalesce(F.concat(*(F.array(F.col(f"style.{c}").cast("string")) for c in STYLE if c != "alignment")), F.array().cast("array<string>"))
    said = (F.size(F.array_compact(styled)) > 0) | F.coalesce(F.col("style.alignment") != "START", F.lit(False))
    return level, ~empty | listed | level | said | (F.coalesce("breaks", F.lit(0)) == 0)


def as_paragraphs(rows: DataFrame, blank: bool = False) -> DataFrame:
    """The paragraphs among blocks as heading_or_paragraph has them."""
    text = F.coalesce("text", F.lit(""))
    head, kept = element_of(blank)
    return rows.where(kept).select(
        "doc_id", "part", "ord", "para", "pre", F.when(head, "header").otherwise("paragraph").alias("type"), F.when(head, S.ktrim(text)).otherwise(text).alias("text"),
        F.when(head, F.col("heading_level")).alias("level"), "label", F.col("list.ilvl").alias("list_level"), F.col("list.format").alias("format"), F.when(~head, F.col("spans")).alias("spans"), F.col("style.alignment").alias("alignment"), "style",
    )


def page_breaks(nodes: DataFrame) -> DataFrame:
    """doc_id, part, p, pre: one row per page break and per rendered break of a run."""
    marks = named(nodes, "br", "lastRenderedPageBreak").where((F.col("name") != "br") | (attr("type") == "page"))
    marks = marks.select(*KEY, F.col("pre").alias("at"), F.col("parent").alias("pre"))
    return marks.join(runs(nodes), [*KEY, "pre"]).select(*KEY, "p", F.col("at").alias("pre"))


def hyperlinks(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """doc_id, part, p, address, anchor, tooltip, doc_location, is_external, is_email of each paragraph's first link; the address is null where its id leads nowhere."""
    links = named(nodes, "hyperlink").select(*KEY, F.col("parent").alias("p"), "pre", attr("id").alias("rel_id"), attr("anchor").alias("anchor"), attr("tooltip").alias("tooltip"), attr("docLocation").alias("doc_location"))
    links = first_per(links, [*KEY, "p"], "pre").join(rels.withColumnRenamed("target", "address"), [*KEY, "rel_id"], "left")
    return links.select(*KEY, "p", "address", "anchor", "tooltip", "doc_location", is_external(F.col("address")).alias("is_external"), is_email(F.col("address")).alias("is_email"))


def is_external(address: Column) -> Column:
    return F.coalesce(address.rlike(r"\S"), F.lit(False))


def is_email(address: Column) -> Column:
    return F.coalesce(S.starts_ignoring_case(address, "mailto:"), F.lit(False))


# tables


def tables(nodes: DataFrame) -> DataFrame:
    """Body tables with tbl, their number from 0."""
    found = body_elements(nodes).where("name = 'tbl'")
    return found.withColumn("tbl", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")) - 1)


TABLE = f"{BODY}/tbl"
SIDES = ["top", "right", "bottom", "left"]
#: Places (packages.shred) that table_metadata, table_rows and cells read; cells also reads those of table_rows for its texts.
METADATA_PLACES = f"{TABLE}(/tr|/tr(/.+)?/tblHeader|/tblPr/(tblStyle|tblCaption|tblDescription|shd)|/[^/]+/(tblBorders|tblCellMar)/({'|'.join(SIDES)}))?"
ROW_PLACES = f"{TABLE}(/tr(/tc(/p(/pPr/numPr/(numId|ilvl)|(/({'|'.join(LINKS)}))?/r/(t(/#text)?|tab|br|cr))?)?)?)?"
CELL_PLACES = f"{TABLE}(/tr(/tc(/tbl|/tcPr/(gridSpan|hMerge|vMerge|shd|(tcBorders|tcMar)/({'|'.join(SIDES)})))?)?)?"


def _cells(nodes: DataFrame, texts: bool = True, properties: bool = True, numbering: DataFrame | None = None) -> DataFrame:
    """doc_id, tbl, tr, tc (their pres) and of each cell of a body table line (its text), grid_span, h_merge, v_merge, shading, borders, margins, nested. A table and a row have a line of their own without tc.

    One scan and one exchange, by document: each row knows its table, row, cell and paragraph from its own ancestors.
    """
    path, name, size = F.col("path"), F.col("name"), F.size("anc")
    at = lambda *tails: path.isin([f"{TABLE}/tr/tc{t}" for t in tails])
    runs_ = ["/p/r", *(f"/p/{x}/r" for x in LINKS)]
    is_place = ((name == "tbl") & (path == BODY)) | ((name == "tr") & (path == TABLE)) | ((name == "tc") & (path == f"{TABLE}/tr"))
    in_t, in_r, in_num, is_p = (F.col("kind") == "text") & at(*(f"{r}/t" for r in runs_)), name.isin("tab", "br", "cr") & at(*runs_), name.isin("numId", "ilvl") & at("/p/pPr/numPr"), (name == "p") & at("")
    in_pr, in_box, inner = name.isin("gridSpan", "hMerge", "vMerge", "shd") & at("/tcPr"), name.isin(SIDES) & at("/tcPr/tcBorders", "/tcPr/tcMar"), (name == "tbl") & at("")
    wanted = is_place | ((in_t | in_r | in_num | is_p) if texts else F.lit(False)) | ((in_pr | in_box | inner) if properties else F.lit(False))
    border = F.element_at(steps(), -1) == "tcBorders"
    what = (
        F.when(in_t | in_r, "").when(is_p, "p").when(in_num, name).when(in_box, F.concat(F.when(border, "border:").otherwise("margin:"), name)).when(in_pr, name).when(inner, "nested")
    )
    said = (
        F.when(in_t, F.col("text")).when(in_r, F.when(name == "tab", "\t").when((name == "br") & (F.coalesce(attr("type"), F.lit("")) == "page"), "").otherwise("\n")).when(in_num, attr("val"))
        .when(in_box, F.when(border, attr("color")).otherwise(attr("w"))).when(name == "shd", attr("fill")).when(name.isin("hMerge", "vMerge"), F.coalesce(attr("val"), F.lit("continue"))).when(in_pr, attr("val"))
    )
    up = lambda i: F.coalesce(F.get("anc", F.lit(i)), F.when(size == i, F.col("pre")))  # noqa: E731  the node itself where it is on that step
    rows = nodes.where((F.col("part") == MAIN) & F.coalesce(wanted, F.lit(False))).select("doc_id", up(2).alias("tbl"), up(3).alias("tr"), up(4).alias("tc"), up(5).alias("p"), "pre", what.alias("what"), said.alias("said")).repartition("doc_id")
    is_text = F.col("what").isin("", "p", "numId", "ilvl")
    value = lambda n: F.max(F.when(F.col("what") == n, F.col("said")))
    some = lambda n: F.count_if(F.col("what").startswith(n)) > 0
    grouped = rows.groupBy("doc_id", "tbl", "tr", "tc").agg(
        F.array_sort(F.collect_list(F.when(is_text, F.struct("pre", "p", "what", "said")))).alias("items"), S.to_int(value("gridSpan")).alias("grid_span"), value("hMerge").alias("h_merge"), value("vMerge").alias("v_merge"), value("shd").alias("shading"),
        F.when(some("border:"), S.joined(", ", *(F.concat(F.lit(f"{x}:"), value(f"border:{x}")) for x in ("top", "bottom", "left", "right")))).alias("borders"),
        F.when(some("border:") | some("margin:"), F.struct(*(S.to_int(value(f"margin:{x}")).alias(x) for x in SIDES))).alias("margins"), F.count_if(F.col("what") == "nested").cast("int").alias("nested"),
    )
    if not texts:
        return grouped.withColumn("line", F.lit("")).drop("items")
    # a paragraph's own line in items separates it from the one before; where a cell has lists, its paragraphs are taken apart for their labels
    listed = F.exists("items", lambda x: x["what"] == "numId")
    plain = F.substring(F.array_join(F.transform("items", lambda x: F.when(x["what"] == "p", "\n").otherwise(x["said"])), ""), 2, 1 << 30)
    grouped = grouped.withColumn("listed", listed).join(numbering_levels(nodes if numbering is None else numbering), "doc_id", "left")

    def line(p: Column) -> Column:
        of = lambda n: F.array_max(F.transform(F.filter("items", lambda x: (x["p"] == p) & (x["what"] == n)), lambda x: x["said"]))
        num, own = of("numId"), F.coalesce(S.to_int(of("ilvl")), F.lit(0))
        level = F.get(F.filter("levels", lambda v: (v["num_id"] == num) & (v["ilvl"] == own)), F.lit(0))
        label = F.when(num.isNotNull() & (num != "-1") & level.isNotNull(), F.concat(list_label(level["format"], level["level_text"]), F.lit(" ")))
        return F.concat(F.coalesce(label, F.lit("")), F.array_join(F.transform(F.filter("items", lambda x: (x["p"] == p) & (x["what"] == "")), lambda x: x["said"]), ""))

    apart = F.array_join(F.transform(F.filter("items", lambda x: x["what"] == "p"), lambda x: line(x["p"])), "\n")
    return grouped.withColumn("line", F.when(F.col("listed"), apart).otherwise(plain)).drop("items", "listed", "levels")


def cells(nodes: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, tbl, row, col, text, grid_span, h_merge, v_merge, shading, borders, margins, nested of each cell. A cell's text is its paragraphs', list labels before them, joined by line feeds; without texts it isn't read and blank."""
    keys = ["doc_id", "tbl", "tr", "tc"]
    nth = lambda n: F.dense_rank().over(Window.partitionBy(*keys[:n]).orderBy(keys[n]))  # noqa: E731  a table and a row stand before what they have, so they are the first
    rows = _cells(nodes, texts).withColumn("col", nth(3) - 2).withColumn("row", nth(2) - 2).withColumn("n", nth(1) - 1).where("tc is not null")
    return rows.select("doc_id", F.col("n").alias("tbl"), "row", "col", F.col("line").alias("text"), "grid_span", "h_merge", "v_merge", "shading", "borders", "margins", "nested")


def table_rows(nodes: DataFrame, numbering: DataFrame | None = None) -> DataFrame:
    """doc_id, tbl, rows: each table as an array of arrays of texts, ragged rows as they are. numbering: the nodes of word/numbering.xml, where nodes aren't written and would be made twice."""
    listed = lambda key, value: F.array_sort(F.collect_list(F.when(F.col(key).isNotNull() & F.col(value).isNotNull(), F.struct(key, value))))
    by_row = _cells(nodes, properties=False, numbering=numbering).groupBy("doc_id", "tbl", "tr").agg(listed("tc", "line").alias("own")).withColumn("own", F.when(F.size("own") > 0, F.transform("own", lambda s: s["line"])))
    whole = by_row.groupBy("doc_id", "tbl").agg(listed("tr", "own").alias("rows")).withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("tbl")) - 1)
    return whole.where(F.size("rows") > 0).select("doc_id", F.col("n").alias("tbl"), F.transform("rows", lambda s: s["own"]).alias("rows"))


def table_metadata(nodes: DataFrame) -> DataFrame:
    """doc_id, tbl, has_header, style, caption, description, shading, borders (of the sides that have a colour), margins of each body table. One scan; rows are put together before they are dealt out."""
    path, name = F.col("path"), F.col("name")
    is_tbl, is_tr, is_mark = (name == "tbl") & (path == BODY), (name == "tr") & (path == TABLE), (name == "tblHeader") & ((path == f"{TABLE}/tr") | path.startswith(f"{TABLE}/tr/"))
    in_pr, box = name.isin("tblStyle", "tblCaption", "tblDescription", "shd") & (path == f"{TABLE}/tblPr"), F.when((F.size(steps()) == 5) & path.startswith(f"{TABLE}/"), F.element_at(steps(), -1))
    border, margin = name.isin(SIDES) & (box == "tblBorders"), name.isin(SIDES) & (box == "tblCellMar")
    what = F.when(is_tbl, "tbl").when(is_tr, "tr").when(is_mark, "mark").when(in_pr, name).when(border, F.concat(F.lit("border:"), name)).when(margin, F.concat(F.lit("margin:"), name))
    said = F.when(in_pr, F.when(name == "shd", attr("fill")).otherwise(attr("val"))).when(border, attr("color")).when(margin, attr("w"))
    here = F.when(is_tr, F.col("pre")).when(is_mark, F.get("anc", F.lit(3)))
    own = nodes.where((F.col("part") == MAIN) & what.isNotNull()).select("doc_id", F.coalesce(F.get("anc", F.lit(2)), "pre").alias("table"), what.alias("what"), said.alias("said"), here.alias("here"))
    value = lambda n: F.max(F.when(F.col("what") == n, F.col("said")))
    first = lambda n: F.min(F.when(F.col("what") == n, F.col("here")))
    some = lambda n: F.count_if(F.col("what").startswith(n)) > 0
    rows = own.groupBy("doc_id", "table").agg(
        F.coalesce(first("tr") == first("mark"), F.lit(False)).alias("has_header"), value("tblStyle").alias("style"), value("tblCaption").alias("caption"), value("tblDescription").alias("description"), value("shd").alias("shading"),
        F.when(some("border:"), S.joined(", ", *(F.concat(F.lit(f"{x}:"), value(f"border:{x}")) for x in ("top", "bottom", "left", "right")))).alias("borders"),
        F.when(some("margin:"), F.struct(*(S.to_int(value(f"margin:{x}")).alias(x) for x in SIDES))).alias("margins"),
    )
    return rows.withColumn("tbl", F.row_number().over(Window.partitionBy("doc_id").orderBy("table")) - 1).select("doc_id", "tbl", "has_header", "style", "caption", "description", "shading", "borders", "margins")
