"""Fields, notes, comments, bookmarks, revisions, properties and counters of word-processing packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions import strings as S
from docflow.operators import body as B
from docflow.operators.tree import KEY, attr, below, enclosing, first_per, in_order, named, steps, subtree_text

#: Ordered: the first prefix that fits names the class. Fixed values.
FIELDS = [
    ("TOC", "toc"), ("PAGE", "page-number"), ("DATE", "date-time"), ("TIME", "date-time"), ("AUTHOR", "author"), ("TITLE", "title"), ("MERGEFIELD", "merge-field"), ("FORMULA", "formula"), ("=", "formula"),
    ("HYPERLINK", "hyperlink"), ("IF ", "conditional"), ("SET", "variable-set"), ("REF", "variable-ref"), ("SEQ", "sequence"), ("ASK", "prompt-ask"), ("FILLIN", "prompt-fillin"), ("MACROBUTTON", "macro-button"), ("FORMTEXT", "form-text"),
    ("FORMCHECKBOX", "form-checkbox"), ("FORMDROPDOWN", "form-dropdown"), ("STYLEREF", "style-reference"), ("XE ", "index-entry"), ("TC ", "table-of-contents-entry"),
]
REFERENCES = [
    ("REF ", "cross-reference"), ("PAGEREF ", "page-reference"), ("NOTEREF ", "note-reference"), ("SEQ ", "caption-sequence"), ("CITATION ", "citation"), ("BIBLIOGRAPHY", "bibliography"), ("HYPERLINK ", "hyperlink-field"),
    ("IF ", "conditional-field"), ("MERGEFIELD ", "merge-field"), ("TOC", "table-of-contents"), ("PAGE", "page-number"),
]
REVISIONS = ["ins", "del", "moveFrom", "moveTo", "pPrChange", "rPrChange"]
CORE = ["title", "subject", "creator", "keywords", "description", "lastModifiedBy", "revision", "created", "modified"]
EXTENDED = ["Pages", "Words", "Characters", "Lines", "Paragraphs", "Company", "Template", "TotalTime"]


def _by_prefix(text: Column, rules: list[tuple[str, str]], other: Column) -> Column:
    upper, out = F.upper(S.ktrim(text)), other
    for prefix, name in reversed(rules):
        out = F.when(upper.startswith(prefix), name).otherwise(out)
    return out


def classify_field(instruction: Column) -> Column:
    return _by_prefix(instruction, FIELDS, F.lit("field"))


def classify_reference(instruction: Column) -> Column:
    """The class of a cross-reference, or null for other instructions."""
    return _by_prefix(instruction, REFERENCES, F.lit(None).cast("string"))


def field_arguments(instruction: Column) -> Column:
    """What a field's command says about itself, as map<string,string>; blank values are left out."""
    upper, rest = F.upper(S.ktrim(instruction)), S.drop_words(instruction, 1)
    second = S.nth_word(instruction, 1)
    pair = lambda k, v: F.create_map(F.lit(k), v)
    ways = [
        ("HYPERLINK", pair("target", S.unquoted(S.ktrim(S.after_first(instruction, "HYPERLINK"))))), ("MERGEFIELD", pair("fieldName", second)), ("IF ", pair("condition", rest)), ("TOC", pair("switches", rest)),
        ("PAGE", pair("pageField", S.ktrim(instruction))), ("NUMPAGES", pair("pageField", S.ktrim(instruction))), ("DATE", pair("property", S.nth_word(instruction, 0))), ("TIME", pair("property", S.nth_word(instruction, 0))),
        ("AUTHOR", pair("property", S.nth_word(instruction, 0))), ("TITLE", pair("property", S.nth_word(instruction, 0))), ("=", pair("expression", S.ktrim(S.after_first(instruction, "=")))), ("FORMULA", pair("expression", rest)),
        ("SET", F.create_map(F.lit("bookmark"), second, F.lit("value"), S.drop_words(instruction, 2))), ("REF", pair("bookmark", second)), ("SEQ", pair("sequenceIdentifier", second)),
        ("MACROBUTTON", F.create_map(F.lit("macroName"), second, F.lit("displayText"), S.drop_words(instruction, 2))), ("FORM", pair("formType", S.nth_word(instruction, 0))), ("STYLEREF", pair("styleName", rest)),
    ]
    out = F.create_map().cast("map<string,string>")
    for prefix, value in reversed(ways):
        out = F.when(upper.startswith(prefix), value).otherwise(out)
    return S.non_blank_values(out)


def bookmarks(nodes: DataFrame) -> DataFrame:
    """doc_id, part, p, ordinal, boundary, id, name: a paragraph's starts, then its ends, which have no name."""
    marks = named(nodes, "bookmarkStart", "bookmarkEnd").select(*KEY, F.col("parent").alias("p"), "pre", F.when(F.col("name") == "bookmarkStart", "start").otherwise("end").alias("boundary"), attr("id").alias("id"), attr("name").alias("mark"))
    marks = marks.join(named(nodes, "p").select(*KEY, F.col("pre").alias("p")), [*KEY, "p"], "left_semi")
    order = Window.partitionBy(*KEY, "p").orderBy(F.desc("boundary"), "pre")
    return marks.select(*KEY, "p", (F.row_number().over(order) - 1).alias("ordinal"), "boundary", "id", F.when(F.col("boundary") == "start", F.coalesce("mark", F.lit(""))).otherwise("").alias("name"))


def simple_fields(nodes: DataFrame) -> DataFrame:
    """doc_id, part, p, pre, instruction, value (the field's own data) of fields in one element."""
    own = named(nodes, "fldSimple").select(*KEY, F.col("parent").alias("p"), "pre", S.ktrim(F.coalesce(attr("instr"), F.lit(""))).alias("instruction"))
    data = named(nodes, "fldData").select(*KEY, F.col("pre").alias("at"), F.col("parent").alias("pre"))
    texts = nodes.where("kind = 'text'").select(*KEY, F.col("parent").alias("at"), "text")
    data = data.join(texts, [*KEY, "at"]).groupBy(*KEY, "pre").agg(F.min_by("text", "at").alias("value"))
    return own.join(named(nodes, "p").select(*KEY, F.col("pre").alias("p")), [*KEY, "p"], "left_semi").join(data, [*KEY, "pre"], "left")


def complex_fields(nodes: DataFrame) -> DataFrame:
    """doc_id, part, p, pre, instruction, value (the paragraph's text) of fields spread over runs.

    Instruction texts between a begin and an end, in any case of letters, are one field's; a
    begin within a field starts anew; texts outside stand alone, each by itself. A run's begin
    acts before its texts, its end after them. Blank texts and instructions are dropped.
    """
    mark = F.lower(attr("fldCharType"))
    marks = named(nodes, "fldChar").groupBy(*KEY, F.col("parent").alias("pre")).agg(F.bool_or(mark == "begin").alias("begin"), F.bool_or(mark == "end").alias("end"))
    texts = nodes.where("kind = 'text'").select(*KEY, F.col("parent").alias("at"), "text")
    instr = named(nodes, "instrText").select(*KEY, F.col("pre").alias("at"), F.col("parent").alias("pre")).join(texts, [*KEY, "at"]).where(S.non_blank(F.col("text")).isNotNull())
    instr = instr.groupBy(*KEY, "pre").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]).alias("texts"))
    rows = B.runs(nodes).join(marks, [*KEY, "pre"], "left").join(instr, [*KEY, "pre"], "left").where("begin is not null or texts is not null")
    rows = rows.withColumns({"begin": F.coalesce("begin", F.lit(False)), "end": F.coalesce("end", F.lit(False))})
    order = Window.partitionBy(*KEY, "p").orderBy("pre")
    so_far, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    marker = F.when(F.col("end"), False).when(F.col("begin"), True)
    rows = rows.withColumns({"segment": F.sum(F.col("begin").cast("int")).over(so_far) + F.coalesce(F.sum(F.col("end").cast("int")).over(earlier), F.lit(0)), "open": F.last(marker, ignorenulls=True).over(earlier)})
    rows = rows.withColumn("inside", F.col("begin") | F.coalesce("open", F.lit(False))).where("texts is not null")
    rows = rows.select(*KEY, "p", "pre", "segment", "inside", F.posexplode(F.when(F.col("inside"), F.array(F.array_join("texts", ""))).otherwise(F.col("texts"))).alias("nth", "text"))
    alone = F.when(~F.col("inside"), F.struct("pre", "nth"))
    joined = rows.groupBy(*KEY, "p", "segment", alone.alias("alone")).agg(F.min("pre").alias("first"), F.min("nth").alias("nth"), in_order("text", "pre").alias("text"))
    joined = joined.select(*KEY, "p", F.col("first").alias("pre"), "nth", S.ktrim(F.col("text")).alias("instruction")).where(S.non_blank(F.col("instruction")).isNotNull())
    values = B.paragraph_spans(nodes).select(*KEY, "p", F.col("text").alias("value"))
    return joined.join(values, [*KEY, "p"], "left")


def fields(nodes: DataFrame) -> DataFrame:
    """doc_id, part, p, ordinal, type, instruction, value, arguments, is_simple, source: a paragraph's simple fields, then its complex ones, of equal ones the first."""
    both = simple_fields(nodes).withColumns({"is_simple": F.lit(True), "nth": F.lit(0)}).unionByName(complex_fields(nodes).withColumn("is_simple", F.lit(False)))
    both = both.withColumns({"type": classify_field(F.col("instruction")), "arguments": field_arguments(F.col("instruction")), "source": F.when(F.col("is_simple"), "fldSimple").otherwise("instrText")})
    both = both.withColumn("ordinal", F.row_number().over(Window.partitionBy(*KEY, "p").orderBy(F.desc("is_simple"), "pre", "nth")) - 1)
    return first_per(both.drop("nth"), [*KEY, "p", "type", "instruction", "source"], "ordinal")


def notes(nodes: DataFrame) -> DataFrame:
    """doc_id, kind, pre, id, text of footnotes and endnotes; the ids -1, 0 and 1 are left out, even a genuine note of that id."""
    own = named(nodes, "footnote", "endnote").where(F.col("part").isin("word/footnotes.xml", "word/endnotes.xml"))
    own = own.select(*KEY, "pre", F.col("name").alias("kind"), S.to_int(attr("id")).alias("id")).where("id not in (-1, 0, 1)")
    return own.join(paragraph_texts(nodes), [*KEY, "pre"], "left").select("doc_id", "kind", "pre", "id", F.coalesce("text", F.lit("")).alias("text"))


def paragraph_texts(nodes: DataFrame) -> DataFrame:
    """doc_id, part, pre, text: for each parent of paragraphs, their texts joined by line feeds."""
    paras = named(nodes, "p").select(*KEY, F.col("pre").alias("p"), F.col("parent").alias("pre"))
    rows = paras.join(B.paragraph_spans(nodes).select(*KEY, "p", "text"), [*KEY, "p"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.groupBy(*KEY, "pre").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "text"))), lambda s: s["text"]), "\n").alias("text"))


def comments(nodes: DataFrame) -> DataFrame:
    """doc_id, pre, id, author, initials, date (ISO instant), text."""
    own = named(nodes, "comment", part="word/comments.xml").select(*KEY, "pre", attr("id").alias("id"), attr("author").alias("author"), attr("initials").alias("initials"), S.iso_instant(F.try_to_timestamp(attr("date"))).alias("date"))
    return own.join(paragraph_texts(nodes), [*KEY, "pre"], "left").select("doc_id", "pre", "id", "author", "initials", "date", F.coalesce("text", F.lit("")).alias("text"))


def revisions(nodes: DataFrame) -> DataFrame:
    """doc_id, tag, ordinal, reviewer, timestamp, id, comment of tracked changes, numbered by tag in document order; blanks are null."""
    own = named(nodes, *REVISIONS, part=B.MAIN).select(*KEY, "pre", F.col("name").alias("tag"), S.non_blank(attr("author")).alias("reviewer"), attr("date").alias("timestamp"), S.non_blank(attr("id")).alias("id"))
    refs = below(nodes, "commentReference", of=REVISIONS).groupBy(*KEY, F.col("head").alias("pre")).agg(F.min_by(attr("id"), "pre").alias("comment"))
    rows = own.join(refs, [*KEY, "pre"], "left")
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id", "tag").orderBy("pre")))


def references(nodes: DataFrame) -> DataFrame:
    """doc_id, ordinal, kind, summary, total: cross-references of the main part; total counts them before equal ones are dropped."""
    texts = nodes.where("kind = 'text'").select(*KEY, F.col("parent").alias("pre"), F.col("text").alias("instr"))
    simple = named(nodes, "fldSimple", part=B.MAIN).select("doc_id", F.lit(0).alias("way"), "pre", S.ktrim(attr("instr")).alias("summary"))
    instr = named(nodes, "instrText", part=B.MAIN).join(texts, [*KEY, "pre"]).select("doc_id", F.lit(3).alias("way"), "pre", S.ktrim(F.col("instr")).alias("summary"))
    found = simple.unionByName(instr).withColumn("kind", classify_reference(F.col("summary"))).where("kind is not null")
    marks = named(nodes, "footnoteReference", "endnoteReference", part=B.MAIN)
    way = F.when(F.col("name") == "footnoteReference", 1).otherwise(2)
    found = found.unionByName(marks.select("doc_id", way.alias("way"), "pre", F.coalesce(attr("id"), F.lit("")).alias("summary"), F.regexp_replace("name", "Reference$", "").alias("kind")))
    found = found.withColumn("total", F.count("*").over(Window.partitionBy("doc_id"))).withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("way", "pre")))
    return first_per(found, ["doc_id", "kind", "summary"], "ordinal")


def _paragraph_events(nodes: DataFrame) -> DataFrame:
    """doc_id, p, broken, ends, start, title: each paragraph of the main part with a page break in it or a section's end, and one of p -1 for each document."""
    way = lambda n: F.get(steps(), F.size("anc") - n)
    rows = named(nodes, part=B.MAIN).where((F.col("pre") == 0) | F.col("name").isin("br", "lastRenderedPageBreak", "sectPr", "pgNumType", "titlePg"))
    breaks = (F.col("name") == "lastRenderedPageBreak") | ((F.col("name") == "br") & (attr("type") == "page"))
    ends = (F.col("name") == "sectPr") & (way(1) == "pPr") & (way(2) == "p")
    says = F.col("name").isin("pgNumType", "titlePg") & (way(1) == "sectPr") & (way(2) == "pPr") & (way(3) == "p")
    of = F.when(F.col("pre") == 0, F.array(F.lit(-1))).when(breaks, enclosing("p")).when(ends, F.array(F.get("anc", F.size("anc") - 2))).when(says, F.array(F.get("anc", F.size("anc") - 3)))
    rows = rows.select("doc_id", "pre", "name", "attrs", F.coalesce(breaks, F.lit(False)).alias("breaks"), F.coalesce(ends, F.lit(False)).alias("ends"), F.explode(of).alias("p"))
    return rows.groupBy("doc_id", "p").agg(
        F.bool_or("breaks").alias("broken"), F.bool_or("ends").alias("ends"), F.min_by(attr("start"), F.when(F.col("name") == "pgNumType", F.col("pre"))).alias("start"), F.bool_or(F.col("name") == "titlePg").alias("title")
    )


def page_layout(nodes: DataFrame) -> DataFrame:
    """doc_id, pages: one, and one more for each paragraph with a break, however many it has."""
    return _paragraph_events(nodes).groupBy("doc_id").agg((F.count_if("broken") + 1).alias("pages"))


def page_rows(nodes: DataFrame) -> DataFrame:
    """doc_id, ordinal (from 1), kind, title, summary, attributes: the pages that breaks begin and the sections that paragraphs end, in reading order; a paragraph's page comes before its section."""
    so_far = Window.partitionBy("doc_id").orderBy("p")
    rows = _paragraph_events(nodes).withColumns({"page": (F.sum(F.col("broken").cast("int")).over(so_far) + 1).cast("string"), "section": F.sum(F.col("ends").cast("int")).over(so_far)})
    number = F.col("section").cast("string")
    entry = lambda kind, title, summary, attributes: F.struct(F.lit(kind).alias("kind"), title.alias("title"), summary.alias("summary"), attributes.alias("attributes"))
    begun = F.when(F.col("p") < 0, "start").otherwise("explicit page break")
    page = F.when((F.col("p") < 0) | F.col("broken"), entry("page", F.concat(F.lit("Page "), "page"), begun, F.create_map(F.lit("pageIndex"), F.col("page"))))
    summary = F.concat_ws(", ", F.lit("sectionBoundary=true"), F.concat(F.lit("pageNumberStart="), "start"), F.when(F.col("title"), "differentFirstPage=true"))
    said = F.map_filter(F.create_map(F.lit("sectionIndex"), number, F.lit("pageNumberStart"), F.col("start"), F.lit("differentFirstPage"), F.when(F.col("title"), "true")), lambda _, v: v.isNotNull())
    section = F.when(F.col("ends"), entry("page-section", F.concat(F.lit("Section "), (F.col("section") + 1).cast("string")), summary, said))
    both = rows.select("doc_id", "p", F.posexplode(F.array_compact(F.array(page, section))).alias("nth", "e"))
    return both.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("p", "nth")).alias("ordinal"), "e.*")


def markup_counts(nodes: DataFrame) -> DataFrame:
    """One pass over the main part for the counters of borders, shading, complex scripts and placeholders."""
    count = lambda name, cond=None: F.count_if((F.col("name") == name) & (cond if cond is not None else F.lit(True)))
    cs = S.non_blank(F.coalesce(attr("cs"), attr("csTheme"))).isNotNull()
    return nodes.where((F.col("part") == B.MAIN) & (F.col("kind") == "elem")).groupBy("doc_id").agg(
        count("pgBorders").alias("page_borders"), count("pBdr").alias("paragraph_borders"), count("tcBorders").alias("cell_borders"), count("shd").alias("shading"), count("rtl").alias("rtl"),
        count("rFonts", cs).alias("cs_fonts"), count("bidiVisual").alias("bidi_tables"), count("showingPlcHdr").alias("placeholders"),
    )


def borders_shading(nodes: DataFrame) -> DataFrame:
    return markup_counts(nodes).where("page_borders + paragraph_borders + cell_borders + shading > 0").select("doc_id", "page_borders", "paragraph_borders", "cell_borders", "shading")


def complex_script(nodes: DataFrame) -> DataFrame:
    return markup_counts(nodes).where("rtl + cs_fonts + bidi_tables > 0").select("doc_id", "rtl", "cs_fonts", "bidi_tables")


def placeholders(nodes: DataFrame) -> DataFrame:
    return markup_counts(nodes).where("placeholders > 0").select("doc_id", "placeholders")


def _properties(nodes: DataFrame, part: str, names: list[str]) -> DataFrame:
    """doc_id and a map of a part's elements of those names to their texts, without blanks."""
    heads = named(nodes, *names, part=part)
    values = subtree_text(heads.select(*KEY, "pre", "name"), nodes, *names, part=part)
    found = values.groupBy("doc_id", "name").agg(F.min_by("value", "pre").alias("value")).where(S.non_blank(F.col("value")).isNotNull())
    return found.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("attributes"))


def core_properties(nodes: DataFrame) -> DataFrame:
    """doc_id, attributes, summary of documents with core properties; the creator is the author."""
    rows = _properties(nodes, "docProps/core.xml", CORE)
    renamed = F.transform_keys("attributes", lambda k, _: F.when(k == "creator", "author").otherwise(k))
    rows = rows.withColumn("attributes", renamed)
    a = lambda name: F.col("attributes")[name]
    return rows.withColumn("summary", S.joined(", ", a("title"), a("author"), a("lastModifiedBy"), a("revision"), fallback=F.lit("Core properties")))


def extended_properties(nodes: DataFrame) -> DataFrame:
    rows = _properties(nodes, "docProps/app.xml", EXTENDED)
    rows = rows.withColumn("attributes", F.transform_keys("attributes", lambda k, _: S.lower_first(k)))
    a = lambda name: F.concat(F.lit(f"{name}="), F.col("attributes")[name])
    return rows.withColumn("summary", S.joined(", ", a("pages"), a("words"), a("characters"), a("company"), fallback=F.lit("Extended properties")))


def custom_properties(nodes: DataFrame) -> DataFrame:
    """doc_id, ordinal, name, value, summary: each custom property, and how many the document has."""
    heads = named(nodes, "property", part="docProps/custom.xml").withColumn("title", attr("name"))
    rows = subtree_text(heads.select(*KEY, "pre", "title"), nodes, "property", part="docProps/custom.xml")
    w = Window.partitionBy("doc_id")
    return rows.select("doc_id", F.row_number().over(w.orderBy("pre")).alias("ordinal"), F.col("title").alias("name"), "value", F.concat(F.count("*").over(w), F.lit(" custom properties")).alias("summary"))


def citations(nodes: DataFrame) -> DataFrame:
    """doc_id, ordinal, title, tag, year of bibliography sources; a title is the tag, else the title, else Citation and the number."""
    heads = named(nodes, "Source", part="word/bibliography.xml").select(*KEY, "pre")
    fields_ = named(nodes, "Tag", "Title", "Year", part="word/bibliography.xml")
    values = subtree_text(fields_.select(*KEY, "pre", "name", F.col("parent").alias("source")), nodes, "Tag", "Title", "Year", part="word/bibliography.xml")
    value = lambda name: S.non_blank(F.max(F.when(F.col("name") == name, F.col("value"))))
    rows = values.groupBy(*KEY, F.col("source").alias("pre")).agg(value("Tag").alias("tag"), value("Title").alias("named"), value("Year").alias("year"))
    rows = heads.join(rows, [*KEY, "pre"], "left").withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")))
    return rows.select("doc_id", "ordinal", F.coalesce("tag", "named", F.concat(F.lit("Citation "), "ordinal")).alias("title"), "tag", "year")


def captions(nodes: DataFrame) -> DataFrame:
    """doc_id, ordinal, kind, text: paragraphs whose instruction texts number a figure or a table; figures come first in doubt."""
    texts = nodes.where((F.col("kind") == "text") & (F.col("part") == B.MAIN)).select(*KEY, F.col("pre").alias("at"), "text", F.element_at(steps(), -1).alias("name"), F.explode(enclosing("p")).alias("pre"))
    rows = texts.where(F.col("name").isin("instrText", "t"))
    listed = lambda name, sep: F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.when(F.col("name") == name, F.struct("at", "text"))), lambda s: s.isNotNull())), lambda s: s["text"]), sep)
    grouped = rows.groupBy(*KEY, "pre").agg(listed("instrText", " ").alias("instr"), S.ktrim(listed("t", "")).alias("text"))
    kind = F.when(F.col("instr").contains("SEQ Figure"), "figure-caption").when(F.col("instr").contains("SEQ Table"), "table-caption")
    found = grouped.withColumn("kind", kind).where("kind is not null")
    return found.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")).alias("ordinal"), "kind", "text")
