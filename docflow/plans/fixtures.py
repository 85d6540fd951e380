"""Packages derived from the driver's tables, so that plain SQL on those tables is an independent oracle.

Each fixture is a table of parts (doc_id, entry_seq, part, content). nodes_of() shreds one
and keeps the result for the session, so that the queries share it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions.strings import escaped
from docflow.sources import packages as P

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_kept: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    """table(), dealt out by key to four tasks a core: packages of many nodes are made of small rows, so a file that one task reads would keep one core busy."""
    return table(spark, sf, name).repartition(max(4 * spark.sparkContext.defaultParallelism, 16), key)


def kept(spark: SparkSession, sf: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of that name over sf, made and written once a session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _kept:
        _kept[key] = P.stored(make())
    return _kept[key]


_folders: dict[tuple, str] = {}


def folder(spark: SparkSession, sf: str, name: str, make: Callable[[str], None]) -> str:
    """A folder that make(path) fills, once a session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _folders:
        path = P.new_folder(spark, name)
        make(path)
        _folders[key] = path
    return _folders[key]


def aggregated(rows: DataFrame, doc: Column, order: str, xml: Column, part: str, head: str, tail: str, seq: int = 0) -> DataFrame:
    """One part a document: the rows' XML in that order between head and tail."""
    rows = rows.select(doc.cast("string").alias("doc_id"), F.col(order).alias("at"), xml.alias("xml"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "xml"))), lambda s: s["xml"]), "")
    grouped = rows.groupBy("doc_id").agg(body.alias("body"))
    return grouped.select("doc_id", F.lit(seq).alias("entry_seq"), F.lit(part).alias("part"), F.concat(F.lit(head), "body", F.lit(tail)).alias("content"))


def entry(seq: int, part: str, content: Column, when: Column | None = None) -> Column:
    """A part as a struct, or null where the condition doesn't hold."""
    made = F.struct(F.lit(seq).alias("entry_seq"), F.lit(part).alias("part"), content.alias("content"))
    return made if when is None else F.when(when, made)


def parted(rows: DataFrame, doc: Column, *entries: Column) -> DataFrame:
    """The entries of each row as parts, in one pass over the rows."""
    parts = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return rows.select(doc.cast("string").alias("doc_id"), F.explode(parts).alias("e")).select("doc_id", "e.*")


def case(n: Column, *ways: tuple[int, str], other: str = "") -> Column:
    out = F.lit(other)
    for k, v in reversed(ways):
        out = F.when(n == k, v).otherwise(out)
    return out


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, k, line of each document's lines."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))


NUMBERING = f"""<w:numbering {W}><w:abstractNum w:abstractNumId="10"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="bullet"/><w:lvlText w:val="o"/><w:rPr><w:rFonts w:ascii="Symbol"/></w:rPr></w:lvl></w:abstractNum><w:abstractNum w:abstractNumId="20"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/><w:lvlText w:val="%1"/></w:lvl></w:abstractNum><w:abstractNum w:abstractNumId="30"><w:lvl w:ilvl="0"><w:numFmt w:val="lowerRoman"/><w:lvlText w:val="%1)"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="10"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="20"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride></w:num><w:num w:numId="3"><w:abstractNumId w:val="30"/></w:num></w:numbering>"""


def fx_body(spark: SparkSession, sf: str) -> DataFrame:
    """A paragraph for each line of each document, with styles, lists, runs and breaks by the line's number."""
    k, line = F.col("k"), F.col("line")
    style = F.when(k == 0, '<w:pStyle w:val="Heading1"/>').when(k % 10 == 5, '<w:pStyle w:val="Heading2"/>').otherwise("")
    number = case(k % 7, (3, '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>'), (4, '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="2"/></w:numPr>'), (6, '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="3"/></w:numPr>'))
    jc = case(k % 4, (0, "left"), (1, "center"), (2, "right"), other="both")
    ppr = F.concat(F.lit("<w:pPr>"), style, number, F.lit('<w:ind w:left="'), (k * 10).cast("string"), F.lit('" w:right="0"/><w:jc w:val="'), jc, F.lit('"/></w:pPr>'))
    first = F.substring_index(line, " ", 1)
    rest = F.when(line.contains(" "), F.substring(line, F.length(first) + 2, F.length(line)))
    second, third = F.substring_index(rest, " ", 1), F.when(rest.contains(" "), F.substring(rest, F.length(F.substring_index(rest, " ", 1)) + 2, F.length(rest)))
    extra = F.concat(F.when(k % 9 == 8, '<w:vertAlign w:val="superscript"/>').otherwise(""), F.when(k % 11 == 10, '<w:rFonts w:cs="Arial"/><w:rtl/>').otherwise(""))

    def run(text: Column, props: str) -> Column:
        return F.when(text.isNotNull() & (text != ""), F.concat(F.lit("<w:r><w:rPr>"), F.lit(props), extra, F.lit('</w:rPr><w:t xml:space="preserve">'), escaped(text), F.lit("</w:t></w:r>"))).otherwise("")

    breaks = F.when(k % 40 == 39, '<w:r><w:br w:type="page"/><w:br w:type="page"/></w:r>').when(k % 20 == 19, '<w:r><w:br w:type="page"/></w:r>').otherwise("")
    one = run(F.concat(first, F.when(rest.isNotNull(), " ").otherwise("")), '<w:b/><w:sz w:val="28"/>')
    two = run(F.concat(second, F.when(third.isNotNull(), " ").otherwise("")), '<w:i/><w:color w:val="FF0000"/>')
    xml = F.concat(F.lit("<w:p>"), ppr, one, two, run(third, ""), breaks, F.lit("</w:p>"))
    main = aggregated(lines(spark, sf), F.col("doc_id"), "k", xml, "word/document.xml", f"<w:document {W}><w:body>", '<w:sectPr><w:pgSz w:w="11906" w:h="16838"/></w:sectPr></w:body></w:document>')
    main = main.withColumn("content", F.when(F.col("doc_id").cast("long") % 97 == 0, F.left("content", F.lit(60))).otherwise(F.col("content")))
    return parted(main, F.col("doc_id"), entry(0, "word/document.xml", F.col("content")), entry(1, "word/numbering.xml", F.lit(NUMBERING)))


def fx_files(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, path, filename, format, mime, content of the packages of fx_body: the form in which read_corpus gives files."""
    files = P.packed(fx_body(spark, sf))
    path = F.concat(F.lit("/corpus/"), "doc_id", F.lit(".docx"))
    return files.select("doc_id", path.alias("path"), F.concat("doc_id", F.lit(".docx")).alias("filename"), F.lit("docx").alias("format"), P.infer_mime(path).alias("mime"), "content")


def fx_all_formats(spark: SparkSession, sf: str) -> DataFrame:
    """path, modificationTime, length, content of a DOCX and an ODT file for each document, and a text file for each tenth; packages of every 97th can't be read."""
    of = lambda df, ext: df.select(F.concat(F.lit("/corpus/"), F.col("doc_id").cast("string"), F.lit(ext)).alias("path"), F.col("content").cast("binary").alias("content"))
    plain = table(spark, sf, "documents").where("doc_id % 10 = 0").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    files = of(P.packed(fx_body(spark, sf)), ".docx").unionByName(of(P.packed(fx_odt(spark, sf)), ".odt")).unionByName(of(plain, ".txt"))
    return files.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.octet_length("content").cast("long").alias("length"), "content")


def fx_table(spark: SparkSession, sf: str) -> DataFrame:
    """A document for each order, a table row for each of its lines."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    n = F.col("l_linenumber")
    cell = lambda text, props="": F.concat(F.lit(f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>"), text, F.lit("</w:t></w:r></w:p>"))
    flag = F.concat(F.lit('<w:tc><w:tcPr><w:vMerge w:val="restart"/><w:tcBorders><w:left w:color="00FF00"/><w:top w:color="'), F.col("l_returnflag"), F.lit('"/><w:right/></w:tcBorders><w:tcMar><w:left w:w="'), n.cast("string"), F.lit('"/></w:tcMar><w:shd w:fill="'), F.col("l_returnflag"), F.lit('"/></w:tcPr><w:p><w:r><w:t>'), F.col("l_returnflag"), F.lit("</w:t></w:r></w:p></w:tc>"))
    inner = F.when(n == 1, "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>inner</w:t></w:r></w:p></w:tc></w:tr></w:tbl>").otherwise("")
    xml = F.concat(F.lit("<w:tr>"), cell(n.cast("string"), '<w:gridSpan w:val="2"/>'), F.lit("</w:tc>"), cell(F.col("l_partkey").cast("string")), inner, F.lit("</w:tc>"), flag, cell(F.col("l_linestatus")), F.lit("</w:tc></w:tr>"))
    at = F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")
    head = f'<w:document {W}><w:body><w:tbl><w:tblPr><w:tblStyle w:val="Grid"/><w:tblBorders><w:top w:color="FF0000"/><w:bottom w:color="00FF00"/><w:left/></w:tblBorders><w:tblCellMar><w:left w:w="108"/><w:top w:w="none"/></w:tblCellMar></w:tblPr><w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc><w:p><w:r><w:t>head</w:t></w:r></w:p></w:tc></w:tr>'
    return aggregated(rows.withColumn("at", at), F.col("l_orderkey"), "at", xml, "word/document.xml", head, "</w:tbl></w:body></w:document>")


def fx_conv(spark: SparkSession, sf: str) -> DataFrame:
    """For each conversation: comments of all turns, footnotes of all, endnotes of the assistant's."""
    rows = table(spark, sf, "conversations")
    paras = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit('<w:p><w:r><w:t xml:space="preserve">'), escaped(x), F.lit("</w:t></w:r></w:p>"))), "")
    date = F.concat(F.lit("2024-01-01T00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(":00Z"))
    comment = F.concat(F.lit('<w:comment w:id="'), F.col("turn").cast("string"), F.lit('" w:author="'), F.col("role"), F.lit('" w:initials="'), F.left("role", F.lit(1)), F.lit('" w:date="'), date, F.lit('">'), paras, F.lit("</w:comment>"))
    note = lambda tag: F.concat(F.lit(f'<w:{tag} w:id="'), (F.col("turn") - 1).cast("string"), F.lit('">'), paras, F.lit(f"</w:{tag}>"))
    out = aggregated(rows, F.col("conv_id"), "turn", comment, "word/comments.xml", f"<w:comments {W}>", "</w:comments>", 1)
    out = out.unionByName(aggregated(rows, F.col("conv_id"), "turn", note("footnote"), "word/footnotes.xml", f"<w:footnotes {W}>", "</w:footnotes>", 2))
    return out.unionByName(aggregated(rows.where("role = 'assistant'"), F.col("conv_id"), "turn", note("endnote"), "word/endnotes.xml", f"<w:endnotes {W}>", "</w:endnotes>", 3))


REVISIONS = {"view": "ins", "click": "del", "purchase": "moveFrom", "error": "moveTo", "signup": "rPrChange"}


def fx_rev(spark: SparkSession, sf: str) -> DataFrame:
    """For each user, a revision mark for each of their events."""
    rows = table(spark, sf, "events")
    tag = F.col("event_type")
    for a, b in REVISIONS.items():
        tag = F.when(F.col("event_type") == a, b).otherwise(tag)
    author = F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.concat(F.lit("u"), F.col("user_id")))
    ref = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('<w:commentReference w:id="'), F.col("event_id").cast("string"), F.lit('"/>'))).otherwise("")
    xml = F.concat(F.lit("<w:"), tag, F.lit(' w:id="'), F.col("event_id").cast("string"), F.lit('" w:author="'), author, F.lit('" w:date="'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"><w:r>'), ref, F.lit("<w:t>x</w:t></w:r></w:"), tag, F.lit(">"))
    return aggregated(rows, F.col("user_id"), "event_id", F.concat(F.lit("<w:p>"), xml, F.lit("</w:p>")), "word/document.xml", f"<w:document {W}><w:body>", "</w:body></w:document>")


#: Instruction, its class as a field, its class as a reference (or none).
INSTRUCTIONS = [
    ('TOC \\o "1-3"', "toc", "table-of-contents"), ("PAGE", "page-number", "page-number"), ("DATE \\@ d", "date-time", None), ("TIME", "date-time", None), ("AUTHOR", "author", None), ("TITLE", "title", None),
    ("MERGEFIELD Name", "merge-field", "merge-field"), ("FORMULA a", "formula", None), ("= 1 + 2", "formula", None), ('HYPERLINK "http://a.example"', "hyperlink", "hyperlink-field"), ("IF a = b", "conditional", "conditional-field"),
    ("SET mark value", "variable-set", None), ("REF mark", "variable-ref", "cross-reference"), ("SEQ Figure", "sequence", "caption-sequence"), ("ASK mark", "prompt-ask", None), ("FILLIN x", "prompt-fillin", None), ("MACROBUTTON Run now", "macro-button", None),
    ("FORMTEXT", "form-text", None), ("FORMCHECKBOX", "form-checkbox", None), ("FORMDROPDOWN", "form-dropdown", None), ("STYLEREF Head", "style-reference", None), ("XE entry", "index-entry", None), ("TC entry", "table-of-contents-entry", None), ("page", "page-number", "page-number"),
    ("PAGEREF mark", "page-number", "page-reference"), ("NOTEREF mark", "field", "note-reference"), ("CITATION x", "field", "citation"), ("BIBLIOGRAPHY", "field", "bibliography"),
]


def fx_field(spark: SparkSession, sf: str) -> DataFrame:
    """For each brand, a paragraph with a field for each part: simple for even keys, begin, two instruction runs and end for odd ones."""
    n = F.col("p_partkey") % len(INSTRUCTIONS)
    instr = F.get(F.array(*(F.lit(i[0]) for i in INSTRUCTIONS)), n.cast("int"))
    simple = F.concat(F.lit('<w:fldSimple w:instr=" '), escaped(instr), F.lit(' "><w:r><w:t>v</w:t></w:r></w:fldSimple>'))
    half = F.floor(F.length(instr) / 2).cast("int")
    piece = lambda x: F.concat(F.lit('<w:r><w:instrText xml:space="preserve">'), escaped(x), F.lit("</w:instrText></w:r>"))
    complex_ = F.concat(F.lit('<w:r><w:fldChar w:fldCharType="begin"/></w:r>'), piece(F.left(instr, half)), piece(F.substring(instr, half + 1, F.length(instr))), F.lit('<w:r><w:fldChar w:fldCharType="end"/></w:r>'))
    one = F.when(F.col("p_partkey") % 2 == 0, simple).otherwise(complex_)
    body = F.concat(one, F.when(F.col("p_partkey") % 6 == 0, one).otherwise(""))
    mark = F.concat(F.lit('<w:bookmarkStart w:id="'), F.col("p_partkey").cast("string"), F.lit('" w:name="b'), F.col("p_partkey").cast("string"), F.lit('"/>'))
    xml = F.concat(F.lit("<w:p>"), mark, body, F.lit('<w:bookmarkEnd w:id="'), F.col("p_partkey").cast("string"), F.lit('"/></w:p>'))
    return aggregated(table(spark, sf, "part"), F.col("p_brand"), "p_partkey", xml, "word/document.xml", f"<w:document {W}><w:body>", "</w:body></w:document>")


def fx_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Core, extended and custom properties and a bibliography for each customer; none of them where the key ends in 0."""
    rows = spread(spark, sf, "customer", "c_custkey").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).where("c_custkey % 10 <> 0")
    key = F.col("c_custkey")
    core = F.concat(F.lit("<dc:title>"), "c_name", F.lit("</dc:title><dc:creator>"), "n_name", F.lit("</dc:creator><cp:keywords>"), F.when(key % 3 == 0, " ").otherwise("key"), F.lit("</cp:keywords><cp:revision>"), (key % 9).cast("string"), F.lit("</cp:revision>"))
    app = F.concat(F.lit("<Pages>"), (key % 40).cast("string"), F.lit("</Pages><Words>"), key.cast("string"), F.lit("</Words><Company>"), "n_name", F.lit("</Company>"))
    prop = lambda name, value: F.concat(F.lit(f'<property name="{name}"><vt:lpwstr>'), value, F.lit("</vt:lpwstr></property>"))
    custom = F.concat(prop("segment", F.col("c_mktsegment")), prop("nation", F.col("n_name")))
    tag = F.when(key % 8 != 0, F.concat(F.lit("<b:Tag>T"), key.cast("string"), F.lit("</b:Tag>"))).otherwise("")
    title = F.when(key % 12 != 0, F.concat(F.lit("<b:Title>"), "c_name", F.lit("</b:Title>"))).otherwise("")
    source = F.concat(F.lit("<b:Source>"), tag, title, F.lit("<b:Year>20"), F.lpad((key % 100).cast("string"), 2, "0"), F.lit("</b:Year></b:Source>"))

    whole = lambda head, xml, tail: F.concat(F.lit(head), xml, F.lit(tail))
    return parted(
        rows, key, entry(0, "docProps/core.xml", whole('<cp:coreProperties xmlns:cp="cp" xmlns:dc="dc">', core, "</cp:coreProperties>")),
        entry(1, "docProps/app.xml", whole('<Properties xmlns="ep">', app, "</Properties>")), entry(2, "docProps/custom.xml", whole('<Properties xmlns="cu" xmlns:vt="vt">', custom, "</Properties>")),
        entry(3, "word/bibliography.xml", whole('<b:Sources xmlns:b="b">', source, "</b:Sources>"), key % 4 == 0),
    )


def fx_odt(spark: SparkSession, sf: str) -> DataFrame:
    """An ODT content part for each document: a heading, then a paragraph with styled parts for each further line, every fifth in a section; meta.xml; none for every 97th."""
    k, line = F.col("k"), F.col("line")
    first = F.substring_index(line, " ", 1)
    rest = F.substring(line, F.length(first) + 1, F.length(line))
    level = F.when(F.col("doc_id") % 3 == 0, "").otherwise(' text:outline-level="2"')
    head = F.concat(F.lit("<text:h"), level, F.lit(">"), escaped(line), F.lit("</text:h>"))
    para = F.concat(F.lit('<text:p><text:span text:style-name="B">'), escaped(first), F.lit('</text:span><text:s text:c="3"/><text:tab/>'), escaped(rest), F.lit('<text:line-break/><text:a xlink:href="http://a">link</text:a></text:p>'))
    para = F.when(k % 5 == 0, F.concat(F.lit("<text:section>"), para, F.lit("</text:section>"))).otherwise(para)
    xml = F.when(k == 0, head).otherwise(para)
    ns = 'xmlns:office="o" xmlns:text="t" xmlns:style="s" xmlns:fo="f" xmlns:table="tb" xmlns:xlink="x" xmlns:draw="d" xmlns:dc="dc" xmlns:meta="m"'
    styles = '<office:automatic-styles><style:style style:name="B"><style:text-properties fo:font-weight="bold" fo:color="#00FF00" fo:font-size="10.5pt"/></style:style><style:style style:name="I"><style:text-properties fo:font-style="italic" fo:color="red"/></style:style></office:automatic-styles>'
    body = '<table:table><table:table-row><table:table-cell table:number-columns-spanned="2"><text:p>x</text:p></table:table-cell><table:table-cell><text:p>y</text:p></table:table-cell></table:table-row></table:table>'
    rows = lines(spark, sf).where("doc_id % 97 <> 0")
    content = aggregated(rows, F.col("doc_id"), "k", xml, "content.xml", f"<office:document-content {ns}>{styles}<office:body><office:text>", f"{body}</office:text></office:body></office:document-content>")
    docs = table(spark, sf, "documents")
    meta = F.concat(F.lit(f"<office:document-meta {ns}><office:meta><dc:title>T"), F.col("doc_id").cast("string"), F.lit("</dc:title><dc:creator>"), "source", F.lit("</dc:creator></office:meta></office:document-meta>"))
    meta = F.when(F.col("doc_id") % 5 == 0, F.left(meta, F.lit(40))).otherwise(meta)
    extra = docs.where("doc_id % 4 <> 0").select(F.col("doc_id").cast("string"), F.lit(1).alias("entry_seq"), F.lit("meta.xml").alias("part"), meta.alias("content"))
    return content.unionByName(extra)


def fx_media(spark: SparkSession, sf: str) -> DataFrame:
    """An ODT content part with a frame of pictures for each page, and the first picture's bytes for two pages of three."""
    k = F.col("page_id")
    ns = 'xmlns:office="o" xmlns:text="t" xmlns:draw="d" xmlns:xlink="x" xmlns:svg="s"'
    images = F.when(k % 5 == 0, '<draw:image xlink:href=""/>').otherwise('<draw:image xlink:href="Pictures/a.png"/><draw:image xlink:href="Pictures/b.png"/>')
    xml = F.concat(F.lit(f"<office:document-content {ns}><office:body><office:text><text:p>x</text:p><draw:frame>"), images, F.lit("<svg:desc>D"), k.cast("string"), F.lit("</svg:desc></draw:frame></office:text></office:body></office:document-content>"))
    pages = table(spark, sf, "pages")
    row = lambda rows, seq, part, content: rows.select(k.cast("string").alias("doc_id"), F.lit(seq).alias("entry_seq"), F.lit(part).alias("part"), content.alias("content"))
    return row(pages, 0, "content.xml", xml).unionByName(row(pages.where(k % 3 != 0), 1, "Pictures/a.png", F.lit("x"))).unionByName(row(pages, 2, "Pictures/b.png", F.lit("y")))


FIXTURES = {"media": fx_media, "body": fx_body, "table": fx_table, "conv": fx_conv, "rev": fx_rev, "field": fx_field, "meta": fx_meta, "odt": fx_odt}


def parts_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return FIXTURES[name](spark, sf)


def nodes_of(spark: SparkSession, sf: str, name: str, places: str | None = None) -> DataFrame:
    """The nodes of a fixture. places: for a question that reads those at them once; they are made for it alone unless the session has them all."""
    if places and (spark.sparkContext.applicationId, sf, name) not in _kept:
        return P.shred(parts_of(spark, sf, name), places)
    return kept(spark, sf, name, lambda: P.shred(parts_of(spark, sf, name)))


def few_nodes_of(spark: SparkSession, sf: str, name: str, places: str) -> DataFrame:
    """nodes_of() for questions that read the nodes at some places several times: those are written alone unless the session has them all."""
    if (spark.sparkContext.applicationId, sf, name) in _kept:
        return nodes_of(spark, sf, name)
    return kept(spark, sf, f"{name} at {places}", lambda: P.shred(parts_of(spark, sf, name), places))
