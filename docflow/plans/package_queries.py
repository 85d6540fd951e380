"""Queries of package parts beside the text, each with its SQL on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.operators import body as B
from docflow.operators import catalogue as C
from docflow.operators import elements as E
from docflow.operators import package as G
from docflow.operators import sinks as K
from docflow.plans import fixtures as X
from docflow.plans.body_queries import long
from docflow.sources import packages as P


def _row(table: DataFrame, key: str, *parts: tuple) -> DataFrame:
    """One row a part from (name, content[, condition])."""
    return X.parted(table, F.col(key), *(X.entry(i, name, content, *when) for i, (name, content, *when) in enumerate(parts)))


def fx_edge(spark: SparkSession, sf: str) -> DataFrame:
    """Settings and side parts for each supplier, by the bits of its key."""
    k = F.col("s_suppkey")
    bit = lambda n, xml: F.when((F.shiftright(k, n) % 2) == 1, xml).otherwise("")
    body = F.concat(
        bit(0, F.when(k % 3 == 0, "<w:documentProtection/>").otherwise('<w:documentProtection w:edit="readOnly" w:enforcement="0" w:cryptProviderType="rsa"/>')), bit(1, F.lit("<w:writeProtection/>")), bit(2, F.lit("<w:readOnlyRecommended/>")),
        bit(3, F.lit("<w:trackRevisions/>")), bit(4, F.when(k % 5 == 0, '<w:autoHyphenation w:val="true"/>').otherwise("<w:autoHyphenation/>")), bit(5, F.concat(F.lit('<w:hyphenationZone w:val="'), k.cast("string"), F.lit('"/>'))),
        bit(1, F.concat(F.lit('<w:mailMerge><w:mainDocumentType w:val="letters"/><w:dataSource w:val="c:\\d\\f'), k.cast("string"), F.lit('.csv"/></w:mailMerge>'))), F.concat(F.lit('<w:zoom w:percent="'), (k % 200).cast("string"), F.lit('"/>')),
    )
    return _row(
        X.table(spark, sf, "supplier"), "s_suppkey", ("word/settings.xml", F.concat(F.lit(f"<w:settings {X.W}>"), body, F.lit("</w:settings>"))), ("word/vbaProject.bin", F.lit("x"), k % 4 == 0), ("_xmlsignatures/sig1.xml", F.lit("<s/>"), k % 5 == 0),
        ("word/activeX/a.xml", F.lit("<a/>"), k % 6 == 0), ("word/embeddings/e.xml", F.lit("<e/>"), k % 2 == 0), ("word/embeddings/e.bin", F.lit("x"), k % 3 == 0), ("customXml/item1.xml", F.when(k % 7 == 0, "<r><bad>").otherwise('<r xmlns="urn:x"/>')),
        ("word/_rels/document.xml.rels", F.concat(F.lit('<Relationships><Relationship Id="r1" Target="'), X.case(k % 4, (0, "media/x.png"), (1, "../media/x.png"), (2, "/word/media/x.png"), other="./x"), F.lit('"/></Relationships>'))),
        ("word/header1.xml", F.lit(f"<w:hdr {X.W}><w:p><w:r><w:t>Top</w:t></w:r></w:p></w:hdr>")), ("word/header2.xml", F.concat(F.lit(f"<w:hdr {X.W}><w:p><w:r><w:t>"), F.when(k % 2 == 0, "First page").otherwise("Even page"), F.lit("</w:t></w:r></w:p><w:p/></w:hdr>"))),
        ("word/footer1.xml", F.concat(F.lit(f'<w:ftr {X.W}><w:p/><w:tbl/><v id="'), F.when(k % 3 == 0, "PowerPlusWaterMarkObject1").otherwise("plain"), F.lit('"/></w:ftr>'))),
    )


def fx_style(spark: SparkSession, sf: str) -> DataFrame:
    """A style and a font for each part, by brand."""
    k = F.col("p_partkey")
    text = k.cast("string")
    name = F.when(k % 4 != 0, F.concat(F.lit('<w:name w:val="N'), text, F.lit('"/>'))).otherwise("")
    style = F.concat(F.lit('<w:style w:type="paragraph" w:styleId="S'), text, F.lit('"'), F.when(k % 10 == 0, ' w:default="1"').otherwise(""), F.lit(">"), name, F.when(k % 3 == 0, '<w:link w:val="L"/>').otherwise(""), F.lit("</w:style>"))
    font = F.concat(F.lit('<w:font w:name="F'), text, F.lit('">'), F.when(k % 2 == 0, '<w:altName w:val="A"/>').otherwise(""), F.lit('<w:family w:val="roman"/>'), F.when(k % 5 == 0, "<w:embedBold/>").otherwise(""), F.lit("</w:font>"))
    part = X.table(spark, sf, "part")
    out = X.aggregated(part, F.col("p_brand"), "p_partkey", style, "word/styles.xml", f"<w:styles {X.W}>", "</w:styles>")
    return out.unionByName(X.aggregated(part, F.col("p_brand"), "p_partkey", font, "word/fontTable.xml", f"<w:fonts {X.W}>", "</w:fonts>", 1))


def fx_sect(spark: SparkSession, sf: str) -> DataFrame:
    """For each order: a section that ends in a paragraph and the body's, a control, a formula, alternate content, drawings."""
    k = F.col("o_orderkey")
    text = k.cast("string")
    size = F.when(k % 5 == 0, "wide").otherwise(F.concat(F.lit("1"), (k % 1000).cast("string")))
    first = F.concat(F.lit('<w:p><w:pPr><w:sectPr><w:type w:val="continuous"/><w:pgSz w:w="'), size, F.lit('" w:h="500"/></w:sectPr></w:pPr><w:r><w:t>a</w:t></w:r></w:p>'))
    control = X.case(k % 4, (0, "<w:text/>"), (1, '<w:dropDownList><w:listItem w:value="1"/><w:listItem w:value="2"/></w:dropDownList>'), (2, "<w:date/>"))
    sdt = F.concat(F.lit("<w:sdt><w:sdtPr>"), F.when(k % 3 == 0, F.concat(F.lit('<w:alias w:val="A'), text, F.lit('"/>'))).otherwise(""), F.lit('<w:id w:val="'), text, F.lit('"/>'), control, F.when(k % 2 == 0, "<w:showingPlcHdr/>").otherwise(""), F.lit("</w:sdtPr></w:sdt>"))
    math = F.concat(F.lit("<w:p><m:oMath>"), F.when(k % 2 == 0, "<m:f/><m:f/>").otherwise(""), F.lit("<m:rad/><m:r><m:t>x"), text, F.lit("</m:t></m:r></m:oMath></w:p>"))
    alt = F.concat(F.lit('<mc:AlternateContent><mc:Choice Requires="wps"/>'), F.when(k % 2 == 0, "<mc:Choice/>").otherwise(""), F.when(k % 3 == 0, "<mc:Fallback/>").otherwise(""), F.lit("</mc:AlternateContent>"))
    inner = F.concat(F.lit('<wp:extent cx="'), (k * 10).cast("string"), F.lit('" cy="20"/><wp:docPr descr="'), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("d"), text)), F.lit('" title="t"/><a:xfrm rot="-'), ((k % 7) * 60000).cast("string"), F.lit('"/><a:blip r:embed="r1"/>'), F.when(k % 2 == 0, "<a:glow/>").otherwise(""))
    drawing = F.when(k % 4 == 0, F.concat(F.lit("<wp:inline>"), inner, F.lit("</wp:inline>"))).otherwise(F.concat(F.lit("<wp:anchor"), F.when(k % 4 == 1, ' behindDoc="0"').otherwise(""), F.lit('><wp:wrapTight/><wp:positionH relativeFrom="page"/>'), F.when(k % 5 == 0, '<wp:positionV relativeFrom="margin"/>').otherwise(""), F.when(k % 6 == 1, "<wps:grpSp/>").when(k % 6 == 3, "<wpg:wgp/>").otherwise(""), F.when(k % 3 == 1, "<w:txbxContent/>").otherwise(""), inner, F.lit("</wp:anchor>")))
    drawing = F.concat(F.lit("<w:p><w:r><w:drawing>"), drawing, F.lit("</w:drawing></w:r></w:p>"))
    old = F.concat(F.lit('<w:p><w:r><w:pict><v alt="p'), text, F.lit('"/></w:pict></w:r><w:r><w:object w:dxaOrig="7"><o:OLEObject ObjectID="'), F.repeat(F.lit("z"), (k % 300).cast("int")), F.lit('" ProgID="Excel"/></w:object></w:r></w:p>'))
    tail = F.lit('<w:sectPr><w:headerReference w:type="default" r:id="h1"/><w:pgSz w:w="600" w:h="800"/><w:pgNumType w:start="3"/><w:titlePg/></w:sectPr></w:body></w:document>')
    head = f'<w:document {X.W} xmlns:m="m" xmlns:mc="mc" xmlns:wp="wp" xmlns:wps="wps" xmlns:wpg="wpg" xmlns:a="a" xmlns:o="o"><w:body>'
    return _row(
        X.spread(spark, sf, "orders", "o_orderkey"), "o_orderkey", ("word/document.xml", F.concat(F.lit(head), first, sdt, math, alt, drawing, old, tail)), ("word/_rels/document.xml.rels", F.lit('<Relationships><Relationship Id="r1" Target="media/i.jpeg"/></Relationships>')), ("word/media/i.jpeg", F.lit("x"), k % 8 != 0)
    )


X.FIXTURES |= {"edge": fx_edge, "style": fx_style, "sect": fx_sect}


def nodes(s, d, name, places=None):
    return X.nodes_of(s, d, name, places)


def src_09_relationships(s, d):
    return P.relationships(nodes(s, d, "edge")).select(*long("doc_id"), "part", "rel_id", "target")


def src_10_resolve_target(s, d):
    rows = P.relationships(nodes(s, d, "edge"))
    return rows.select(*long("doc_id"), P.resolve_target(F.col("part"), F.col("target")).alias("path"))


def pkg_04_settings(s, d):
    return G.settings(nodes(s, d, "edge")).select(*long("doc_id", "zoom"), "track_revisions", "zone")


def pkg_05_fonts(s, d):
    return G.fonts(nodes(s, d, "style")).select("doc_id", "name", "alternate", "summary")


def pkg_06_styles(s, d):
    return G.styles(nodes(s, d, "style")).select("doc_id", *long("ordinal"), "style_id", "name", "is_default", "link")


def edg_01_protection(s, d):
    return G.protection(nodes(s, d, "edge")).select(*long("doc_id"), "edit_type", "enforcement", "summary")


def edg_02_custom_xml(s, d):
    return G.custom_xml(fx_edge(s, d), nodes(s, d, "edge")).select(*long("doc_id"), "root", "namespace")


def edg_03_mail_merge(s, d):
    return G.mail_merge(nodes(s, d, "edge")).select(*long("doc_id"), "type", "data_type", "source_name")


def edg_04_interactive_content(s, d):
    return G.interactive_content(fx_edge(s, d)).select(*long("doc_id"), "macros", "signatures", "controls")


def edg_05_embedded_files(s, d):
    own = G.embedded_files(fx_edge(s, d)).withColumn("wide", F.lit(False)).unionByName(G.embedded_files(fx_edge(s, d), None).withColumn("wide", F.lit(True)))
    return own.select(*long("doc_id"), "ext", "wide")


def edg_06_accessibility(s, d):
    return G.accessibility(nodes(s, d, "sect", G.DESCRIBED_PLACES)).select(*long("doc_id", "ordinal"), "summary")


def edg_07_hyphenation(s, d):
    return G.hyphenation(nodes(s, d, "edge")).select(*long("doc_id"), "auto", "zone")


def doc_31_sections(s, d):
    return G.sections(nodes(s, d, "sect")).select(*long("doc_id", "section"), "source")


def doc_32_section_properties(s, d):
    return G.sections(nodes(s, d, "sect")).select(*long("doc_id", "section", "width", "page_start"), "type", "title_page", F.array_join("headers", ",").alias("headers"))


def doc_33_headers_footers(s, d):
    return G.headers_footers(nodes(s, d, "edge")).select(*long("doc_id", "paragraphs", "tables"), "kind", "text")


def doc_34_header_variant(s, d):
    return G.headers_footers(nodes(s, d, "edge")).select(*long("doc_id", "ordinal"), "kind", "variant")


def doc_35_watermark_probe(s, d):
    raw = P.part_text(P.parts_like(fx_edge(s, d), "word/footer").withColumn("content", F.col("content").cast("binary")))
    return G.watermark_probe(raw).select(*long("doc_id"), F.array_join("found", ",").alias("found"))


def doc_18_images(s, d):
    n = nodes(s, d, "sect")
    return G.images(n, P.relationships(n), fx_sect(s, d)).select(*long("doc_id"), "uri", "alt", "ext")


def doc_19_drawings_inline(s, d):
    return G.drawings(nodes(s, d, "sect")).where("kind = 'inline'").select(*long("doc_id", "width", "rotation"), "alt", "title", "wrap")


def doc_20_drawings_anchored(s, d):
    return G.drawings(nodes(s, d, "sect")).where("kind = 'anchor'").select(*long("doc_id", "width", "height"), "position_x", "position_y", "grouped", "has_text", "has_chart")


def doc_21_wrap_style(s, d):
    return G.drawings(nodes(s, d, "sect")).groupBy("wrap").agg(F.count("*").alias("n"))


def doc_22_rotation(s, d):
    return G.drawings(nodes(s, d, "sect", G.DRAWING_PLACES)).groupBy(F.col("rotation").cast("long").alias("rotation")).agg(F.count("*").alias("n"))


def doc_23_effects(s, d):
    return G.drawings(nodes(s, d, "sect")).select(*long("doc_id"), F.array_join("effects", ",").alias("effects"))


def doc_24_legacy_pict(s, d):
    return G.legacy_pictures(nodes(s, d, "sect")).select(*long("doc_id"), "kind", "inline", "alt", "wrap")


def doc_25_ole_objects(s, d):
    return G.ole_objects(nodes(s, d, "sect")).select(*long("doc_id"), "kind", "prog_id", "shape_id", "description")


def mrk_01_content_controls(s, d):
    return G.content_controls(nodes(s, d, "sect")).select(*long("doc_id", "ordinal", "items"), "title")


def mrk_02_control_type(s, d):
    return G.content_controls(nodes(s, d, "sect")).select(*long("doc_id"), "type")


def mrk_08_math_zones(s, d):
    return G.math_zones(nodes(s, d, "sect")).select(*long("doc_id", "ordinal"), "counts", "text")


def mrk_09_alternate_content(s, d):
    return G.alternate_content(nodes(s, d, "sect")).select(*long("doc_id", "ordinal", "choices"), "has_fallback", "requires")


def edg_08_placeholders(s, d):
    from docflow.operators.marks import placeholders

    return placeholders(nodes(s, d, "sect")).select(*long("doc_id"), "placeholders")


def doc_38_whole_document(s, d):
    return C.whole_document(nodes(s, d, "sect"), fx_sect(s, d)).select(*long("doc_id", "seq"), "type", "kind", "summary")


def fx_whole(spark: SparkSession, sf: str) -> DataFrame:
    """For each supplier a document with every kind of element: header, footer, notes, comment, bookmark, field, old picture, page break, table."""
    k = F.col("s_suppkey").cast("string")
    run = lambda text: F.concat(F.lit(f"<w:r><w:t>{text} "), k, F.lit("</w:t></w:r>"))
    in_p = lambda head, text, tail: F.concat(F.lit(f"{head}<w:p>"), run(text), F.lit(f"</w:p>{tail}"))
    body = F.concat(
        F.lit(f'<w:document {X.W}><w:body><w:p><w:bookmarkStart w:id="'), k, F.lit('" w:name="b'), k, F.lit('"/><w:fldSimple w:instr="REF b'), k, F.lit('">'), run("see"), F.lit('</w:fldSimple><w:bookmarkEnd w:id="'), k, F.lit('"/><w:r><w:pict><w:v alt="old '), k,
        F.lit('"/></w:pict><w:br w:type="page"/></w:r></w:p><w:tbl><w:tr><w:tc><w:p>'), run("cell"), F.lit("</w:p></w:tc></w:tr></w:tbl><w:sectPr/></w:body></w:document>"),
    )
    note = lambda kind: (f"word/{kind}s.xml", in_p(f'<w:{kind}s {X.W}><w:{kind} w:id="2">', kind, f"</w:{kind}></w:{kind}s>"))
    return _row(
        X.table(spark, sf, "supplier"), "s_suppkey", ("word/document.xml", body), ("word/header1.xml", in_p(f"<w:hdr {X.W}>", "top", "</w:hdr>")), ("word/footer1.xml", in_p(f"<w:ftr {X.W}>", "foot", "</w:ftr>")), note("footnote"), note("endnote"),
        ("word/comments.xml", in_p(f'<w:comments {X.W}><w:comment w:id="1" w:author="A">', "said", "</w:comment></w:comments>")),
    )


X.FIXTURES["whole"] = fx_whole


def _whole(s, d):
    return X.kept(s, d, "whole-elements", lambda: C.whole_document(nodes(s, d, "whole"), fx_whole(s, d)))


def doc_38_every_kind(s, d):
    rows = _whole(s, d)
    return rows.select(*long("doc_id", "seq"), "type", "kind", "name", F.coalesce("text", F.array_join(F.flatten("rows"), "|")).alias("text"), "summary")


def elm_02_whole_text(s, d):
    return E.to_plain_text(_whole(s, d)).select(*long("doc_id"), "text")


def elm_06_every_kind(s, d):
    return E.display_text(_whole(s, d)).select(*long("doc_id", "seq"), "shown")


def snk_04_media_files(s, d):
    """Pictures as files, read again."""
    n, parts = X.few_nodes_of(s, d, "sect", G.IMAGE_PLACES), fx_sect(s, d)
    path = X.folder(s, d, "media-files", lambda path: K.write_media_files(parts.withColumn("content", F.col("content").cast("binary")), G.images(n, P.relationships(n), parts), path))
    return P.read_corpus(s, path, "*.jpeg").select(F.regexp_extract("path", "/([0-9]+)/i.jpeg$", 1).cast("long").alias("doc_id"), F.decode("content", "UTF-8").alias("bytes"))


def snk_04_write_media(s, d):
    n, parts, path = X.few_nodes_of(s, d, "sect", G.IMAGE_PLACES), fx_sect(s, d), P.new_folder(s, "media")
    K.write_media(parts, G.images(n, P.relationships(n), parts), path)
    return s.read.parquet(path).select("uri", F.octet_length("content").cast("long").alias("bytes"))


def edg_09_catalogue(s, d):
    rows = C.catalogue(nodes(s, d, "edge"), fx_edge(s, d))
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def edg_09_catalogue_titles(s, d):
    return C.catalogue(nodes(s, d, "edge"), fx_edge(s, d)).groupBy("kind", "title").agg(F.count("*").alias("n"))


def doc_32_section_text(s, d):
    return G.sections(nodes(s, d, "sect")).select(*long("doc_id", "section"), "text")


def elm_10_span_links(s, d):
    n = nodes(s, d, "water")
    return E.flatten_spans(n, P.relationships(n)).select(*long("doc_id", "para", "ordinal"), "text", "link_address", "link_anchor")


def mrk_06_captions(s, d):
    from docflow.operators.marks import captions

    return captions(nodes(s, d, "caption")).select("doc_id", *long("ordinal"), "kind", "text")


def fx_caption(spark: SparkSession, sf: str) -> DataFrame:
    """A caption of a figure, of a table or of neither for each part, by brand."""
    k = F.col("p_partkey")
    instr = X.case(k % 3, (0, "SEQ Figure"), (1, "SEQ Table"), other="SEQ Other")
    xml = F.concat(F.lit("<w:p><w:r><w:t>Item </w:t></w:r><w:r><w:instrText>"), instr, F.lit("</w:instrText></w:r><w:r><w:t>"), X.escaped(F.col("p_name")), F.lit(" </w:t></w:r></w:p>"))
    return X.aggregated(X.table(spark, sf, "part"), F.col("p_brand"), "p_partkey", xml, "word/document.xml", f"<w:document {X.W}><w:body>", "</w:body></w:document>")


X.FIXTURES["caption"] = fx_caption


def mrk_10_watermarks(s, d):
    n = nodes(s, d, "water")
    return G.watermarks(n, P.relationships(n)).select(*long("doc_id"), "kind", "target")


def fx_water(spark: SparkSession, sf: str) -> DataFrame:
    """A header with a shape and a picture for each supplier, and a page background."""
    k = F.col("s_suppkey")
    shape = F.when(k % 2 == 0, '<v:shape id="PowerPlusWaterMarkObject"/>').otherwise('<v:shape id="plain"/>')
    picture = F.concat(F.lit('<v:imagedata r:id="'), F.when(k % 3 == 0, "gone").otherwise("r1"), F.lit('"/>'))
    ground = F.when(k % 2 == 0, '<w:background w:color="00FF00"/>').otherwise('<w:background w:themeColor="accent1" r:id="r1"/>')
    link = F.when(k % 5 == 0, '<w:hyperlink w:anchor="top">').when(k % 5 == 1, '<w:hyperlink r:id="gone">').when(k % 5 == 2, '<w:hyperlink r:id="m">').otherwise('<w:hyperlink r:id="h" w:tooltip="tip">')
    return _row(
        X.table(spark, sf, "supplier"), "s_suppkey", ("word/header1.xml", F.concat(F.lit(f'<w:hdr {X.W} xmlns:v="v"><w:p>'), shape, picture, F.lit("</w:p></w:hdr>"))),
        ("word/_rels/header1.xml.rels", F.lit('<Relationships><Relationship Id="r1" Target="media/w.png"/></Relationships>')),
        ("word/document.xml", F.concat(F.lit(f"<w:document {X.W}>"), ground, F.lit("<w:body><w:p>"), link, F.lit("<w:r><w:t>x</w:t></w:r></w:hyperlink></w:p></w:body></w:document>"))),
        ("word/_rels/document.xml.rels", F.lit('<Relationships><Relationship Id="r1" Target="media/b.png"/><Relationship Id="m" Target="MAILTO:a@b.example"/><Relationship Id="h" Target="http://a.example"/></Relationships>')),
    )


X.FIXTURES["water"] = fx_water


def pkg_07_background(s, d):
    n = nodes(s, d, "water")
    return G.background(n, P.relationships(n)).select(*long("doc_id"), "color", "theme_color", "image")


def doc_04_paragraph_hyperlink(s, d):
    n = nodes(s, d, "water")
    return B.hyperlinks(n, P.relationships(n)).select(*long("doc_id"), "address", "anchor", "tooltip")


def doc_05_is_external_is_email(s, d):
    n = nodes(s, d, "water")
    return B.hyperlinks(n, P.relationships(n)).select(*long("doc_id"), "is_external", "is_email")


O = "o_orderkey"
BIT = lambda n: f"(s_suppkey >> {n}) % 2 = 1"
OBJECT = f"""left('<w:object w:dxaOrig="7"><o:OLEObject ObjectID="' || repeat('z', {O} % 300) || '" ProgID="Excel"/></w:object>', 200)"""
EDGE_KINDS = f"""['document-settings', CASE WHEN {BIT(0)} OR {BIT(1)} OR {BIT(2)} THEN 'protection' END, 'custom-xml-collection', 'custom-xml', CASE WHEN {BIT(1)} THEN 'mail-merge' END,
    CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 5 = 0 OR s_suppkey % 6 = 0 THEN 'interactive-content' END, CASE WHEN s_suppkey % 2 = 0 THEN 'embeddings-collection' END, CASE WHEN s_suppkey % 2 = 0 THEN 'embedded-file' END, CASE WHEN {BIT(4)} OR {BIT(5)} THEN 'hyphenation' END]"""
SECT_ROWS = f"""[['section', NULL, 'paragraph:0'], ['section', NULL, 'body'], ['metadata', 'content-controls', '1 content controls'], ['metadata', 'mathematics', '1 math zones'], ['metadata', 'alternate-content-set', '1 alternate content blocks'],
    ['metadata', 'pagination', 'estimatedPages=1'], ['metadata', 'accessibility-data', '1 objects with alt text'], CASE WHEN {O} % 2 = 0 THEN ['metadata', 'placeholders', '1 active placeholders detected'] END, ['paragraph', NULL, NULL],
    CASE WHEN {O} % 8 <> 0 THEN ['image', 'jpeg', 'Document Image'] END, ['drawing', 'drawing', CASE WHEN {O} % 3 = 0 THEN ' ' ELSE 'd' || {O} END], ['drawing', 'pict', 'p' || {O}], ['object', 'ole-object', {OBJECT}]]"""
SECTION = "'SectionProperties(sectionIndex=0, source=body, type=null, pageWidth=null, pageHeight=null, margins=EdgeInsets(top=null, right=null, bottom=null, left=null), columnCount=null, pageNumberStart=null, headerReferences=[], footerReferences=[])'"
#: seq, type, kind, name, text, summary, plain text and shown text of fx_whole's elements; k is the supplier's key.
EVERY_KIND = f"""(0, 'section', NULL, NULL, {SECTION}, 'body', {SECTION}, {SECTION}), (1, 'header_footer', 'header', 'primary', 'top ' || k, NULL, 'top ' || k, 'header (primary): top ' || k), (2, 'header_footer', 'footer', 'primary', 'foot ' || k, NULL, 'foot ' || k, 'footer (primary): foot ' || k),
    (3, 'note', 'footnote', '2', 'footnote ' || k, NULL, 'footnote ' || k, 'footnote 2: footnote ' || k), (4, 'note', 'endnote', '2', 'endnote ' || k, NULL, 'endnote ' || k, 'endnote 2: endnote ' || k), (5, 'comment', NULL, 'A', 'said ' || k, NULL, 'said ' || k, 'comment by A: said ' || k),
    (6, 'metadata', 'references', 'References', NULL, '1 references', 'References: 1 references', 'References: 1 references'), (7, 'metadata', 'pagination', 'Page Layout', NULL, 'estimatedPages=2', 'Page Layout: estimatedPages=2', 'Page Layout: estimatedPages=2'),
    (8, 'bookmark', 'start', 'b' || k, NULL, k, 'b' || k, 'bookmark start: b' || k), (9, 'bookmark', 'end', '', NULL, k, '', 'bookmark end: '), (10, 'field', 'variable-ref', NULL, 'REF b' || k, NULL, 'REF b' || k, 'field variable-ref: REF b' || k), (11, 'drawing', 'pict', NULL, NULL, 'old ' || k, 'pict', 'pict'),
    (12, 'paragraph', NULL, NULL, 'see ' || k, NULL, 'see ' || k, 'see ' || k), (13, 'page_break', NULL, NULL, NULL, NULL, '', ''), (14, 'table', NULL, NULL, 'cell ' || k, NULL, 'cell ' || k, 'cell ' || k)"""
EVERY = f"SELECT s_suppkey AS doc_id, v.* FROM (SELECT s_suppkey, s_suppkey::VARCHAR AS k FROM supplier), LATERAL (VALUES {EVERY_KIND}) AS v(seq, type, kind, name, text, summary, plain, shown)"
SQL = {
    "doc_38_every_kind": f"SELECT doc_id, seq, type, kind, name, text, summary FROM ({EVERY})",
    "elm_02_whole_text": f"SELECT doc_id, string_agg(plain, chr(10) ORDER BY seq) AS text FROM ({EVERY}) GROUP BY doc_id",
    "elm_06_every_kind": f"SELECT doc_id, seq, shown FROM ({EVERY})",
    "snk_04_media_files": f"SELECT {O} AS doc_id, 'x' AS bytes FROM orders WHERE {O} % 8 <> 0",
    "src_09_relationships": "SELECT s_suppkey AS doc_id, 'word/document.xml' AS part, 'r1' AS rel_id, CASE s_suppkey % 4 WHEN 0 THEN 'media/x.png' WHEN 1 THEN '../media/x.png' WHEN 2 THEN '/word/media/x.png' ELSE './x' END AS target FROM supplier",
    "src_10_resolve_target": "SELECT s_suppkey AS doc_id, CASE s_suppkey % 4 WHEN 0 THEN 'word/media/x.png' WHEN 1 THEN 'media/x.png' WHEN 2 THEN 'word/media/x.png' ELSE 'word/x' END AS path FROM supplier",
    "pkg_04_settings": f"SELECT s_suppkey AS doc_id, s_suppkey % 200 AS zoom, CASE WHEN {BIT(3)} THEN 'true' END AS track_revisions, CASE WHEN {BIT(5)} THEN s_suppkey::VARCHAR END AS zone FROM supplier",
    "pkg_05_fonts": "SELECT p_brand AS doc_id, 'F' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'A' END AS alternate, 'F' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN ', alt=A' ELSE '' END || ', family=roman' || CASE WHEN p_partkey % 5 = 0 THEN ', embedded' ELSE '' END AS summary FROM part",
    "pkg_06_styles": "SELECT p_brand AS doc_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS ordinal, 'S' || p_partkey AS style_id, CASE WHEN p_partkey % 4 <> 0 THEN 'N' ELSE 'S' END || p_partkey AS name, p_partkey % 10 = 0 AS is_default, CASE WHEN p_partkey % 3 = 0 THEN 'L' END AS link FROM part",
    "edg_01_protection": f"""SELECT s_suppkey AS doc_id, CASE WHEN {BIT(0)} THEN CASE WHEN s_suppkey % 3 = 0 THEN 'unknown' ELSE 'readOnly' END END AS edit_type, CASE WHEN {BIT(0)} THEN CASE WHEN s_suppkey % 3 = 0 THEN '1' ELSE '0' END END AS enforcement,
        concat_ws('; ', CASE WHEN {BIT(0)} THEN 'protection: ' || CASE WHEN s_suppkey % 3 = 0 THEN 'restricted' ELSE 'readOnly' END END, CASE WHEN {BIT(1)} THEN 'write-protected' END, CASE WHEN {BIT(2)} THEN 'read-only recommended' END) AS summary FROM supplier WHERE {BIT(0)} OR {BIT(1)} OR {BIT(2)}""",
    "edg_02_custom_xml": "SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 7 = 0 THEN 'unknown' ELSE 'r' END AS root, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'urn:x' END AS namespace FROM supplier",
    "edg_03_mail_merge": f"SELECT s_suppkey AS doc_id, 'letters' AS type, 'none' AS data_type, 'f' || s_suppkey || '.csv' AS source_name FROM supplier WHERE {BIT(1)}",
    "edg_04_interactive_content": "SELECT s_suppkey AS doc_id, s_suppkey % 4 = 0 AS macros, (s_suppkey % 5 = 0)::INT AS signatures, (s_suppkey % 6 = 0)::INT AS controls FROM supplier WHERE s_suppkey % 4 = 0 OR s_suppkey % 5 = 0 OR s_suppkey % 6 = 0",
    "edg_05_embedded_files": "SELECT s_suppkey AS doc_id, 'xml' AS ext, w AS wide FROM supplier, (VALUES (true), (false)) AS v(w) WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'bin', true FROM supplier WHERE s_suppkey % 3 = 0",
    "edg_06_accessibility": f"SELECT {O} AS doc_id, 1 AS ordinal, CASE WHEN {O} % 3 = 0 THEN 't' ELSE 'd' || {O} END AS summary FROM orders",
    "edg_07_hyphenation": f"SELECT s_suppkey AS doc_id, CASE WHEN {BIT(4)} THEN CASE WHEN s_suppkey % 5 = 0 THEN 'true' ELSE 'false' END END AS auto, CASE WHEN {BIT(5)} THEN s_suppkey::VARCHAR END AS zone FROM supplier WHERE {BIT(4)} OR {BIT(5)}",
    "edg_08_placeholders": f"SELECT {O} AS doc_id, 1 AS placeholders FROM orders WHERE {O} % 2 = 0",
    "doc_31_sections": f"SELECT {O} AS doc_id, i AS section, s AS source FROM orders, (VALUES (0, 'paragraph:0'), (1, 'body')) AS v(i, s)",
    "doc_32_section_properties": f"SELECT {O} AS doc_id, 0 AS section, CASE WHEN {O} % 5 <> 0 THEN ('1' || {O} % 1000)::BIGINT END AS width, NULL::BIGINT AS page_start, 'continuous' AS type, false AS title_page, '' AS headers FROM orders UNION ALL SELECT {O}, 1, 600, 3, NULL, true, 'default:h1' FROM orders",
    "doc_33_headers_footers": "SELECT s_suppkey AS doc_id, p AS paragraphs, t AS tables, k AS kind, CASE x WHEN '2' THEN CASE WHEN s_suppkey % 2 = 0 THEN 'First page' ELSE 'Even page' END || chr(10) ELSE x END AS text FROM supplier, (VALUES (1, 0, 'header', 'Top'), (2, 0, 'header', '2'), (1, 1, 'footer', '')) AS v(p, t, k, x)",
    "doc_34_header_variant": "SELECT s_suppkey AS doc_id, o AS ordinal, k AS kind, CASE WHEN o = 0 THEN 'primary' WHEN s_suppkey % 2 = 0 THEN 'first' ELSE 'even' END AS variant FROM supplier, (VALUES (0, 'header'), (1, 'header'), (0, 'footer')) AS v(o, k)",
    "doc_35_watermark_probe": "SELECT s_suppkey AS doc_id, 'text-watermark' AS found FROM supplier WHERE s_suppkey % 3 = 0",
    "doc_18_images": f"SELECT {O} AS doc_id, {O} || '#word/media/i.jpeg' AS uri, 'Document Image' AS alt, 'jpeg' AS ext FROM orders WHERE {O} % 8 <> 0",
    "doc_19_drawings_inline": f"SELECT {O} AS doc_id, {O} * 10 AS width, -({O} % 7) AS rotation, CASE WHEN {O} % 3 = 0 THEN ' ' ELSE 'd' || {O} END AS alt, 't' AS title, 'inline' AS wrap FROM orders WHERE {O} % 4 = 0",
    "doc_20_drawings_anchored": f"SELECT {O} AS doc_id, {O} * 10 AS width, 20 AS height, 'page' AS position_x, CASE WHEN {O} % 5 = 0 THEN 'margin' END AS position_y, {O} % 6 = 1 AS grouped, {O} % 3 = 1 AS has_text, false AS has_chart FROM orders WHERE {O} % 4 <> 0",
    "doc_21_wrap_style": f"SELECT CASE WHEN {O} % 4 = 0 THEN 'inline' ELSE 'tight' END AS wrap, count(*) AS n FROM orders GROUP BY 1",
    "doc_22_rotation": f"SELECT -({O} % 7) AS rotation, count(*) AS n FROM orders GROUP BY 1",
    "doc_23_effects": f"SELECT {O} AS doc_id, CASE WHEN {O} % 2 = 0 THEN 'glow' ELSE '' END AS effects FROM orders",
    "doc_24_legacy_pict": f"SELECT {O} AS doc_id, 'pict' AS kind, true AS inline, 'p' || {O} AS alt, 'legacy-vml' AS wrap FROM orders",
    "doc_25_ole_objects": f"SELECT {O} AS doc_id, 'ole-object' AS kind, 'Excel' AS prog_id, '7' AS shape_id, {OBJECT} AS description FROM orders",
    "mrk_01_content_controls": f"SELECT {O} AS doc_id, 1 AS ordinal, CASE WHEN {O} % 4 = 1 THEN 2 ELSE 0 END AS items, CASE WHEN {O} % 3 = 0 THEN 'A' || {O} ELSE 'Control 1' END AS title FROM orders",
    "mrk_02_control_type": f"SELECT {O} AS doc_id, CASE {O} % 4 WHEN 0 THEN 'plain-text' WHEN 1 THEN 'drop-down-list' WHEN 2 THEN 'date-picker' ELSE 'unknown' END AS type FROM orders",
    "mrk_08_math_zones": f"SELECT {O} AS doc_id, 1 AS ordinal, CASE WHEN {O} % 2 = 0 THEN 'f=2, rad=1' ELSE 'rad=1' END AS counts, 'x' || {O} AS text FROM orders",
    "mrk_09_alternate_content": f"SELECT {O} AS doc_id, 1 AS ordinal, CASE WHEN {O} % 2 = 0 THEN 2 ELSE 1 END AS choices, {O} % 3 = 0 AS has_fallback, 'wps' AS requires FROM orders",
    "mrk_06_captions": "SELECT p_brand AS doc_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS ordinal, CASE p_partkey % 3 WHEN 0 THEN 'figure-caption' ELSE 'table-caption' END AS kind, 'Item ' || rtrim(p_name) AS text FROM part WHERE p_partkey % 3 < 2",
    "mrk_10_watermarks": "SELECT s_suppkey AS doc_id, 'shape' AS kind, 'PowerPlusWaterMarkObject' AS target FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'image', CASE WHEN s_suppkey % 3 = 0 THEN 'gone' ELSE 'media/w.png' END FROM supplier",
    "pkg_07_background": "SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 2 = 0 THEN '00FF00' END AS color, CASE WHEN s_suppkey % 2 = 1 THEN 'accent1' END AS theme_color, CASE WHEN s_suppkey % 2 = 1 THEN 'word/media/b.png' END AS image FROM supplier",
    "doc_04_paragraph_hyperlink": "SELECT s_suppkey AS doc_id, CASE s_suppkey % 5 WHEN 2 THEN 'MAILTO:a@b.example' WHEN 3 THEN 'http://a.example' WHEN 4 THEN 'http://a.example' END AS address, CASE WHEN s_suppkey % 5 = 0 THEN 'top' END AS anchor, CASE WHEN s_suppkey % 5 > 2 THEN 'tip' END AS tooltip FROM supplier",
    "doc_05_is_external_is_email": "SELECT s_suppkey AS doc_id, s_suppkey % 5 > 1 AS is_external, s_suppkey % 5 = 2 AS is_email FROM supplier",
    "edg_09_catalogue": f"SELECT kind, count(*) AS n FROM supplier, unnest({EDGE_KINDS}) AS u(kind) WHERE kind IS NOT NULL GROUP BY kind",
    "edg_09_catalogue_titles": f"""WITH t(kind, title) AS (VALUES ('document-settings', 'Document Settings'), ('protection', 'Document Protection'), ('custom-xml-collection', 'Custom XML Data'), ('custom-xml', 'item1.xml'), ('mail-merge', 'Mail Merge Configuration'),
        ('interactive-content', 'Interactive & Advanced Content'), ('embeddings-collection', 'Embedded Objects & Files'), ('embedded-file', 'e.xml'), ('hyphenation', 'Hyphenation Settings'))
        SELECT kind, title, count(*) AS n FROM supplier, unnest({EDGE_KINDS}) AS u(kind) JOIN t USING (kind) GROUP BY kind, title""",
    "doc_32_section_text": f"""SELECT {O} AS doc_id, 0 AS section, 'SectionProperties(sectionIndex=0, source=paragraph:0, type=continuous, pageWidth=' || CASE WHEN {O} % 5 <> 0 THEN '1' || {O} % 1000 ELSE 'null' END ||
        ', pageHeight=500, margins=EdgeInsets(top=null, right=null, bottom=null, left=null), columnCount=null, pageNumberStart=null, headerReferences=[], footerReferences=[])' AS text FROM orders
        UNION ALL SELECT {O}, 1, 'SectionProperties(sectionIndex=1, source=body, type=null, pageWidth=600, pageHeight=800, margins=EdgeInsets(top=null, right=null, bottom=null, left=null), columnCount=null, pageNumberStart=3, headerReferences=[HeaderFooterReference(relationshipId=h1, type=default)], footerReferences=[])' FROM orders""",
    "elm_10_span_links": "SELECT s_suppkey AS doc_id, 0 AS para, 0 AS ordinal, 'x' AS text, CASE s_suppkey % 5 WHEN 2 THEN 'MAILTO:a@b.example' WHEN 3 THEN 'http://a.example' WHEN 4 THEN 'http://a.example' END AS link_address, CASE WHEN s_suppkey % 5 = 0 THEN 'top' END AS link_anchor FROM supplier",
    "doc_38_whole_document": f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS seq, r[1] AS type, r[2] AS kind, r[3] AS summary
        FROM (SELECT {O} AS doc_id, unnest({SECT_ROWS}) AS r, generate_subscripts({SECT_ROWS}, 1) AS i FROM orders) WHERE r IS NOT NULL""",
    "snk_04_write_media": f"SELECT {O} || '#word/media/i.jpeg' AS uri, 1 AS bytes FROM orders WHERE {O} % 8 <> 0",
}
QUERIES = {name: globals()[name] for name in SQL}
