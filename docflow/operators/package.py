"""What a package says outside its text: settings, styles, fonts, sections, headers, drawings, controls, protection, macros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions import strings as S
from docflow.operators import body as B
from docflow.operators.marks import paragraph_texts
from docflow.operators.tree import KEY, attr, below, enclosing, first_per, named
from docflow.sources.packages import parts_like, resolve_target

SETTINGS = "word/settings.xml"
#: Ordered: the first element that a control's properties have names its type. Fixed values.
CONTROLS = {
    "text": "plain-text", "richText": "rich-text", "dropDownList": "drop-down-list", "checkBox": "checkbox", "date": "date-picker", "comboBox": "combo-box", "docPartList": "building-block-gallery",
}
EFFECTS = [("outerShdw", "shadow"), ("reflection", "reflection"), ("glow", "glow"), ("softEdge", "soft-edge"), ("scene3d", "3d-scene"), ("sp3d", "3d-shape")]
WRAPS = [("wrapSquare", "square"), ("wrapTight", "tight"), ("wrapThrough", "through"), ("behindDoc", "behind"), ("wrapTopAndBottom", "top-bottom")]


def _value(name: str, a: str = "val") -> Column:
    """Within a group of elements: the attribute of the one of that name."""
    return F.max(F.when(F.col("name") == name, attr(a)))


def _has(name: str) -> Column:
    return F.coalesce(F.bool_or(F.col("name") == name), F.lit(False))


def _switch(name: str) -> Column:
    """true or false as text for a switch that is there, null for one that isn't; without a value it is true."""
    return F.max(F.when(F.col("name") == name, F.coalesce(attr("val"), F.lit("true"))))


def settings(nodes: DataFrame) -> DataFrame:
    """doc_id and a document's settings as columns; null where they aren't set."""
    own = nodes.where((F.col("part") == SETTINGS) & (F.col("kind") == "elem"))
    return own.groupBy("doc_id").agg(
        _value("documentProtection", "edit").alias("edit"), _value("documentProtection", "enforcement").alias("enforcement"), _value("documentProtection", "formatting").alias("formatting"), _value("documentProtection", "cryptProviderType").alias("provider"),
        _has("documentProtection").alias("protected"), _has("writeProtection").alias("write_protected"), _has("readOnlyRecommended").alias("read_only"), _switch("trackRevisions").alias("track_revisions"),
        _switch("evenAndOddHeaders").alias("even_and_odd"), _switch("doNotHyphenateCaps").alias("no_caps"), _value("hyphenationZone").alias("zone"), _value("consecutiveHyphenLimit").alias("hyphen_limit"),
        _has("autoHyphenation").alias("auto_there"), _value("autoHyphenation").alias("auto"), _value("defaultTabStop").alias("tab_stop"), _value("zoom", "percent").alias("zoom"),
        _has("mailMerge").alias("merge_there"), _value("mainDocumentType").alias("merge_type"), _value("dataType").alias("data_type"), _value("dataSource").alias("data_source"), _value("query").alias("query"),
    )


def protection(nodes: DataFrame) -> DataFrame:
    """doc_id, edit_type, enforcement, provider, summary of protected documents."""
    rows = settings(nodes).where("protected or write_protected or read_only")
    first = F.when(F.col("protected"), F.concat(F.lit("protection: "), F.coalesce("edit", F.lit("restricted"))))
    summary = F.concat_ws("; ", first, F.when(F.col("write_protected"), "write-protected"), F.when(F.col("read_only"), "read-only recommended"))
    return rows.select("doc_id", F.when(F.col("protected"), F.coalesce("edit", F.lit("unknown"))).alias("edit_type"), F.when(F.col("protected"), F.coalesce("enforcement", F.lit("1"))).alias("enforcement"), "provider", summary.alias("summary"))


def hyphenation(nodes: DataFrame) -> DataFrame:
    """doc_id, auto, zone, hyphen_limit; a bare autoHyphenation reads false."""
    rows = settings(nodes).where("auto_there or zone is not null")
    return rows.select("doc_id", F.when(F.col("auto_there"), F.coalesce("auto", F.lit("false"))).alias("auto"), "zone", "hyphen_limit")


def mail_merge(nodes: DataFrame) -> DataFrame:
    """doc_id, type, data_type, data_source, query, source_name: the data source after its last backslash."""
    source = F.coalesce("data_source", F.lit(""))
    return settings(nodes).where("merge_there").select("doc_id", F.coalesce("merge_type", F.lit("unknown")).alias("type"), F.coalesce("data_type", F.lit("none")).alias("data_type"), source.alias("data_source"), "query", S.after_last(source, "\\").alias("source_name"))


def interactive_content(parts: DataFrame) -> DataFrame:
    """doc_id, macros, signatures, controls of packages that have any; from entry names alone."""
    name = F.col("part")
    xml = name.endswith(".xml")
    counted = parts.groupBy("doc_id").agg(
        F.bool_or(name.startswith("word/") & name.contains("vbaProject") & name.endswith(".bin")).alias("macros"), F.count_if(name.startswith("_xmlsignatures/") & xml).alias("signatures"), F.count_if(name.startswith("word/activeX/") & xml).alias("controls")
    )
    return counted.where("macros or signatures > 0 or controls > 0")


def embedded_files(parts: DataFrame, suffix: str | None = ".xml") -> DataFrame:
    """doc_id, part, ext of embedded entries. The default finds XML only; None finds all."""
    return parts_like(parts, "word/embeddings/", suffix).select("doc_id", "part", F.regexp_extract("part", r"\.([^.]*)$", 1).alias("ext"))


def custom_xml(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, part, root, namespace of customXml entries; unknown and "" where they aren't well formed."""
    roots = nodes.where("pre = 0").select(*KEY, "name", "ns")
    rows = parts_like(parts, "customXml/").select(*KEY).join(roots, KEY, "left")
    return rows.select(*KEY, F.coalesce("name", F.lit("unknown")).alias("root"), F.coalesce("ns", F.lit("")).alias("namespace"))


def accessibility(nodes: DataFrame) -> DataFrame:
    """doc_id, ordinal, summary of drawings that are described, titled or decorative."""
    rows = named(nodes, "docPr", part=B.MAIN).select(*KEY, "pre", S.non_blank(attr("descr")).alias("descr"), S.non_blank(attr("title")).alias("title"), (attr("decorative") == "1").alias("decorative"))
    rows = rows.where("descr is not null or title is not null or decorative")
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")).alias("ordinal"), F.coalesce("descr", "title", F.lit("Decorative object")).alias("summary"))


def styles(nodes: DataFrame) -> DataFrame:
    """doc_id, ordinal, type, style_id, name, is_default, link, based_on."""
    heads = named(nodes, "style", part="word/styles.xml").select(*KEY, "pre", attr("type").alias("type"), attr("styleId").alias("style_id"), attr("default").alias("default"))
    inner = named(nodes, "name", "link", "basedOn", part="word/styles.xml").groupBy(*KEY, F.col("parent").alias("pre")).agg(_value("name").alias("named"), _value("link").alias("link"), _value("basedOn").alias("based_on"))
    rows = heads.join(inner, [*KEY, "pre"], "left")
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")).alias("ordinal"), F.coalesce("type", F.lit("unknown")).alias("type"), "style_id", F.coalesce("named", "style_id").alias("name"), (F.coalesce("default", F.lit("0")) == "1").alias("is_default"), "link", "based_on")


def fonts(nodes: DataFrame) -> DataFrame:
    """doc_id, ordinal, name, alternate, family, summary."""
    heads = named(nodes, "font", part="word/fontTable.xml").select(*KEY, "pre", attr("name").alias("font"))
    inner = named(nodes, "altName", "family", "embedRegular", "embedBold", part="word/fontTable.xml").groupBy(*KEY, F.col("parent").alias("pre")).agg(
        _value("altName").alias("alternate"), _value("family").alias("family"), F.bool_or(F.col("name").startswith("embed")).alias("embedded")
    )
    rows = heads.join(inner, [*KEY, "pre"], "left")
    summary = F.concat_ws(", ", "font", F.concat(F.lit("alt="), "alternate"), F.concat(F.lit("family="), "family"), F.when(F.col("embedded"), "embedded"))
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")).alias("ordinal"), F.col("font").alias("name"), "alternate", "family", summary.alias("summary"))


def background(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """doc_id, color, theme_color, image of the page background; the image by its relationship."""
    rows = named(nodes, "background", part=B.MAIN).select(*KEY, attr("color").alias("color"), attr("themeColor").alias("theme_color"), F.coalesce(attr("id"), attr("embed"), attr("link")).alias("rel_id"))
    rows = rows.join(rels, [*KEY, "rel_id"], "left")
    return rows.select("doc_id", "color", "theme_color", resolve_target(F.col("part"), F.col("target")).alias("image"))


def _said(name: str, **values: str | Column) -> Column:
    """Name(field=value, ...), the form in which a record's fields are written out in plain text."""
    said = [F.concat(F.lit(f"{k}="), F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit("null"))) for k, v in values.items()]
    return F.concat(F.lit(f"{name}("), F.concat_ws(", ", *said), F.lit(")"))


def sections(nodes: DataFrame) -> DataFrame:
    """doc_id, section, source, type, width, height, top, right, bottom, left, columns, page_start, title_page, headers, footers, text (all of it as one line).

    Sections that end in a paragraph come first, then the body's own. What is no whole
    number is null.
    """
    all_ = named(nodes, "sectPr", part=B.MAIN).select(*KEY, "pre", F.element_at("anc", -1).alias("up"), F.element_at("anc", -2).alias("p"))
    body = named(nodes, "body", part=B.MAIN).select(*KEY, F.col("pre").alias("up"), F.lit("body").alias("source"))
    paras = B.paragraphs(nodes).select(*KEY, F.col("pre").alias("p"), F.concat(F.lit("paragraph:"), "para").alias("source"))
    rows = all_.join(paras, [*KEY, "p"]).select(*KEY, "pre", "source").unionByName(all_.join(body, [*KEY, "up"]).select(*KEY, "pre", "source"))
    inner = named(nodes, "type", "pgSz", "pgMar", "cols", "pgNumType", "titlePg", "headerReference", "footerReference", part=B.MAIN).withColumn("at", F.element_at("anc", -1))
    number = lambda name, a: S.to_int(_value(name, a))
    refs = lambda name: F.array_sort(F.collect_list(F.when(F.col("name") == name, F.concat(attr("type"), F.lit(":"), attr("id")))))
    told = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("name") == name, F.struct("pre", attr("id").alias("id"), attr("type").alias("type"))))), lambda r: _said("HeaderFooterReference", relationshipId=r["id"], type=r["type"]))
    props = inner.groupBy(*KEY, F.col("at").alias("pre")).agg(
        _value("type").alias("type"), number("pgSz", "w").alias("width"), number("pgSz", "h").alias("height"), *(number("pgMar", x).alias(x) for x in ("top", "right", "bottom", "left")), number("cols", "num").alias("columns"),
        number("pgNumType", "start").alias("page_start"), _has("titlePg").alias("title_page"), refs("headerReference").alias("headers"), refs("footerReference").alias("footers"),
        told("headerReference").alias("_headers"), told("footerReference").alias("_footers"),
    )
    rows = rows.join(props, [*KEY, "pre"], "left").withColumn("section", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")) - 1)
    listed = lambda c: F.concat(F.lit("["), F.coalesce(F.array_join(c, ", "), F.lit("")), F.lit("]"))
    text = _said(
        "SectionProperties", sectionIndex="section", source="source", type="type", pageWidth="width", pageHeight="height", margins=_said("EdgeInsets", **{x: x for x in ("top", "right", "bottom", "left")}),
        columnCount="columns", pageNumberStart="page_start", headerReferences=listed("_headers"), footerReferences=listed("_footers"),
    )
    return rows.withColumn("text", text).drop("part", "pre", "_headers", "_footers")


def header_variant(index: Column, text: Column) -> Column:
    return F.when(index == 0, "primary").when(S.contains_ignoring_case(text, "first"), "first").when(S.contains_ignoring_case(text, "even"), "even").otherwise(F.concat(F.lit("variant-"), index))


def headers_footers(nodes: DataFrame) -> DataFrame:
    """doc_id, kind, ordinal, variant, text, paragraphs, tables: headers, then footers, each by part name."""
    roots = nodes.where((F.col("pre") == 0) & F.col("part").rlike("^word/(header|footer)[^/]*\\.xml$")).select(*KEY, "pre", F.when(F.col("part").contains("header"), "header").otherwise("footer").alias("kind"))
    counted = nodes.where("kind = 'elem'").groupBy(*KEY).agg(F.count_if((F.col("name") == "p") & (F.col("parent") == 0)).alias("paragraphs"), F.count_if((F.col("name") == "tbl") & (F.col("parent") == 0)).alias("tables"))
    rows = roots.join(counted, KEY).join(paragraph_texts(nodes), [*KEY, "pre"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("part")) - 1)
    return rows.select("doc_id", "kind", "ordinal", header_variant(F.col("ordinal"), F.col("text")).alias("variant"), "text", "paragraphs", "tables")


def watermark_probe(parts_text: DataFrame) -> DataFrame:
    """doc_id, part, found of headers and footers whose raw text speaks of a watermark."""
    rows = parts_text.where(S.contains_ignoring_case(F.col("raw"), "watermark"))
    found = F.filter(F.array(F.when(F.col("raw").contains("PowerPlusWaterMarkObject"), "text-watermark"), F.when(F.col("raw").contains("imagedata"), "image-watermark")), lambda x: x.isNotNull())
    return rows.select("doc_id", "part", found.alias("found"))


def content_controls(nodes: DataFrame) -> DataFrame:
    """doc_id, ordinal, title, type, tag, id, items of structured document tags."""
    heads = named(nodes, "sdt", part=B.MAIN).select(*KEY, "pre")
    holder = named(nodes, "sdtPr", part=B.MAIN).select(*KEY, F.col("pre").alias("parent"), F.col("parent").alias("sdt"))
    inner = named(nodes, "alias", "tag", "id", *CONTROLS, part=B.MAIN).join(holder, [*KEY, "parent"])
    kind = F.lit("unknown")
    for name, called in reversed(CONTROLS.items()):
        kind = F.when(_has(name), called).otherwise(kind)
    props = inner.groupBy(*KEY, F.col("sdt").alias("pre")).agg(S.non_blank(_value("alias")).alias("alias"), S.non_blank(_value("tag")).alias("tag"), _value("id").alias("id"), kind.alias("type"))
    items = below(nodes, "listItem", of=["sdt"]).groupBy(*KEY, F.col("head").alias("pre")).agg(F.count("*").alias("items"))
    rows = heads.join(props, [*KEY, "pre"], "left").join(items, [*KEY, "pre"], "left").withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")))
    return rows.select("doc_id", "ordinal", F.coalesce("alias", "tag", F.concat(F.lit("Control "), "ordinal")).alias("title"), F.coalesce("type", F.lit("unknown")).alias("type"), "tag", "id", F.coalesce("items", F.lit(0)).alias("items"))


def math_zones(nodes: DataFrame) -> DataFrame:
    """doc_id, ordinal, counts (of fractions, radicals, sub- and superscripts, sums, matrices, those above 0), text (80 characters)."""
    heads = named(nodes, "oMath", part=B.MAIN).select(*KEY, "pre")
    names = ["f", "rad", "sSub", "sSup", "nary", "m"]
    inner = below(nodes, *names, of=["oMath"]).groupBy(*KEY, F.col("head").alias("pre")).agg(F.concat_ws(", ", *(F.when(F.count_if(F.col("name") == n) > 0, F.concat(F.lit(f"{n}="), F.count_if(F.col("name") == n))) for n in names)).alias("counts"))
    texts = nodes.where("kind = 'text'").select(*KEY, F.col("pre").alias("at"), "text", F.explode(enclosing("oMath")).alias("pre")).groupBy(*KEY, "pre").agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY at)").alias("text"))
    rows = heads.join(inner, [*KEY, "pre"], "left").join(texts, [*KEY, "pre"], "left")
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")).alias("ordinal"), F.coalesce("counts", F.lit("")).alias("counts"), F.left(F.coalesce("text", F.lit("")), F.lit(80)).alias("text"))


def alternate_content(nodes: DataFrame) -> DataFrame:
    """doc_id, part, ordinal, choices, has_fallback, requires (of the first choice)."""
    heads = named(nodes, "AlternateContent").select(*KEY, "pre")
    inner = named(nodes, "Choice", "Fallback").groupBy(*KEY, F.col("parent").alias("head")).agg(
        F.count_if(F.col("name") == "Choice").alias("choices"), _has("Fallback").alias("has_fallback"), F.min_by(attr("Requires"), F.when(F.col("name") == "Choice", F.col("pre"))).alias("requires")
    )
    rows = heads.join(inner.withColumnRenamed("head", "pre"), [*KEY, "pre"], "left")
    return rows.select(*KEY, F.row_number().over(Window.partitionBy(*KEY).orderBy("pre")).alias("ordinal"), F.coalesce("choices", F.lit(0)).alias("choices"), F.coalesce("has_fallback", F.lit(False)).alias("has_fallback"), "requires")


def images(nodes: DataFrame, rels: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, pre, uri, alt, ext of embedded pictures whose bytes are in the package."""
    blips = named(nodes, "blip", part=B.MAIN).select(*KEY, "pre", attr("embed").alias("rel_id")).join(rels, [*KEY, "rel_id"])
    rows = blips.withColumn("media", resolve_target(F.col("part"), F.col("target"))).join(parts.select("doc_id", F.col("part").alias("media")), ["doc_id", "media"], "left_semi")
    ext = F.coalesce(F.nullif(F.lower(F.regexp_extract("media", r"\.([^./]*)$", 1)), F.lit("")), F.lit("png"))
    return rows.select("doc_id", "pre", F.concat("doc_id", F.lit("#"), "media").alias("uri"), F.lit("Document Image").alias("alt"), ext.alias("ext"))


#: What drawings() reads below a drawing, and places (packages.shred) of it and of what accessibility() reads.
GROUPS, BOXES = ["grpSp", "group"], ["txbx", "txbxContent", "textbox"]
DRAWN = ["extent", "docPr", "positionH", "positionV", "xfrm", "chart", "relIds", *GROUPS, *BOXES, *(n for n, _ in EFFECTS), *(n for n, _ in WRAPS)]
DRAWING_PLACES = f"(document/)?(.+/)?(inline|anchor)(/(.+/)?({'|'.join(DRAWN)}))?"
DESCRIBED_PLACES = "(.+/)?docPr"
#: Places of what images() and relationships() read.
IMAGE_PLACES = "(.+/)?(blip|Relationship)"


def drawings(nodes: DataFrame) -> DataFrame:
    """doc_id, pre, kind, width, height, alt, title, position_x and position_y (what an anchor's place is relative to), wrap, rotation, effects, has_chart, has_smart_art, grouped, has_text of inline and anchored drawings.

    One scan: a drawing is a row of its own group. Of one that has none of what is asked for, the flags are null.
    """
    is_head, boxes = F.col("name").isin("inline", "anchor"), BOXES
    own = F.when(is_head, F.array("pre")).otherwise(F.array().cast("array<int>"))
    rows = named(nodes, "inline", "anchor", *DRAWN, part=B.MAIN).withColumn("head", F.explode(F.concat(enclosing("inline", "anchor"), own)))
    of_head = lambda x: F.max(F.when(F.col("pre") == F.col("head"), x))
    rot = F.when(~is_head, attr("rot"))
    turned = F.min_by(rot, F.when(rot.isNotNull(), F.col("pre")))
    rows = rows.groupBy(*KEY, F.col("head")).agg(
        of_head(F.col("name")).alias("kind"), of_head(attr("behindDoc").isNotNull()).alias("behind"), (F.count_if(~is_head) > 0).alias("some"),
        _value("extent", "cx").try_cast("long").alias("width"), _value("extent", "cy").try_cast("long").alias("height"), _value("docPr", "descr").alias("alt"), _value("docPr", "title").alias("title"),
        _value("positionH", "relativeFrom").alias("position_x"), _value("positionV", "relativeFrom").alias("position_y"), F.coalesce(F.bool_or(F.col("qname").isin("wps:grpSp", "v:group")), F.lit(False)).alias("grouped"), F.coalesce(F.bool_or(F.col("name").isin(boxes)), F.lit(False)).alias("has_text"),
        (S.to_int(turned) / 60000).cast("int").alias("rotation"), *(_has(n).alias(n) for n in ("chart", "relIds")), *(_has(n).alias(f"e_{n}") for n, _ in EFFECTS), *(_has(n).alias(f"w_{n}") for n, _ in WRAPS),
    )
    rows = rows.withColumnRenamed("head", "pre").withColumns({c: F.when(F.col("some"), F.col(c)) for c in ("chart", "relIds", "grouped", "has_text")})
    wrap = F.lit("floating")
    for name, label in reversed(WRAPS):
        wrap = F.when(F.col("behind") if name == "behindDoc" else F.coalesce(F.col(f"w_{name}"), F.lit(False)), label).otherwise(wrap)
    effects = F.filter(F.array(*(F.when(F.col(f"e_{n}"), label) for n, label in EFFECTS)), lambda x: x.isNotNull())
    return rows.select("doc_id", "pre", "kind", "width", "height", "alt", "title", "position_x", "position_y", F.when(F.col("kind") == "inline", "inline").otherwise(wrap).alias("wrap"), "rotation", effects.alias("effects"), F.col("chart").alias("has_chart"), F.col("relIds").alias("has_smart_art"), "grouped", "has_text")


def legacy_pictures(nodes: DataFrame) -> DataFrame:
    """doc_id, pre, kind, inline, alt, wrap of VML pictures; alt is "" without an alternative text."""
    heads = named(nodes, "pict", part=B.MAIN).select(*KEY, "pre")
    alts = nodes.where("kind = 'elem'").select(*KEY, F.col("pre").alias("at"), F.explode(enclosing("pict")).alias("pre"), attr("alt").alias("alt")).where("alt is not null")
    rows = heads.join(first_per(alts, [*KEY, "pre"], "at"), [*KEY, "pre"], "left")
    return rows.select("doc_id", "pre", F.lit("pict").alias("kind"), F.lit(True).alias("inline"), F.coalesce("alt", F.lit("")).alias("alt"), F.lit("legacy-vml").alias("wrap"))


def outer_xml(nodes: DataFrame, name: str, length: int) -> DataFrame:
    """doc_id, part, pre, xml: the first characters of the markup of each element of that name in the main part.

    It is written anew from the nodes: qualified names, attributes by name, no declarations of
    namespaces. A start tag or an end tag has three characters or more and texts stand between
    tags, so the first `length` nodes are enough.
    """
    own = F.when(F.col("name") == name, F.array("pre")).otherwise(F.array().cast("array<int>"))
    inside = nodes.where(F.col("part") == B.MAIN).withColumn("head", F.explode(F.concat(enclosing(name), own))).where(F.col("pre") < F.col("head") + length)
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), S.escaped(e["value"]), F.lit('"'))), "")
    start = F.concat(F.lit("<"), "qname", F.coalesce(attrs, F.lit("")), F.when(F.col("post") == F.col("pre"), "/>").otherwise(">"))
    here = F.struct(F.col("pre").alias("at"), F.lit(0).alias("turn"), F.lit(0).alias("rank"), F.when(F.col("kind") == "text", S.escaped(F.col("text"))).otherwise(start).alias("x"))
    end = F.when((F.col("kind") == "elem") & (F.col("post") > F.col("pre")), F.struct(F.col("post").alias("at"), F.lit(1).alias("turn"), (-F.col("pre")).alias("rank"), F.concat(F.lit("</"), "qname", F.lit(">")).alias("x")))
    marks = inside.select(*KEY, "head", F.explode(F.array_compact(F.array(here, end))).alias("m"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["x"]), "")
    return marks.groupBy(*KEY, F.col("head").alias("pre")).agg(F.left(whole, F.lit(length)).alias("xml"))


def ole_objects(nodes: DataFrame) -> DataFrame:
    """doc_id, pre, kind, prog_id, shape_id, description (the first 200 characters of its markup) of embedded objects."""
    heads = named(nodes, "object", part=B.MAIN).select(*KEY, "pre", attr("dxaOrig").alias("shape_id"))
    inner = below(nodes, "OLEObject", of=["object"]).groupBy(*KEY, F.col("head").alias("pre")).agg(F.max(attr("ProgID")).alias("prog_id"))
    rows = heads.join(inner, [*KEY, "pre"], "left").join(outer_xml(nodes, "object", 200), [*KEY, "pre"], "left")
    return rows.select("doc_id", "pre", F.lit("ole-object").alias("kind"), F.coalesce("prog_id", F.lit("")).alias("prog_id"), "shape_id", F.col("xml").alias("description"))


def watermarks(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """doc_id, part, pre, kind, target of headers' and footers' watermarks: shapes that are named so, and pictures with their targets (the id where it leads nowhere)."""
    own = nodes.where((F.col("kind") == "elem") & F.col("part").rlike("^word/(header|footer)[^/]*\\.xml$"))
    named_so = S.contains_ignoring_case(F.concat_ws(" ", attr("id"), attr("spid"), attr("type")), "watermark")
    shapes = own.where((F.col("name") == "shape") & named_so).select(*KEY, "pre", F.lit("shape").alias("kind"), attr("id").alias("target"))
    pictures = own.where("name = 'imagedata'").select(*KEY, "pre", attr("id").alias("rel_id")).join(rels, [*KEY, "rel_id"], "left")
    return shapes.unionByName(pictures.select(*KEY, "pre", F.lit("image").alias("kind"), F.coalesce("target", "rel_id").alias("target")))
