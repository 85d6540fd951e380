"""Functions, sources and operators on cases made by hand; and all registered queries against their SQL on the smallest tables."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from docflow.functions import strings as S
from docflow.operators import body as B
from docflow.operators import catalogue as C
from docflow.operators import elements as E
from docflow.operators import marks as M
from docflow.operators import odt as O
from docflow.operators import package as G
from docflow.operators import recents as R
from docflow.operators import sinks as K
from docflow.operators import tree as T
from docflow.plans import catalogue
from docflow.sources import packages as P
from docflow.streaming import streams

SF = "/root/testdata/sf0.001"
W = 'xmlns:w="w" xmlns:r="r"'


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def nodes_of(spark, **parts):
    rows = [("d", i, name.replace("__", "/").replace("_xml", ".xml"), body.encode()) for i, (name, body) in enumerate(parts.items())]
    return P.shred(spark.createDataFrame(rows, "doc_id string, entry_seq int, part string, content binary"))


def document(spark, body, **more):
    return nodes_of(spark, word__document_xml=f"<w:document {W}><w:body>{body}</w:body></w:document>", **more)


def test_strings(spark):
    r = one(
        spark, a=S.ktrim(F.lit(" \t x y \n")), b=S.is_blank(F.lit("　 ")), c=S.to_int(F.lit("+7")), d=S.to_int(F.lit(" 7")), e=S.to_int(F.lit("99999999999")), f=S.to_float(F.lit("10.5pt")),
        g=S.after_last(F.lit("a.b.c"), "."), h=S.after_last(F.lit("abc"), ".", F.lit("")), i=S.upper_first(F.lit("xy")), j=S.joined(", ", F.lit(None).cast("string"), F.lit("a"), F.lit("b")), k=S.joined(", ", F.lit(None).cast("string"), fallback=F.lit("none")),
        m=S.nth_word(F.lit(" a  b c "), 1), n=S.drop_words(F.lit("a b c"), 1), o=S.unquoted(F.lit('"x"')), p=S.clamp(F.lit(12), 1, 9), q=S.after_first(F.lit("a=b=c"), "="),
    )
    assert tuple(r) == ("x y", True, 7, None, None, 10.5, "c", "", "Xy", "a, b", "none", "b", "b c", "x", 9, "b=c")


def test_shred_keeps_intervals_and_drops_broken_parts(spark):
    n = nodes_of(spark, a_xml="<a><b>x<!-- c --><![CDATA[<y>]]></b><c/></a>", b_xml="<a><b></a>")
    rows = {(r.part, r.pre): r for r in n.collect()}
    assert {p for p, _ in rows} == {"a.xml"}
    assert [(r.name, r.text, r.post, list(r.anc)) for _, r in sorted(rows.items())] == [("a", None, 3, []), ("b", None, 2, [0]), (None, "x<y>", 2, [0, 1]), ("c", None, 3, [0])]
    inner = T.descendants(T.named(n, "a"), n, of=["a"]).select("name").collect()
    assert sorted(r.name for r in inner) == ["b", "c"]


@pytest.mark.parametrize(("part", "target", "want"), [("word/document.xml", "media/x.png", "word/media/x.png"), ("word/document.xml", "../media/x.png", "media/x.png"), ("word/document.xml", "/word/x.png", "word/x.png"), ("a.xml", "../../x", "x"), ("w/a.xml", "./x", "w/x")])
def test_resolve_target(spark, part, target, want):
    assert one(spark, t=P.resolve_target(F.lit(part), F.lit(target))).t == want


def test_relationships_and_links(spark):
    rels = '<Relationships><Relationship Id="r1" Target="old"/><Relationship Id="r1" Target="mailto:a@b"/><Relationship Id=" " Target="x"/></Relationships>'
    n = document(spark, '<w:p><w:hyperlink r:id="r1" w:anchor="m"><w:r><w:t>go</w:t></w:r></w:hyperlink></w:p><w:p><w:hyperlink r:id="r9"><w:r><w:t>x</w:t></w:r></w:hyperlink></w:p>')
    n = n.unionByName(P.shred(spark.createDataFrame([("d", "word/_rels/document.xml.rels", rels.encode())], "doc_id string, part string, content binary")))
    found = P.relationships(n)
    assert [(r.part, r.rel_id, r.target) for r in found.collect()] == [("word/document.xml", "r1", "mailto:a@b")]
    links = sorted(B.hyperlinks(n, found).collect(), key=lambda r: r.p)
    assert [(r.address, r.is_email, r.is_external) for r in links] == [("mailto:a@b", True, True), (None, False, False)]


def test_fields_in_pieces(spark):
    run = lambda x: f"<w:r>{x}</w:r>"
    begin, end = run('<w:fldChar w:fldCharType="begin"/>'), run('<w:fldChar w:fldCharType="end"/>')
    instr = lambda t: run(f'<w:instrText xml:space="preserve">{t}</w:instrText>')
    n = document(spark, f"<w:p>{instr('LONE')}{begin}{instr('PAGE')}{instr('REF a')}{end}{instr('AFTER')}</w:p><w:p>{begin}{instr('IF ')}{begin}{instr('REF b')}{end}{instr(' tail')}{end}</w:p>")
    got = [(r.p, r.instruction) for r in sorted(M.complex_fields(n).collect(), key=lambda r: r.pre)]
    first, second = sorted({p for p, _ in got})
    assert got == [(first, "LONE"), (first, "PAGEREF a"), (first, "AFTER"), (second, "IF"), (second, "REF b"), (second, "tail")]
    kinds = one(spark, a=M.classify_field(F.lit("PAGEREF x")), b=M.classify_reference(F.lit("PAGEREF x")), c=M.classify_field(F.lit("zz")), d=M.classify_reference(F.lit("zz")))
    assert tuple(kinds) == ("page-number", "page-reference", "field", None)
    refs = M.references(document(spark, f'<w:p><w:fldSimple w:instr="REF a"/><w:fldSimple w:instr="REF a"/></w:p><w:p>{instr("REF a")}</w:p>')).collect()
    assert [(r.kind, r.summary, r.total) for r in refs] == [("cross-reference", "REF a", 3)]


def test_notes_leave_out_separators(spark):
    note = lambda i: f'<w:footnote w:id="{i}"><w:p><w:r><w:t>n{i}</w:t></w:r></w:p><w:p/></w:footnote>'
    n = nodes_of(spark, word__footnotes_xml=f"<w:footnotes {W}>{''.join(map(note, (-1, 0, 1, 2)))}</w:footnotes>")
    assert [(r.id, r.text) for r in M.notes(n).collect()] == [(2, "n2\n")]


def test_pages_count_paragraphs_and_breaks_count_tags(spark):
    two = '<w:p><w:r><w:br w:type="page"/><w:br w:type="page"/><w:t>x</w:t></w:r></w:p>'
    n = document(spark, two)
    assert M.page_layout(n).first().pages == 2 and B.page_breaks(n).count() == 2


def test_odt_keeps_its_quirks(spark):
    ns = 'xmlns:office="o" xmlns:text="t" xmlns:table="tb" xmlns:draw="d" xmlns:xlink="x"'
    body = '<text:list><text:list-item><text:p>in list<draw:frame><draw:image xlink:href="Pictures/a.png"/></draw:frame></text:p></text:list-item></text:list><text:p/><text:p><text:span>a</text:span> <text:span>b</text:span></text:p><draw:frame><draw:image xlink:href="Pictures/a.png"/></draw:frame><table:table><table:table-row><table:table-cell><table:table><table:table-row><table:table-cell><text:p>inner</text:p></table:table-cell></table:table-row></table:table></table:table-cell></table:table-row></table:table>'
    n = nodes_of(spark, content_xml=f"<office:document-content {ns}><office:body><office:text>{body}</office:text></office:body></office:document-content>")
    assert [r.name for r in sorted(O.odt_body(n).collect(), key=lambda r: r.ord)] == ["p", "p", "p", "frame", "table"]
    assert [(r.ord, r.text) for r in sorted(O.odt_spans(n).collect(), key=lambda r: (r.ord, r.i))] == [(0, "in list"), (2, "a"), (2, "b")]
    assert O.odt_tables(n).first().rows == [["inner", "inner"], ["inner"]] or O.odt_tables(n).first().rows == [["inner"], ["inner"]]
    parts = spark.createDataFrame([("d", "Pictures/a.png")], "doc_id string, part string")
    assert [(r.ord, r.uri) for r in O.odt_images(n, parts).collect()] == [(3, "d#Pictures/a.png")]


def test_colors(spark):
    r = one(spark, a=E.parse_color(F.lit("#00FF00")), b=E.parse_color(F.lit("8000FF00")), c=E.parse_color(F.lit("red")), d=E.parse_color(F.lit("12345G")))
    assert tuple(r) == (0xFF00FF00, 0x8000FF00, 0xFF000000, 0xFF000000)


def test_recents_json_fills_what_is_absent(spark):
    r = one(spark, a=R.from_json(F.lit('[{"uri":"u"}]')), b=R.from_json(F.lit(None).cast("string")))
    assert [(x.uri, x.file_name, x.file_size) for x in r.a] == [("u", "", 0)] and r.b == []


def test_files_and_streams(spark, tmp_path):
    import zipfile

    for i in (1, 2):
        with zipfile.ZipFile(tmp_path / f"f{i}.docx", "w") as z:
            z.writestr("word/document.xml", f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="heading{i}"/></w:pPr><w:r><w:t>Head {i}</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "bad.docx").write_bytes(b"no package")
    (tmp_path / "t.txt").write_text("plain")
    files = P.read_corpus(spark, str(tmp_path))
    assert {r.filename: r.format for r in files.select("filename", "format").collect()} == {"f1.docx": "docx", "f2.docx": "docx", "bad.docx": "docx", "t.txt": "txt"}
    nodes = P.shred(P.explode_parts(files))
    assert sorted(r.entry for r in E.outline(E.document_elements(nodes)).collect()) == ["  - Head 2", "- Head 1"]
    status = P.parse_status(files, nodes)
    assert {r.doc_id.rsplit("/", 1)[1]: r.ok for r in status.collect()} == {"f1.docx": True, "f2.docx": True, "bad.docx": False, "t.txt": True}
    with pytest.raises(Exception, match="Failed to open file"):
        P.fail_fast(status).collect()
    got = []
    streams.stream_corpus(spark, str(tmp_path), "*.docx", str(tmp_path / "c1"), lambda df, _: got.extend(r.text for r in df.collect())).awaitTermination()
    assert sorted(got) == ["Head 1", "Head 2"]
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    accesses = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")).selectExpr("cast(user_id as string) uri", "ts last_accessed")
    newest = []
    streams.stream_recents(accesses, str(tmp_path / "c2"), lambda df, _: newest.append([r.uri for r in df.collect()])).awaitTermination()
    rows = spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").agg(F.max("ts").alias("t")).orderBy(F.desc("t")).limit(5)
    assert newest[-1] == [str(r.user_id) for r in rows.collect()]


def test_whole_document_in_reading_order(spark):
    run = lambda text: f"<w:r><w:t>{text}</w:t></w:r>"
    body = f'<w:p><w:bookmarkStart w:id="4" w:name="here"/><w:fldSimple w:instr="REF here">{run("see")}</w:fldSimple><w:bookmarkEnd w:id="4"/><w:r><w:pict><w:v alt="old"/></w:pict><w:br w:type="page"/></w:r></w:p><w:tbl><w:tr><w:tc><w:p>{run("cell")}</w:p></w:tc></w:tr></w:tbl><w:sectPr/>'
    side = {"word__header1_xml": f"<w:hdr {W}><w:p>{run('top')}</w:p></w:hdr>", "word__footer1_xml": f"<w:ftr {W}><w:p>{run('foot')}</w:p></w:ftr>", "word__comments_xml": f'<w:comments {W}><w:comment w:id="1" w:author="A"><w:p>{run("said")}</w:p></w:comment></w:comments>'}
    side |= {f"word__{k}s_xml": f'<w:{k}s {W}><w:{k} w:id="2"><w:p>{run(k)}</w:p></w:{k}></w:{k}s>' for k in ("endnote", "footnote")}
    nodes = P.stored(document(spark, body, **side))
    parts = nodes.select("doc_id", "part").distinct().withColumn("content", F.lit("x"))
    rows = C.whole_document(nodes, parts).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(len(rows)))
    assert [(r.type, r.kind, r.name, r.text) for r in rows if r.type not in ("metadata", "section")] == [
        ("header_footer", "header", "primary", "top"), ("header_footer", "footer", "primary", "foot"), ("note", "footnote", "2", "footnote"), ("note", "endnote", "2", "endnote"), ("comment", None, "A", "said"),
        ("bookmark", "start", "here", None), ("bookmark", "end", "", None), ("field", "variable-ref", None, "REF here"), ("drawing", "pict", None, None), ("paragraph", None, None, "see"), ("page_break", None, None, None), ("table", None, None, None),
    ]
    assert [(r.kind, r.summary) for r in rows if r.type == "metadata"] == [("references", "1 references"), ("pagination", "estimatedPages=2")]


def test_markup_is_written_anew_up_to_a_length(spark):
    nodes = document(spark, '<w:p><w:r><w:object w:b="2" w:a="&lt;1"><w:x>a &amp; b<w:y/></w:x></w:object></w:r></w:p>')
    whole = '<w:object w:a="&lt;1" w:b="2"><w:x>a &amp; b<w:y/></w:x></w:object>'
    assert [G.outer_xml(nodes, "object", n).first().xml for n in (200, 40, 5)] == [whole, whole[:40], whole[:5]]
    assert G.ole_objects(document(spark, "<w:p/>")).count() == 0


def test_cells_with_borders_and_margins(spark):
    cell = '<w:tc><w:tcPr><w:tcBorders><w:right w:color="R"/><w:top w:color="T"/></w:tcBorders><w:tcMar><w:top w:w="5"/><w:left w:w="x"/></w:tcMar></w:tcPr><w:p/></w:tc><w:tc><w:p/></w:tc>'
    rows = sorted(B.cells(document(spark, f"<w:tbl><w:tr>{cell}</w:tr></w:tbl>")).collect(), key=lambda r: r.col)
    assert [(r.borders, r.margins and tuple(r.margins)) for r in rows] == [("top:T, right:R", (5, None, None, None)), (None, None)]


def test_media_and_edits(spark, tmp_path):
    parts = spark.createDataFrame([("d", "word/a.png", bytearray(b"1")), ("d", "word/b.png", bytearray(b"2"))], "doc_id string, part string, content binary")
    K.write_media(parts, spark.createDataFrame([("d", "d#word/b.png"), ("d", "d#none"), (None, None)], "doc_id string, uri string"), str(tmp_path / "media"))
    assert [(r.uri, bytes(r.content)) for r in spark.read.parquet(str(tmp_path / "media")).collect()] == [("d#word/b.png", b"2")]
    rows = E.document_elements(document(spark, '<w:p><w:r><w:rPr><w:color w:val="FF0000"/></w:rPr><w:t>red</w:t></w:r></w:p><w:p><w:r><w:t>x</w:t></w:r></w:p>'))
    edits = spark.createDataFrame([("d", 0, "new"), ("d", 9, "nowhere")], "doc_id string, seq int, new_text string")
    assert [(r.text, r.color) for r in E.apply_edits(rows, edits).orderBy("seq").collect()] == [("new", "FF0000"), ("x", "000000")]


def test_pages_and_sections_in_reading_order(spark):
    end = lambda x: f"<w:pPr><w:sectPr>{x}</w:sectPr></w:pPr>"
    page = '<w:r><w:br w:type="page"/></w:r>'
    body = f"<w:p>{end('<w:pgNumType w:start=\"4\"/><w:titlePg/>')}{page}</w:p><w:tbl><w:tr><w:tc><w:p>{page}{page}</w:p></w:tc></w:tr></w:tbl><w:p>{end('')}<w:r><w:lastRenderedPageBreak/></w:r></w:p><w:sectPr/>"
    rows = M.page_rows(document(spark, body)).orderBy("ordinal").collect()
    assert [(r.title, r.summary) for r in rows] == [
        ("Page 1", "start"), ("Page 2", "explicit page break"), ("Section 2", "sectionBoundary=true, pageNumberStart=4, differentFirstPage=true"), ("Page 3", "explicit page break"), ("Page 4", "explicit page break"), ("Section 3", "sectionBoundary=true"),
    ]
    assert rows[2].attributes == {"sectionIndex": "1", "pageNumberStart": "4", "differentFirstPage": "true"} and rows[3].attributes == {"pageIndex": "3"}
    assert M.page_layout(document(spark, body)).first().pages == 4
    assert [(r.title, r.summary) for r in M.page_rows(document(spark, "")).collect()] == [("Page 1", "start")]


FORMATS = '<w:rPr><w:rFonts w:ascii="Arial"/><w:b/><w:i w:val="0"/><w:u w:val="single"/><w:strike/><w:color w:val="AB12CD"/><w:spacing w:val="-3"/><w:sz w:val="31"/><w:highlight w:val="yellow"/><w:lang w:val="de-DE"/></w:rPr>'


def test_export_keeps_formats_styles_and_pictures(spark):
    first = f'<w:p><w:pPr><w:pStyle w:val="Quote"/><w:spacing w:before="1" w:after="2" w:line="360"/><w:ind w:left="3" w:right="4" w:hanging="5"/><w:jc w:val="both"/></w:pPr><w:r>{FORMATS}<w:t xml:space="preserve">a &lt;b&gt; </w:t><w:tab/><w:t>c</w:t></w:r><w:ins><w:r><w:t>plain</w:t></w:r></w:ins></w:p>'
    cells = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc><w:tc><w:tbl><w:tr><w:tc><w:p><w:r><w:t>in</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>"
    picture = lambda r: f'<w:p><w:r><w:drawing><a:blip xmlns:a="a" r:embed="{r}"/></w:drawing></w:r></w:p>'
    nodes = document(spark, f'{first}<w:p><w:pPr><w:pStyle w:val="heading2"/></w:pPr><w:r><w:t> Head </w:t></w:r></w:p>{cells}{picture("x")}{picture("y")}{picture("x")}<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
    rels = '<Relationships><Relationship Id="x" Target="media/one.JPG"/><Relationship Id="y" Target="/pics/two.webp"/></Relationships>'
    nodes = P.stored(nodes.unionByName(P.shred(spark.createDataFrame([("d", "word/_rels/document.xml.rels", rels.encode())], "doc_id string, part string, content binary"))))
    parts = spark.createDataFrame([("d", "word/media/one.JPG", bytearray(b"1")), ("d", "pics/two.webp", bytearray(b"2"))], "doc_id string, part string, content binary")
    rows = P.stored(E.document_elements(nodes, C.paragraph_level(nodes, parts)))
    media = parts.select(F.concat("doc_id", F.lit("#"), "part").alias("uri"), "content")
    made = P.stored(P.explode_parts(P.packed(K.export_docx(rows, media))))
    assert {(r.part, bytes(r.content)) for r in made.where("part like 'word/media/%'").collect()} == {("word/media/image1.jpeg", b"1"), ("word/media/image2.png", b"2")}
    again = P.stored(P.shred(made))
    assert E.flatten_spans(again).drop("doc_id").orderBy("para", "ordinal").collect() == E.flatten_spans(nodes).drop("doc_id").orderBy("para", "ordinal").collect()
    span = E.flatten_spans(again).orderBy("para", "ordinal").first()
    assert (span.text, span.font, span.bold, span.italic, span.underline, span.strikethrough, span.color, span.spacing, span.size, span.highlight, span.language) == ("a <b> \tc", "Arial", True, False, True, True, "AB12CD", -3, 15, "yellow", "de-DE")
    style = lambda n: B.blocks(n).where("name = 'p' and text like 'a <b>%'").select("style.*").first()
    assert style(again) == style(nodes) and tuple(style(nodes)) == ("Quote", "JUSTIFIED", 3, 4, None, 5, 1, 2, 360)
    found = P.stored(E.document_elements(again, C.paragraph_level(again, made))).orderBy("seq").collect()
    assert [(r.type, r.text, r.level) for r in found if r.type not in ("image", "drawing")] == [("paragraph", "a <b> \tcplain", None), ("header", "Head", 2), ("table", None, None), ("page_break", None, None)]
    assert [r.rows for r in found if r.type == "table"] == [[["1\n2", ""]]]
    assert [(r.name, r.kind) for r in found if r.type == "image"] == [("d#word/media/image1.jpeg", "jpeg"), ("d#word/media/image2.png", "png"), ("d#word/media/image1.jpeg", "jpeg")]
    assert len(P.explode_parts(P.packed(K.export_docx(rows))).where("part like 'word/%'").collect()) == 1  # without bytes no picture


def test_edits_of_one_place_and_those_left_out(spark):
    rows = E.document_elements(document(spark, '<w:p><w:r><w:rPr><w:b/><w:color w:val="FF0000"/></w:rPr><w:t>red</w:t></w:r><w:r><w:t>more</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>x</w:t></w:r></w:p>'))
    edits = spark.createDataFrame([("d", 0, 2, "second"), ("d", 0, 1, "first"), ("d", 0, 2, "second"), ("d", 1, 3, "head"), ("d", 7, 4, None)], "doc_id string, seq int, edit int, new_text string")
    done = E.apply_edits(rows, edits).orderBy("seq").collect()
    assert [(r.text, r.color) for r in done] == [("second", "FF0000"), ("x", None)]
    assert [(s.text, s.bold, s.color, s.size) for s in done[0].spans] == [("second", False, "FF0000", None)]
    left = E.rejected_edits(rows, edits).orderBy("edit").collect()
    assert [(r.edit, r.new_text, r.reason) for r in left] == [(1, "first", "stale"), (3, "head", "no paragraph"), (4, "", "out of range")]
    assert E.to_plain_text(E.apply_edits(rows, edits.limit(0))).first().text == "redmore\nx"


def test_lists_take_their_level_from_the_numbering(spark):
    item = lambda num, lvl: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{lvl}"/><w:numId w:val="{num}"/></w:numPr></w:pPr><w:r><w:t>i</w:t></w:r></w:p>'
    levels = "".join(f'<w:lvl w:ilvl="{i}"><w:numFmt w:val="{f}"/><w:lvlText w:val="%{i}"/></w:lvl>' for i, f in enumerate(("decimal", "bullet")))
    numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="7">{levels}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="1"><w:startOverride w:val="3"/></w:lvlOverride></w:num><w:num w:numId="2"><w:abstractNumId w:val="9"/></w:num></w:numbering>'
    n = P.stored(document(spark, item(1, 0) + item(1, 1) + item(2, 0) + item(-1, 0), word__numbering_xml=numbering))
    rows = B.blocks(n).orderBy("pre").collect()
    assert [(r.label, r.list and (r.list.format, r.list.level_text, r.list.start_override)) for r in rows] == [("%0.", ("decimal", "%0", None)), ("•", ("bullet", "%1", 3)), (None, None), (None, None)]
    assert [r.label for r in B.lists(n).orderBy("p").collect()] == ["%0.", "•"]


def test_a_long_part_is_shredded_in_portions():
    text = b"<a>" + b"<b><c>x</c></b>" * 60_000 + b"</a>"
    sizes = [len(rows) for rows in P._shredded("d", "p", text)]
    assert sum(sizes) == 1 + 3 * 60_000 and max(sizes) < 2 * P.WAITING
    last = [rows[-1] for rows in P._shredded("d", "p", text)][-1]
    assert last[:5] == ("d", "p", 0, 3 * 60_000, None)
    assert list(P._shredded("d", "p", text[:-1])) == []


CHEAP = ["mrk_11_page_rows", "snk_02_exported_spans", "snk_02_exported_styles", "elm_08_edit_log", "elm_08_rejected_edits", "elm_10_span_links", "doc_29_table_margins", "doc_32_section_text", "odt_02_odt_body", "odt_07_odt_tables", "nav_03_descendants", "nav_05_text_value", "doc_09_heading_or_paragraph", "src_02_infer_mime", "src_05_explode_parts", "src_11_parse_status", "doc_02_paragraph_spans", "doc_10_list_label", "doc_14_complex_fields", "doc_37_comments", "elm_02_to_plain_text", "elm_05_outline", "odt_04_odt_spans", "pkg_01_core_properties", "rec_01_upsert_recent", "mrk_03_revisions", "fn_08_non_blank_values", "fn_13_repeat_and_prefix", "src_01_read_corpus", "src_04_plain_text_elements", "nav_06_matches", "doc_20_drawings_anchored", "doc_24_legacy_pict", "doc_25_ole_objects", "odt_08_odt_images", "snk_04_write_media", "str_02_stream_recents"]


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got = catalogue.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*columns).collect())
    assert want


def test_nothing_but_the_entry_knows_the_subpackage():
    code = "import sys; sys.modules['docflow.llm'] = None\nimport docflow.plans.catalogue, docflow.streaming.streams, docflow.operators.sinks"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(__file__))).returncode == 0


@pytest.mark.parametrize(("instruction", "field", "reference"), [
    ("toc", "toc", "table-of-contents"), (" PAGEREF a", "page-number", "page-reference"), ("PAGE", "page-number", "page-number"), ("TIME", "date-time", None), ("AUTHOR", "author", None), ("TITLE", "title", None), ("mergefield a", "merge-field", "merge-field"),
    ("=1", "formula", None), ("HYPERLINK x", "hyperlink", "hyperlink-field"), ("IF a", "conditional", "conditional-field"), ("SET a", "variable-set", None), ("REF a", "variable-ref", "cross-reference"), ("SEQ a", "sequence", "caption-sequence"), ("ASK", "prompt-ask", None),
    ("FILLIN", "prompt-fillin", None), ("MACROBUTTON a", "macro-button", None), ("FORMTEXT", "form-text", None), ("FORMCHECKBOX", "form-checkbox", None), ("FORMDROPDOWN", "form-dropdown", None), ("STYLEREF a", "style-reference", None), ("XE a", "index-entry", None),
    ("TC a", "table-of-contents-entry", None), ("NOTEREF a", "field", "note-reference"), ("CITATION a", "field", "citation"), ("BIBLIOGRAPHY", "field", "bibliography"), ("IF", "field", None),
])
def test_classes_of_instructions(spark, instruction, field, reference):
    row = spark.range(1).select(M.classify_field(F.lit(instruction)).alias("f"), M.classify_reference(F.lit(instruction)).alias("r")).first()
    assert (row.f, row.r) == (field, reference)


def test_fields_have_values_and_stray_texts_stand_alone(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = '<w:r><w:instrText>PAGE</w:instrText><w:instrText> </w:instrText><w:instrText>REF a</w:instrText></w:r>'
    field = '<w:r><w:fldChar w:fldCharType="Begin"/><w:instrText>IF</w:instrText></w:r><w:r><w:instrText> b</w:instrText><w:fldChar w:fldCharType="END"/></w:r>'
    simple = '<w:fldSimple w:instr="SEQ x"><w:fldData>7</w:fldData></w:fldSimple>'
    xml = f"<w:document {w}><w:body><w:p>{simple}{run}{field}<w:r><w:t>shown</w:t></w:r></w:p></w:body></w:document>"
    nodes = P.stored(P.shred(spark.createDataFrame([("a", 0, "word/document.xml", xml)], "doc_id string, entry_seq int, part string, content string")))
    rows = sorted(M.fields(nodes).collect(), key=lambda r: r.ordinal)
    assert [(r.instruction, r.value, r.source) for r in rows] == [("SEQ x", "7", "fldSimple"), ("PAGE", "shown", "instrText"), ("REF a", "shown", "instrText"), ("IF b", "shown", "instrText")]
    assert rows[3].type == "conditional" and rows[3].arguments == {"condition": "b"}
