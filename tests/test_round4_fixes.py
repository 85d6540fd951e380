"""What the findings of round 4 asked for."""

import os
import re

import pytest
from pyspark.sql import functions as F

from docflow.operators import body as B
from docflow.plans import catalogue
from docflow.plans import fixtures as X
from docflow.sources import packages as P
from docflow.streaming import streams

SF = "/root/testdata/sf0.001"


def told(spark, folder, name):
    """What a query and its SQL give over a folder of tables."""
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(folder):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}{'/*.parquet' if os.path.isdir(f'{folder}/{f}') else ''}'")
    got = catalogue.queries()[name](spark, str(folder))
    columns = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    return sorted(str(tuple(r)) for r in got.select(*columns).collect()), sorted(map(str, want))


@pytest.fixture(scope="module")
def blank(spark, tmp_path_factory):
    """The smallest tables with documents that have blank lines: alone, at heads, in lists, at page breaks."""
    folder = tmp_path_factory.mktemp("blank")
    for name in os.listdir(SF):
        if name != "documents.parquet":
            os.symlink(f"{SF}/{name}", folder / name)
    lines = lambda n, blanks, said="": "\n".join(said if k in blanks else f"line {k} of it" for k in range(n))
    texts = ["", " ", "a\n\nb", lines(60, {0, 5, 19, 25, 39, 40, 45, 59}), "\n" * 45, lines(41, {10, 21, 32}, "  "), lines(41, {19, 39, 40}, " "), lines(50, ())]
    rows = [(i + 1, text, "en", "s", len(text)) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(folder / "documents.parquet"))
    return folder


BLANK = [
    "doc_09_heading_or_paragraph", "elm_08_edit_log", "elm_08_rejected_edits", "elm_08_apply_edits", "elm_09_element_counts", "snk_01_text_files", "snk_01_write_text", "doc_38_document_elements", "elm_01_of_type", "elm_02_to_plain_text",
    "elm_03_extract_all_text", "elm_05_outline", "elm_10_flatten_spans", "snk_02_export_docx", "snk_02_exported_spans", "snk_02_exported_styles", "snk_03_export_odt", "str_01_stream_corpus", "str_01_stream_documents",
]


@pytest.mark.parametrize("name", BLANK)
def test_a_blank_line_is_an_element(spark, blank, name):
    got, want = told(spark, blank, name)
    assert got == want and want


def test_files_without_bytes_are_read_where_asked_for(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "_hidden").mkdir()
    for name, body in (("one.txt", "x"), ("none.txt", ""), ("a/none.txt", ""), ("a/b/none.txt", ""), ("a/none.bin", ""), ("_hidden/none.txt", "")):
        (tmp_path / name).write_text(body)
    rows = P.read_corpus(spark, str(tmp_path), "*.txt", empty=True).select(F.substring_index("doc_id", str(tmp_path), -1), "filename", "length", F.octet_length("content"), F.col("modified").isNotNull()).collect()
    assert sorted(map(tuple, rows)) == [("/a/b/none.txt", "none.txt", 0, 0, True), ("/a/none.txt", "none.txt", 0, 0, True), ("/none.txt", "none.txt", 0, 0, True), ("/one.txt", "one.txt", 1, 1, True)]
    assert {r.doc_id.split(str(tmp_path))[0] for r in P.read_corpus(spark, str(tmp_path), "*.txt", empty=True).collect()} == {"file:"}


@pytest.mark.parametrize("places", ["a/b(/c)?", "a/b/#text|a/d/b", "a/d/b/#text", "nothing", "a"])
def test_nodes_at_asked_places_are_those_of_all(places):
    xml = b'<w:a xmlns:w="u"><w:b w:x="1">t<w:c>u&amp;</w:c>v</w:b><w:b/><w:d><w:b>q</w:b></w:d></w:a>'
    tags, nodes, whole = P._Tags(places), P._Nodes(places), P._Tags()
    for i in range(3):
        assert tags.add(str(i), "p.xml", xml) and whole.add(str(i), "p.xml", xml) and not list(P._fed(nodes, str(i), "p.xml", xml))
    want = [r for r in whole.batch().to_pylist() if re.fullmatch(places, "/".join(filter(None, (r["path"], r["name"] or P.TEXT))))]
    assert tags.batch().to_pylist() == want == sorted(nodes.batch().to_pylist(), key=lambda r: (r["doc_id"], r["pre"]))
    assert bool(want) == (places != "nothing")


def test_tables_are_read_once(spark):
    X._kept.clear()
    for name in ("doc_28_table_has_header", "doc_29_table_metadata", "doc_29_table_margins", "doc_30_cell_metadata"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and plan.count("Join") == 1, name  # the join is the fixture's
    assert not X._kept
    for name in ("doc_27_table_rows", "doc_28_table_has_header", "doc_29_table_metadata", "doc_29_table_margins", "doc_30_cell_metadata"):
        got, want = told(spark, SF, name)
        assert got == want and want, name


def test_tables_with_lists_links_and_inner_tables(spark):
    w = 'xmlns:w="w"'
    run, num = (lambda x: f"<w:r>{x}</w:r>"), '<w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr>'
    inner = f"<w:tbl><w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc><w:p>{run('<w:t>in</w:t>')}</w:p></w:tc></w:tr></w:tbl>"
    first = f"<w:tc><w:p>{num}{run('<w:t>a</w:t><w:tab/>')}<w:hyperlink>{run('<w:t>b</w:t>')}</w:hyperlink></w:p><w:p/>{inner}<w:p>{run('<w:t>c</w:t><w:br/>')}</w:p></w:tc><w:tc/>"
    body = f"<w:tbl/><w:tbl><w:tr/><w:tr>{first}</w:tr></w:tbl><w:p/><w:tbl><w:tr><w:tc>{inner}</w:tc></w:tr></w:tbl>"
    numbering = f'<w:numbering {w}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/><w:lvlText w:val="%1"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>'
    rows = [("d", 0, "word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>"), ("d", 1, "word/numbering.xml", numbering)]
    nodes = P.stored(P.shred(spark.createDataFrame(rows, "doc_id string, entry_seq int, part string, content string")))
    assert sorted((r.tbl, r.rows) for r in B.table_rows(nodes).collect()) == [(1, [["%1. a\tb\n\nc\n", ""]]), (2, [[""]])]
    assert sorted((r.tbl, r.row, r.col, r.text, r.nested) for r in B.cells(nodes).collect()) == [(1, 1, 0, "%1. a\tb\n\nc\n", 1), (1, 1, 1, "", 0), (2, 0, 0, "", 1)]
    assert sorted((r.tbl, r.has_header) for r in B.table_metadata(nodes).collect()) == [(0, False), (1, False), (2, True)]


def test_drawings_are_read_once(spark):
    X._kept.clear()
    for name in ("edg_06_accessibility", "doc_22_rotation"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan, name
        got, want = told(spark, SF, name)
        assert got == want and want, name
    assert not X._kept


def test_a_stream_deals_nodes_out_by_no_join(spark):
    files = X.fx_all_formats(spark, SF)
    rows, status = streams.parsed(files, lambda parts: P.stored(P.shred(parts)))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2  # an ODT file's pictures, and its elements where it can be read
    assert rows.where("doc_id like '%/97.%'").count() == 0 and {r.ok for r in status.where("doc_id like '%/97.%'").collect()} == {False}
    names = P.explode_parts(X.fx_files(spark, SF), content=False)
    assert names.where("content is not null").count() == 0 and names.select("doc_id", "entry_seq", "part", "ext").collect() == P.explode_parts(X.fx_files(spark, SF)).select("doc_id", "entry_seq", "part", "ext").collect()


def test_written_tables_are_compressed_well(spark, tmp_path):
    rows = P.written(spark.range(1000).repartition(3, "id"), str(tmp_path / "t"))
    assert rows.count() == 1000 and all(".zstd." in f for f in rows.inputFiles())


def test_pictures_are_found_without_the_other_nodes(spark):
    X._kept.clear()
    got, want = told(spark, SF, "snk_04_write_media")
    assert got == want and want
    (nodes,) = X._kept.values()
    assert {r.name for r in nodes.select("name").distinct().collect()} == {"blip", "Relationship"}
