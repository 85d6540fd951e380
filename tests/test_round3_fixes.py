"""What the findings of round 3 asked for."""

import os

import pytest

from docflow.plans import catalogue
from docflow.plans import fixtures as X
from docflow.plans import package_queries
from docflow.sources import archives as A
from docflow.sources import packages as P
from docflow.streaming import streams

SF = "/root/testdata/sf0.001"


def test_packages_of_small_rows_are_made_by_many_tasks(spark):
    for name in ("sect", "meta"):
        parts = X.parts_of(spark, SF, name)
        assert parts.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
        assert parts.where("part like 'word/%' or part like 'docProps/%'").count() == parts.count() > 0


def test_a_part_has_its_own_place_and_condition(spark):
    parts = package_queries.fx_edge(spark, SF).where("doc_id in ('1', '4')").select("doc_id", "entry_seq", "part").collect()
    assert {r.part for r in parts if r.doc_id == "4"} - {r.part for r in parts if r.doc_id == "1"} == {"word/vbaProject.bin", "word/embeddings/e.xml"}
    assert all(r.entry_seq == 1 for r in parts if r.part == "word/vbaProject.bin")


def test_a_broken_part_leaves_its_neighbours(spark):
    good = "<a xmlns:w='u' w:z='1' w:b='2'>t<w:c/><![CDATA[<u>]]></a>"
    texts = [good, "<a><b x='1'>", good, "", "<a>" + "<b/>" * 40_000, good]
    nodes = P.shred(spark.createDataFrame([(str(i), 0, "p.xml", x) for i, x in enumerate(texts)], "doc_id string, entry_seq int, part string, content string").coalesce(1)).orderBy("doc_id", "pre").collect()
    assert [r.doc_id for r in nodes] == ["0"] * 4 + ["2"] * 4 + ["5"] * 4
    for at in (0, 4, 8):
        assert [tuple(r)[2:] for r in nodes[at : at + 4]] == [
            (0, 3, None, 0, "elem", "a", None, "a", {"w:b": "2", "w:z": "1"}, None, [], ""), (1, 1, 0, 1, "text", None, None, None, None, "t", [0], "a"),
            (2, 2, 0, 1, "elem", "c", "u", "w:c", {}, None, [0], "a"), (3, 3, 0, 1, "text", None, None, None, None, "<u>", [0], "a"),
        ]


def test_a_table_of_many_files_is_one_row(spark, tmp_path):
    for name in os.listdir(SF):
        os.symlink(f"{SF}/{name}", tmp_path / name)
    os.remove(tmp_path / "documents.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in catalogue.queries()["src_01_read_corpus"](spark, str(tmp_path)).collect()}
    assert got == {(f, "parquet", True) for f in os.listdir(SF)}


def test_files_that_arrive_as_one_are_unpacked_by_many_tasks(spark):
    batch = X.fx_files(spark, SF).coalesce(1)
    assert streams.dealt(batch).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert streams.dealt(batch).count() == batch.count() > 0


def test_parts_taken_together_have_the_parsers_nodes():
    plain = ['<a xmlns="u" xmlns:w="v" w:z="1" b="&lt;&#65;">t&amp;u<w:c/> <w:d w:q="2"  r = "x"></w:d >é<e>1</e>\n</a>\n', '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<a><b>1</b><b/><b><c>2</c></b></a>', '<a xmlns:x="1&amp;2"><x:b xml:space="preserve"> </x:b></a>']
    odd = ['<a><b x=">"/>t</a>', "<a><!-- c -->x</a>", "<a><![CDATA[<u>]]></a>", '<a><b xmlns:z="q"><z:c/></b></a>', "<a b='1'/>", '<a b="1\n2"/>', "<a>\r\n</a>", "<a></b>", "<w:a/>", ""]
    tags, nodes, rows = P._Tags(), P._Nodes(), []
    for i, xml in enumerate(plain + odd):
        assert tags.add(str(i), "p.xml", xml.encode()) == (i < len(plain)), xml
        for batch in P._fed(nodes, str(i), "p.xml", xml.encode()):
            rows += batch.to_pylist()
    rows += nodes.batch().to_pylist()
    own = sorted((r for r in rows if int(r["doc_id"]) < len(plain)), key=lambda r: (r["doc_id"], r["pre"]))
    assert tags.batch().to_pylist() == own and len(own) == 19


def test_a_move_that_fails_takes_all_files_back(spark, tmp_path):
    names = [f"f{i}" for i in range(20)] + ["a/b", "a"]  # a can't be a folder and a file
    rows = spark.createDataFrame([(n, bytearray(b"x")) for n in names], "name string, content binary").coalesce(1)
    with pytest.raises(Exception):  # noqa: B017
        A.write_files(rows, str(tmp_path / "out"))
    assert not [f for f in (tmp_path / "out").rglob("*") if f.is_file()]


def test_packages_end_where_the_next_document_begins(spark):
    names = [(d, i, f"p{i}.xml", f"{d}-{i}") for d in ("b", "a", None, "c") for i in (2, 0, 1)]
    parts = spark.createDataFrame(names, "doc_id string, entry_seq int, part string, content string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # packages cross batches
    try:
        files = P.packed(parts)
        got = {(r.doc_id, r.entry_seq, r.part, bytes(r.content).decode()) for r in P.explode_parts(files).collect()}
        assert files.count() == 4 and P.packed(parts.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(d, i, p, x.replace("None", str(d))) for d, i, p, x in names}
    assert "FlatMapGroups" not in files._jdf.queryExecution().toString()  # a group a document costs more than a small document


def test_made_packages_are_parsed_once(spark):
    found = catalogue.queries()["snk_02_exported_pictures"](spark, SF)
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
