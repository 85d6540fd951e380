"""Packages and files as data sources, stored recents with several writers, and streams that are repeated or stopped."""

import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringContains, StringEndsWith, StringStartsWith

from docflow.operators import recents as R
from docflow.operators import sinks as K
from docflow.sources import archives as A
from docflow.sources import packages as P
from docflow.streaming import streams

W = 'xmlns:w="w"'


def docx(path, text, **more):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>")
        for name, body in more.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)


def odt(path, body):
    ns = 'xmlns:office="o" xmlns:text="t" xmlns:table="tb" xmlns:draw="d" xmlns:xlink="x" xmlns:dc="dc"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("content.xml", f"<office:document-content {ns}><office:body><office:text>{body}</office:text></office:body></office:document-content>")
        z.writestr("meta.xml", f"<office:document-meta {ns}><dc:title>T</dc:title></office:document-meta>")
        z.writestr("Pictures/a.png", b"x")


@pytest.mark.parametrize(("tests", "want"), [([EqualTo(("part",), "word/styles.xml")], {"word/styles.xml"}), ([StringStartsWith(("part",), "word/"), StringEndsWith(("part",), "s.xml")], {"word/styles.xml"}), ([In(("part",), ("a", "x.bin"))], {"x.bin"})])
def test_only_wanted_entries_are_inflated(tmp_path, monkeypatch, tests, want):
    for i in range(3):
        docx(tmp_path / f"{i}.docx", "x", word__styles_xml="<s/>", **{"x.bin": "0" * 1000})
    opened = []
    plain = zipfile.ZipFile.open
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, e, *a, **b: opened.append(e.filename) or plain(self, e, *a, **b))
    reader = A.PackageReader({"path": str(tmp_path)})
    kept = StringContains(("part",), "w")
    assert list(reader.pushFilters([*tests, kept])) == [kept]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert {r["part"] for r in rows} == set(opened) == want and len(rows) == len(opened) == 3


def test_partitions_by_size_and_files_that_fail(spark, tmp_path):
    for i in range(5):
        docx(tmp_path / f"{i}.docx", "x" * 10 * i, **{"big.bin": "0" * 5000})
    (tmp_path / "bad.docx").write_bytes(b"PK no package")
    (tmp_path / "t.txt").write_text("plain")
    size = (tmp_path / "0.docx").stat().st_size
    parts = A.PackageReader({"path": str(tmp_path), "pattern": "*.docx", "splitbytes": str(2 * size + 200)}).partitions()
    assert sum(len(p.paths) for p in parts) == 6 and max(len(p.paths) for p in parts) <= 3 and len(parts) >= 3
    rows = A.read_packages(spark, str(tmp_path), "*.docx", maxBytes=4000).collect()
    assert {(r.doc_id.rsplit("/", 1)[1], r.part) for r in rows if r.error} == {*((f"{i}.docx", "big.bin") for i in range(5)), ("bad.docx", None)}
    assert all(r.content is None for r in rows if r.error) and all(r.content for r in rows if not r.error)
    one = A.read_packages(spark, str(tmp_path / "1.docx")).where("part = 'word/document.xml'")
    assert [bytes(r.content).count(b"x" * 10) for r in one.collect()] == [1]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")  # the source has taken the condition


def test_files_are_written_all_or_none(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i % 2}/f{i}.bin", bytearray(str(i).encode())) for i in range(20)], "name string, content binary").repartition(3)
    A.write_files(rows, str(tmp_path / "out"))
    there = lambda: {str(f.relative_to(tmp_path / "out")): f.read_bytes() for f in (tmp_path / "out").rglob("*") if f.is_file()}
    assert there() == {f"d{i % 2}/f{i}.bin": str(i).encode() for i in range(20)}
    for bad in (rows.limit(1), spark.createDataFrame([("new", b""), ("new", b"")], "name string, content binary"), spark.createDataFrame([("fine", b""), ("../up", b"")], "name string, content binary"), rows.select(F.concat(F.lit("z"), "name").alias("name"), F.when(F.col("content") == b"7", F.raise_error(F.lit("lost"))).otherwise(F.col("content")).alias("content"))):
        with pytest.raises(Exception, match="name|lost"):
            A.write_files(bad, str(tmp_path / "out"))
        assert len(there()) == 20 and not [f for f in (tmp_path / "out").iterdir() if f.name.startswith("_")]
    parts = spark.createDataFrame([("file:/a/d 1.docx", "word/media/i.png", bytearray(b"p"))], "doc_id string, part string, content binary")
    K.write_media_files(parts, spark.createDataFrame([("file:/a/d 1.docx", "file:/a/d 1.docx#word/media/i.png")] * 2, "doc_id string, uri string"), str(tmp_path / "media"))
    assert [f.name for f in (tmp_path / "media").rglob("*.png")] == ["i.png"] and len(list((tmp_path / "media").iterdir())) == 1


RECENT = "uri string, file_name string, mime_type string, file_size long, last_accessed timestamp"


def accesses(spark, *rows):
    return spark.createDataFrame([(u, u, None, None, t) for u, t in rows], "uri string, file_name string, mime_type string, file_size long, at long").withColumn("last_accessed", F.timestamp_seconds("at")).drop("at")


def test_two_writers_lose_no_upsert(spark, tmp_path, monkeypatch):
    one, two = (R.RecentStore(spark, str(tmp_path / "recents"), kept=3) for _ in range(2))
    assert one.read() is None and one.version() == 0
    one.upsert(accesses(spark, ("a", 1), ("b", 2)))
    plain, met = R.RecentStore.commit, []

    def interrupted(self, rows, after, batches):
        if self is one and not met:  # the other writer commits between this one's read and its commit
            met.append(two.upsert(accesses(spark, ("c", 3))))
        return plain(self, rows, after, batches)

    monkeypatch.setattr(R.RecentStore, "commit", interrupted)
    assert one.upsert(accesses(spark, ("a", 4))) == 3 and met == [2]
    assert [(r.uri, r.mime_type, r.file_size) for r in one.read().orderBy(F.desc("last_accessed")).collect()] == [("a", "", 0), ("c", "", 0), ("b", "", 0)]
    assert sorted(r.uri for r in one.read(1).collect()) == ["a", "b"]
    assert len([f for f in (tmp_path / "recents").iterdir() if f.name.startswith("snapshot")]) == 3  # the lost attempt left none
    monkeypatch.setattr(R.RecentStore, "commit", plain)
    with pytest.raises(R.Conflict):
        one.commit(one.read(), 1, {})
    assert two.upsert(accesses(spark, ("z", 9)), stream="s", batch=5) == 4 == two.upsert(accesses(spark, ("y", 10)), stream="s", batch=5)


def test_recents_of_a_stream_keep_a_bounded_state(spark, tmp_path):
    for k in range(3):
        accesses(spark, *((f"f{(7 * i + k) % 40}", 100 * k + i) for i in range(40))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(RECENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store, seen = R.RecentStore(spark, str(tmp_path / "store")), []
    streams.stream_recents(arriving, str(tmp_path / "c"), lambda df, n: seen.append((n, [r.uri for r in df.collect()])), store).awaitTermination()
    assert [n for n, _ in seen] == [0, 1, 2] and all(len(uris) == R.SHOWN for _, uris in seen)
    assert [store.read(v).count() for v in (1, 2, 3)] == [R.KEPT] * 3
    whole = spark.read.parquet(str(tmp_path / "in")).groupBy("uri").agg(F.max("last_accessed").alias("t")).orderBy(F.desc("t"), "uri").limit(R.SHOWN)
    assert seen[-1][1] == [r.uri for r in whole.collect()]


def test_a_stream_of_all_formats_that_stops_and_repeats(spark, tmp_path, monkeypatch):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    docx(source / "a.docx", "first")
    (source / "bad.docx").write_bytes(b"none")
    odt(source / "b.odt", '<text:h>H</text:h><text:p/><text:p><text:span>a</text:span> <text:a>l</text:a></text:p><table:table><table:table-row><table:table-cell><text:p>c</text:p></table:table-cell></table:table-row></table:table><draw:frame><draw:image xlink:href="Pictures/a.png"/></draw:frame>')
    files = lambda: spark.readStream.format("binaryFile").schema(streams.BINARY).load(str(source))
    kept = []
    plain = P.new_folder
    monkeypatch.setattr(P, "new_folder", lambda s, tag: kept.append(plain(s, tag)) or kept[-1])
    run = lambda: streams.stream_documents(files(), str(tmp_path / "progress"), out).awaitTermination()
    run()
    (source / "c.txt").write_text("plain\ntext")
    done, calls = streams.parsed, []

    def fails_once(*args):
        rows, status = done(*args)
        calls.append(1)
        return rows, status if len(calls) > 1 else status.withColumn("ok", F.raise_error(F.lit("lost")).cast("boolean"))

    monkeypatch.setattr(streams, "parsed", fails_once)
    with pytest.raises(Exception, match="lost"):
        run()  # elements of the second batch are written, the batch isn't done
    assert {r.doc_id.rsplit("/", 1)[1] for r in streams.streamed(spark, out, "elements").collect()} == {"a.docx", "b.odt"}
    run()
    run()
    rows = streams.streamed(spark, out, "elements").orderBy("doc_id", "seq").collect()
    assert [(r.doc_id.rsplit("/", 1)[1], r.type, r.text) for r in rows] == [
        ("a.docx", "paragraph", "first"), ("b.odt", "metadata", None), ("b.odt", "header", "H"), ("b.odt", "paragraph", ""), ("b.odt", "paragraph", "al"), ("b.odt", "table", None), ("b.odt", "image", None), ("c.txt", "paragraph", "plain\ntext"),
    ]
    assert [(s.text, s.underline, s.color, s.bold) for s in rows[4].spans] == [("a", False, "000000", False), ("l", True, "0000EE", False)]
    assert [(r.doc_id.rsplit("/", 1)[1], r.error) for r in streams.streamed(spark, out, "quarantine").collect()] == [("bad.docx", "Failed to open file")]
    assert len(streams.streamed(spark, out, "manifest").collect()) == 4
    import os

    assert len(kept) == 3 and not any(os.path.exists(f) for f in kept)  # nodes go with their batch
