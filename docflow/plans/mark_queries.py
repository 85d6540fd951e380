"""Queries of fields, notes, revisions, properties, OpenDocument texts, sinks and recents, each with its SQL on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.operators import body as B
from docflow.operators import catalogue as C
from docflow.operators import elements as E
from docflow.operators import marks as M
from docflow.operators import odt as O
from docflow.operators import package as G
from docflow.operators import recents as R
from docflow.operators import sinks as K
from docflow.plans import fixtures as X
from docflow.plans.body_queries import ALIGN, LABEL, LINES, NUMBERED, RUNS, TRIMMED, WHOLE, elements, long, nodes
from docflow.sources import packages as P
from docflow.streaming import streams


def _para(s, d, rows, fixture):
    paras = B.paragraphs(nodes(s, d, fixture)).withColumnRenamed("pre", "p")
    return rows.join(paras.select("doc_id", "part", "p", "para"), ["doc_id", "part", "p"])


def doc_12_bookmarks(s, d):
    return _para(s, d, M.bookmarks(nodes(s, d, "field")), "field").select("doc_id", *long("para", "ordinal", "id"), "boundary", "name")


def doc_13_simple_fields(s, d):
    return _para(s, d, M.simple_fields(nodes(s, d, "field")), "field").select("doc_id", *long("para"), "instruction")


def doc_14_complex_fields(s, d):
    return _para(s, d, M.complex_fields(nodes(s, d, "field")), "field").select("doc_id", *long("para"), "instruction")


def fx_values(spark, sf):
    """A paragraph for each part, by brand: a simple field with data, a complex one, and text."""
    k = F.col("p_partkey").cast("string")
    run = lambda x: F.concat(F.lit("<w:r>"), x, F.lit("</w:r>"))
    mark = lambda kind: run(F.lit(f'<w:fldChar w:fldCharType="{kind}"/>'))
    simple = F.concat(F.lit('<w:fldSimple w:instr="SEQ x"><w:fldData>D'), k, F.lit("</w:fldData></w:fldSimple>"))
    xml = F.concat(F.lit("<w:p>"), simple, mark("begin"), run(F.concat(F.lit("<w:instrText>SET b"), k, F.lit(" one two</w:instrText>"))), mark("end"), run(F.concat(F.lit("<w:t>shown "), k, F.lit("</w:t>"))), F.lit("</w:p>"))
    return X.aggregated(X.table(spark, sf, "part"), F.col("p_brand"), "p_partkey", xml, "word/document.xml", f"<w:document {X.W}><w:body>", "</w:body></w:document>")


X.FIXTURES["values"] = fx_values


def doc_14_field_values(s, d):
    rows = _para(s, d, M.fields(nodes(s, d, "values")), "values")
    said = F.array_join(F.transform(F.array_sort(F.map_entries("arguments")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return rows.select("doc_id", *long("para", "ordinal"), "type", "instruction", "value", said.alias("arguments"), "is_simple")


def doc_15_distinct_fields(s, d):
    return _para(s, d, M.fields(nodes(s, d, "field")), "field").select("doc_id", *long("para", "ordinal"), "instruction", "is_simple", "source")


def doc_16_classify_field(s, d):
    return _para(s, d, M.fields(nodes(s, d, "field")), "field").select("doc_id", *long("para"), "type")


def doc_17_field_arguments(s, d):
    rows = _para(s, d, M.fields(nodes(s, d, "field")), "field")
    return rows.select("doc_id", *long("para"), F.explode(M.field_arguments(F.col("instruction"))).alias("key", "value"))


def doc_36_notes(s, d):
    return M.notes(nodes(s, d, "conv")).select(*long("doc_id", "id"), "kind", "text")


def doc_37_comments(s, d):
    return M.comments(nodes(s, d, "conv")).select(*long("doc_id", "id"), "author", "initials", "date", "text")


def mrk_03_revisions(s, d):
    return M.revisions(nodes(s, d, "rev")).select(*long("doc_id", "ordinal", "id", "comment"), "tag", "reviewer", "timestamp")


def mrk_04_references(s, d):
    return M.references(nodes(s, d, "field")).select("doc_id", "kind", "summary", *long("total"))


def mrk_05_classify_reference(s, d):
    rows = _para(s, d, M.simple_fields(nodes(s, d, "field")), "field")
    return rows.select("doc_id", *long("para"), "instruction", M.classify_reference(F.col("instruction")).alias("kind"))


def mrk_07_citations(s, d):
    return M.citations(nodes(s, d, "meta")).select(*long("doc_id", "ordinal"), "title", "tag", "year")


def mrk_11_page_layout(s, d):
    return M.page_layout(nodes(s, d)).select(*long("doc_id", "pages"))


def mrk_11_page_rows(s, d):
    rows = M.page_rows(nodes(s, d)).select(*long("doc_id", "ordinal"), "kind", "title", "summary", F.col("attributes")["pageIndex"].alias("page"), F.size("attributes").cast("long").alias("attributes"))
    return rows


def mrk_11_section_rows(s, d):
    return M.page_rows(nodes(s, d, "sect")).select(*long("doc_id", "ordinal"), "kind", "title", "summary", F.col("attributes")["sectionIndex"].alias("section"))


def mrk_12_borders_shading(s, d):
    return M.borders_shading(nodes(s, d, "table")).select(*long("doc_id"), "shading", "page_borders")


def mrk_13_complex_script(s, d):
    return M.complex_script(nodes(s, d)).select(*long("doc_id"), "rtl", "cs_fonts", "bidi_tables")


def _attributes(rows):
    return rows.select(*long("doc_id"), "summary", F.explode("attributes").alias("key", "value"))


def pkg_01_core_properties(s, d):
    return _attributes(M.core_properties(nodes(s, d, "meta")))


def pkg_02_extended_properties(s, d):
    return _attributes(M.extended_properties(nodes(s, d, "meta")))


def pkg_03_custom_properties(s, d):
    return M.custom_properties(nodes(s, d, "meta")).select(*long("doc_id", "ordinal"), "name", "value", "summary")


def _metadata(s, d):
    n = nodes(s, d, "meta")
    core = M.core_properties(n).select("doc_id", F.lit(0).alias("seq"), F.lit("Core").alias("kind"), "summary")
    more = M.custom_properties(n).select("doc_id", F.col("ordinal").alias("seq"), F.lit("Custom").alias("kind"), F.concat("name", F.lit("="), "value").alias("summary"))
    return core.unionByName(more).withColumn("type", F.lit("metadata"))


def elm_04_metadata_map(s, d):
    return E.metadata_map(_metadata(s, d)).select(*long("doc_id"), "kind", "summary")


def elm_06_display_text(s, d):
    rows = M.comments(nodes(s, d, "conv")).select("doc_id", F.col("id").cast("int").alias("seq"), F.lit("comment").alias("type"), "text", F.col("author").alias("name"))
    wide = rows.select("*", *(F.lit(None).cast(k).alias(n) for n, k in (("label", "string"), ("rows", "array<array<string>>"), ("kind", "string"), ("summary", "string"))))
    return E.display_text(wide).select(*long("doc_id", "seq"), "shown")


def odt_01_odt_document(s, d):
    files = P.packed(X.fx_odt(s, d)).withColumn("format", F.lit("odt"))
    return P.parse_status(files, P.shred(P.explode_parts(files))).select(*long("doc_id"), "ok", "error")


def odt_02_odt_body(s, d):
    return O.odt_body(nodes(s, d, "odt")).select(*long("doc_id", "ord"), "name")


def odt_03_odt_heading(s, d):
    return O.odt_headings(nodes(s, d, "odt")).select(*long("doc_id", "ord", "level"), "text")


def odt_04_odt_spans(s, d):
    return O.odt_spans(nodes(s, d, "odt")).select(*long("doc_id", "ord", "i"), "text", "color", "underline")


def odt_05_odt_styles(s, d):
    return O.odt_styles(nodes(s, d, "odt")).select(*long("doc_id"), "style", "bold", "italic", "color", F.col("size").cast("double").alias("size"))


def odt_06_odt_styled_spans(s, d):
    rows = O.odt_spans(nodes(s, d, "odt")).where("bold")
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.col("size").cast("long").alias("size")).agg(F.count("*").alias("n"))


def odt_07_odt_tables(s, d):
    rows = O.odt_tables(nodes(s, d, "odt")).select("doc_id", F.explode("rows").alias("r"))
    return rows.select(*long("doc_id"), F.array_join("r", "|").alias("texts"))


def odt_08_odt_images(s, d):
    return O.odt_images(nodes(s, d, "media"), X.fx_media(s, d)).select(*long("doc_id", "ord"), "uri", "alt")


def odt_09_odt_metadata(s, d):
    return O.odt_metadata(nodes(s, d, "odt")).select(*long("doc_id"), "title", "author", "words")


def snk_01_write_text(s, d):
    path = P.new_folder(s, "texts")
    K.write_text(elements(s, d), path)
    return s.read.parquet(path).select(*long("doc_id"), "text")


def snk_01_text_files(s, d):
    path = X.folder(s, d, "text-files", lambda path: K.write_text_files(elements(s, d), path))
    return P.read_corpus(s, path, "*.txt", empty=True).select(F.regexp_extract("filename", "^([0-9]+)", 1).cast("long").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))


def snk_02_export_docx(s, d):
    files = P.packed(K.export_docx(elements(s, d)))
    again = E.document_elements(P.stored(P.shred(P.explode_parts(files))), blank=True)
    return again.where("type <> 'page_break'").select(*long("doc_id", "level"), "type", "text")


def _exported(s, d):
    """The nodes of the body's elements after an export."""
    return X.kept(s, d, "exported", lambda: P.shred(P.explode_parts(P.packed(K.export_docx(elements(s, d))))))


def snk_02_exported_spans(s, d):
    rows = E.flatten_spans(_exported(s, d), blank=True)
    return rows.select(*long("doc_id", "para", "ordinal", "size"), "alignment", "text", "bold", "italic", "underline", "color", "font")


def snk_02_exported_styles(s, d):
    n = _exported(s, d)
    rows = B.paragraph_style(n).join(B.paragraphs(n).withColumnRenamed("pre", "p"), ["doc_id", "part", "p"])
    return rows.select(*long("doc_id", "para", "left", "right", "heading_level"), "style_id", "alignment")


def snk_02_exported_pictures(s, d):
    """Pictures of the packages of a fixture, in packages made anew."""
    n, parts = nodes(s, d, "sect"), X.parts_of(s, d, "sect")
    media = parts.where("part like 'word/media/%'").select(F.concat("doc_id", F.lit("#"), "part").alias("uri"), F.col("content").cast("binary"))
    rows = P.stored(E.document_elements(n, C.paragraph_level(n, parts)), "elements")  # an export with pictures reads them four times
    made = P.stored(P.explode_parts(P.packed(K.export_docx(rows, media))), "made")
    again = P.stored(P.shred(made))
    found = G.images(again, P.relationships(again), made).join(made.select("doc_id", F.concat("doc_id", F.lit("#"), "part").alias("uri"), "content"), ["doc_id", "uri"])
    return found.select(*long("doc_id"), F.substring_index("uri", "#", -1).alias("part"), "alt", "ext", F.decode("content", "UTF-8").alias("bytes"))


def snk_03_export_odt(s, d):
    again = P.stored(P.shred(P.explode_parts(P.packed(K.export_odt(elements(s, d))))))
    return O.odt_body(again).groupBy(F.col("doc_id").cast("long").alias("doc_id"), "name").agg(F.count("*").alias("n"))


def str_01_stream_corpus(s, d):
    files = P.stored(X.fx_files(s, d).select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.octet_length("content").cast("long").alias("length"), "content"), "files")
    arriving = s.readStream.schema(files.schema).parquet(files.inputFiles()[0].rsplit("/", 1)[0])
    out = P.new_folder(s, "streamed")
    streams.stream_files(arriving, P.new_folder(s, "progress"), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), blank=True).awaitTermination()
    return s.read.parquet(out).select(F.regexp_extract("doc_id", r"([0-9]+)\.docx$", 1).cast("long").alias("doc_id"), *long("seq"), "type", "text")


def _streamed(s, d):
    """A folder with the tables of a stream of files of all formats, in two batches; the stream is stopped and started again after them."""

    def make(path):
        files = P.stored(X.fx_all_formats(s, d).repartition(2, "path"), "files")
        folder = files.inputFiles()[0].rsplit("/", 1)[0]
        arriving = s.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        progress = P.new_folder(s, "progress")
        for _ in range(2):
            streams.stream_documents(arriving, progress, path, blank=True).awaitTermination()

    return X.folder(s, d, "streamed", make)


def str_01_stream_documents(s, d):
    rows = streams.streamed(s, _streamed(s, d), "elements")
    return rows.groupBy(F.substring_index("doc_id", "/", -1).alias("name"), "type").agg(F.count("*").alias("n"), F.max("seq").cast("long").alias("last"))


def str_01_quarantine(s, d):
    rows = streams.streamed(s, _streamed(s, d), "manifest").join(streams.streamed(s, _streamed(s, d), "quarantine"), ["doc_id", "batch"], "left")
    return rows.select(F.substring_index("doc_id", "/", -1).alias("name"), "ok", "error")


def str_02_stream_recents(s, d):
    events = X.table(s, d, "events")
    accesses = s.readStream.schema(events.schema).parquet(f"{d}/events.parquet*").select(F.col("user_id").cast("string").alias("uri"), F.col("ts").alias("last_accessed"))
    out = P.new_folder(s, "newest")
    streams.stream_recents(accesses, P.new_folder(s, "progress"), lambda df, _: df.write.mode("overwrite").parquet(out)).awaitTermination()
    return s.read.parquet(out).select("uri", F.unix_micros(F.col("last_accessed").cast("timestamp")).alias("at"))


def _accesses(s, d):
    ext = X.case(F.col("event_type"), ("view", ".docx"), ("click", ".odt"), ("purchase", ".DOCX"))
    rows = X.table(s, d, "events")
    name = F.concat(F.lit("u"), "user_id", ext)
    return rows.select(F.col("user_id").cast("string").alias("uri"), name.alias("file_name"), P.infer_mime(name).alias("mime_type"), F.lit(None).cast("long").alias("file_size"), F.col("ts").alias("last_accessed"))


def _recents(s, d, kept=R.KEPT):
    rows = _accesses(s, d)
    return R.upsert(rows.where(F.lit(False)), rows, kept)


def rec_01_upsert_recent(s, d):
    return _recents(s, d).select("uri", "file_name", "mime_type", F.unix_micros(F.col("last_accessed").cast("timestamp")).alias("at"))


def rec_01_stored_recents(s, d):
    store, rows = R.RecentStore(s, P.new_folder(s, "recents")), _accesses(s, d)
    for k in range(3):
        store.upsert(rows.where(F.col("file_size").isNull() & (F.crc32(F.col("last_accessed").cast("string").cast("binary")) % 3 == k)))
    return store.read().select("uri", "file_name", "mime_type", F.unix_micros(F.col("last_accessed").cast("timestamp")).alias("at"))


def rec_02_visible_recent(s, d):
    return R.visible(_recents(s, d)).select("uri", F.unix_micros(F.col("last_accessed").cast("timestamp")).alias("at"))


def rec_03_prune_recent(s, d):
    return R.prune(_recents(s, d, None))[1]


def rec_04_recent_json(s, d):
    json = R.to_json(_recents(s, d))
    return json.select(F.explode(R.from_json(F.col("json"))).alias("r")).select("r.uri", "r.file_name", "r.file_size", F.unix_millis(F.col("r.last_accessed").cast("timestamp")).alias("at"))


def rec_05_upsert_defaults(s, d):
    return _recents(s, d).select("uri", (F.col("mime_type") == "").alias("untyped"), "file_size")


N = len(X.INSTRUCTIONS)
KINDS = ", ".join(f"({i}, '{a.replace(chr(39), chr(39) * 2)}', '{b}', {f"'{c}'" if c else 'NULL'})" for i, (a, b, c) in enumerate(X.INSTRUCTIONS))
FIELD = f"SELECT p_brand AS doc_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS para, p_partkey, instr, kind, ref FROM part JOIN (VALUES {KINDS}) AS v(i, instr, kind, ref) ON p_partkey % {N} = v.i"
TEXT = "string_agg(x, chr(10) ORDER BY i)"
RECENT = "SELECT * FROM (SELECT user_id::VARCHAR AS uri, event_type, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events) WHERE n = 1"
TOP = f"SELECT * FROM ({RECENT}) ORDER BY ts DESC, uri LIMIT 20"
NAME = "'u' || user_id || CASE event_type WHEN 'view' THEN '.docx' WHEN 'click' THEN '.odt' WHEN 'purchase' THEN '.DOCX' ELSE '' END"
MIME = f"CASE WHEN event_type IN ('view', 'purchase') THEN '{P.MIMES['docx']}' WHEN event_type = 'click' THEN '{P.MIMES['odt']}' ELSE '' END"
PERSON = "SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 <> 0"
CORE_ROWS = "[['title', c_name], ['author', n_name], ['keywords', CASE WHEN c_custkey % 3 <> 0 THEN 'key' END], ['revision', (c_custkey % 9)::VARCHAR]]"
ODT_LINES = f"SELECT * FROM ({LINES}) WHERE doc_id % 97 <> 0"
ODT_PARA = f"SELECT *, split_part(line, ' ', 1) AS first, CASE WHEN contains(line, ' ') THEN substr(line, strpos(line, ' ')) ELSE '' END AS rest FROM ({ODT_LINES}) WHERE k > 0"
ODT_SPANS = f"""SELECT doc_id, k AS ord, row_number() OVER (PARTITION BY doc_id, k ORDER BY n) - 1 AS i, t AS text, CASE n WHEN 1 THEN '00FF00' WHEN 6 THEN '0000EE' ELSE '000000' END AS color, n = 6 AS underline
FROM ({ODT_PARA}), (VALUES (1), (2), (3), (4), (5), (6)) AS u(n), LATERAL (SELECT CASE n WHEN 1 THEN first WHEN 2 THEN '   ' WHEN 3 THEN chr(9) WHEN 4 THEN rest WHEN 5 THEN chr(10) ELSE 'link' END AS t) AS v WHERE n <> 4 OR trim(t) <> ''"""

CLASSES = " ".join(f"WHEN starts_with(upper(summary), '{prefix}') THEN '{name}'" for prefix, name in M.REFERENCES)
REFERENCE = f"""WITH f AS ({FIELD}), x AS (
  SELECT doc_id, instr AS summary FROM f, unnest(CASE WHEN p_partkey % 6 = 0 THEN [1, 2] ELSE [1] END) WHERE p_partkey % 2 = 0
  UNION ALL SELECT doc_id, trim(left(instr, length(instr) // 2)) FROM f WHERE p_partkey % 2 = 1 UNION ALL SELECT doc_id, trim(substr(instr, length(instr) // 2 + 1)) FROM f WHERE p_partkey % 2 = 1
), c AS (SELECT doc_id, summary, CASE {CLASSES} END AS kind FROM x)
SELECT doc_id, kind, summary, (sum(count(*)) OVER (PARTITION BY doc_id))::BIGINT AS total FROM c WHERE kind IS NOT NULL GROUP BY doc_id, kind, summary"""

SQL = {
    "doc_14_field_values": """SELECT doc_id, para, o AS ordinal, t AS type, i AS instruction, v AS value, a AS arguments, s AS is_simple FROM (SELECT p_brand AS doc_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS para, p_partkey::VARCHAR AS k FROM part),
        LATERAL (VALUES (0, 'sequence', 'SEQ x', 'D' || k, 'sequenceIdentifier=x', true), (1, 'variable-set', 'SET b' || k || ' one two', 'shown ' || k, 'bookmark=b' || k || ', value=one two', false)) AS f(o, t, i, v, a, s)""",
    "doc_12_bookmarks": f"SELECT doc_id, para, i AS ordinal, p_partkey AS id, CASE i WHEN 0 THEN 'start' ELSE 'end' END AS boundary, CASE i WHEN 0 THEN 'b' || p_partkey ELSE '' END AS name FROM ({FIELD}), (VALUES (0), (1)) AS b(i)",
    "doc_13_simple_fields": f"SELECT doc_id, para, instr AS instruction FROM ({FIELD}), unnest(CASE WHEN p_partkey % 6 = 0 THEN [1, 2] ELSE [1] END) WHERE p_partkey % 2 = 0",
    "doc_14_complex_fields": f"SELECT doc_id, para, instr AS instruction FROM ({FIELD}) WHERE p_partkey % 2 = 1",
    "doc_15_distinct_fields": f"SELECT doc_id, para, 0 AS ordinal, instr AS instruction, p_partkey % 2 = 0 AS is_simple, CASE WHEN p_partkey % 2 = 0 THEN 'fldSimple' ELSE 'instrText' END AS source FROM ({FIELD})",
    "doc_16_classify_field": f"SELECT doc_id, para, kind AS type FROM ({FIELD})",
    "doc_17_field_arguments": f"""SELECT doc_id, para, key, value FROM ({FIELD}) JOIN (VALUES ('TOC \\o "1-3"', 'switches', '\\o "1-3"'), ('PAGE', 'pageField', 'PAGE'), ('page', 'pageField', 'page'), ('PAGEREF mark', 'pageField', 'PAGEREF mark'), ('DATE \\@ d', 'property', 'DATE'), ('TIME', 'property', 'TIME'),
        ('AUTHOR', 'property', 'AUTHOR'), ('TITLE', 'property', 'TITLE'), ('MERGEFIELD Name', 'fieldName', 'Name'), ('FORMULA a', 'expression', 'a'), ('= 1 + 2', 'expression', '1 + 2'), ('HYPERLINK "http://a.example"', 'target', 'http://a.example'), ('IF a = b', 'condition', 'a = b'),
        ('SET mark value', 'bookmark', 'mark'), ('SET mark value', 'value', 'value'), ('REF mark', 'bookmark', 'mark'), ('SEQ Figure', 'sequenceIdentifier', 'Figure'), ('MACROBUTTON Run now', 'macroName', 'Run'), ('MACROBUTTON Run now', 'displayText', 'now'),
        ('FORMTEXT', 'formType', 'FORMTEXT'), ('FORMCHECKBOX', 'formType', 'FORMCHECKBOX'), ('FORMDROPDOWN', 'formType', 'FORMDROPDOWN'), ('STYLEREF Head', 'styleName', 'Head')) AS a(i, key, value) ON instr = a.i""",
    "doc_36_notes": "SELECT conv_id AS doc_id, turn - 1 AS id, 'footnote' AS kind, text FROM conversations WHERE turn - 1 NOT IN (-1, 0, 1) UNION ALL SELECT conv_id, turn - 1, 'endnote', text FROM conversations WHERE role = 'assistant' AND turn - 1 NOT IN (-1, 0, 1)",
    "doc_37_comments": "SELECT conv_id AS doc_id, turn AS id, role AS author, left(role, 1) AS initials, '2024-01-01T00:' || lpad((turn % 60)::VARCHAR, 2, '0') || ':00Z' AS date, text FROM conversations",
    "mrk_03_revisions": """SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS ordinal, event_id AS id, CASE WHEN event_id % 7 = 0 THEN event_id END AS comment,
        CASE event_type WHEN 'view' THEN 'ins' WHEN 'click' THEN 'del' WHEN 'purchase' THEN 'moveFrom' WHEN 'error' THEN 'moveTo' ELSE 'rPrChange' END AS tag, CASE WHEN event_id % 5 <> 0 THEN 'u' || user_id END AS reviewer, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp FROM events""",
    "mrk_04_references": REFERENCE,
    "mrk_05_classify_reference": f"SELECT doc_id, para, instr AS instruction, ref AS kind FROM ({FIELD}), unnest(CASE WHEN p_partkey % 6 = 0 THEN [1, 2] ELSE [1] END) WHERE p_partkey % 2 = 0",
    "mrk_07_citations": f"SELECT c_custkey AS doc_id, 1 AS ordinal, CASE WHEN c_custkey % 8 <> 0 THEN 'T' || c_custkey WHEN c_custkey % 12 <> 0 THEN c_name ELSE 'Citation 1' END AS title, CASE WHEN c_custkey % 8 <> 0 THEN 'T' || c_custkey END AS tag, '20' || lpad((c_custkey % 100)::VARCHAR, 2, '0') AS year FROM ({PERSON}) WHERE c_custkey % 4 = 0",
    "mrk_11_page_layout": f"SELECT doc_id, 1 + count(*) FILTER (k % 20 = 19) AS pages FROM ({WHOLE}) GROUP BY doc_id",
    "mrk_12_borders_shading": "SELECT l_orderkey AS doc_id, count(*) AS shading, 0 AS page_borders FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey",
    "mrk_13_complex_script": f"""SELECT doc_id, n AS rtl, n AS cs_fonts, 0 AS bidi_tables FROM (SELECT doc_id, sum(1 + (contains(line, ' ') AND rest <> '')::INT + (contains(rest, ' ') AND substr(rest, strpos(rest, ' ') + 1) <> '')::INT)::BIGINT AS n
        FROM (SELECT *, CASE WHEN contains(line, ' ') THEN substr(line, strpos(line, ' ') + 1) ELSE '' END AS rest FROM ({WHOLE}) WHERE k % 11 = 10) GROUP BY doc_id)""",
    "pkg_01_core_properties": f"SELECT c_custkey AS doc_id, c_name || ', ' || n_name || ', ' || c_custkey % 9 AS summary, p[1] AS key, p[2] AS value FROM ({PERSON}), unnest({CORE_ROWS}) AS u(p) WHERE p[2] IS NOT NULL",
    "pkg_02_extended_properties": f"SELECT c_custkey AS doc_id, 'pages=' || c_custkey % 40 || ', words=' || c_custkey || ', company=' || n_name AS summary, p[1] AS key, p[2] AS value FROM ({PERSON}), unnest([['pages', (c_custkey % 40)::VARCHAR], ['words', c_custkey::VARCHAR], ['company', n_name]]) AS u(p)",
    "pkg_03_custom_properties": f"SELECT c_custkey AS doc_id, i AS ordinal, n AS name, CASE i WHEN 1 THEN c_mktsegment ELSE n_name END AS value, '2 custom properties' AS summary FROM ({PERSON}), (VALUES (1, 'segment'), (2, 'nation')) AS v(i, n)",
    "elm_04_metadata_map": f"SELECT c_custkey AS doc_id, 'Core' AS kind, c_name || ', ' || n_name || ', ' || c_custkey % 9 AS summary FROM ({PERSON}) UNION ALL SELECT c_custkey, 'Custom', 'nation=' || n_name FROM ({PERSON})",
    "elm_06_display_text": "SELECT conv_id AS doc_id, turn AS seq, 'comment by ' || role || ': ' || text AS shown FROM conversations",
    "odt_01_odt_document": "SELECT doc_id, doc_id % 97 <> 0 AS ok, CASE WHEN doc_id % 97 = 0 THEN 'Not a valid ODT file: missing content.xml' END AS error FROM documents WHERE doc_id % 97 <> 0 OR doc_id % 4 <> 0",
    "odt_02_odt_body": f"SELECT doc_id, k AS ord, CASE WHEN k = 0 THEN 'h' ELSE 'p' END AS name FROM ({ODT_LINES}) UNION ALL SELECT doc_id, count(*), 'table' FROM ({ODT_LINES}) GROUP BY doc_id",
    "odt_03_odt_heading": f"SELECT doc_id, 0 AS ord, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS level, {TRIMMED} AS text FROM ({ODT_LINES}) WHERE k = 0",
    "odt_04_odt_spans": ODT_SPANS,
    "odt_05_odt_styles": "SELECT doc_id, s AS style, s = 'B' AS bold, s = 'I' AS italic, CASE WHEN s = 'B' THEN '00FF00' END AS color, CASE WHEN s = 'B' THEN 10.5::DOUBLE END AS size FROM documents, (VALUES ('B'), ('I')) AS v(s) WHERE doc_id % 97 <> 0",
    "odt_06_odt_styled_spans": f"SELECT doc_id, 10 AS size, count(*) AS n FROM ({ODT_PARA}) GROUP BY doc_id",
    "odt_07_odt_tables": "SELECT doc_id, 'x|x|y' AS texts FROM documents WHERE doc_id % 97 <> 0",
    "odt_08_odt_images": "SELECT page_id AS doc_id, 1 AS ord, page_id || '#Pictures/a.png' AS uri, 'D' || page_id AS alt FROM pages WHERE page_id % 3 <> 0 AND page_id % 5 <> 0",
    "odt_09_odt_metadata": "SELECT doc_id, 'T' || doc_id AS title, source AS author, NULL AS words FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 5 <> 0",
    "snk_01_write_text": f"SELECT doc_id, string_agg(CASE WHEN type = 'page_break' THEN '' WHEN type = 'header' THEN {TRIMMED} ELSE coalesce(CASE pos % 7 WHEN 3 THEN '• ' WHEN 4 THEN '%1. ' WHEN 6 THEN '• ' END, '') || line END, chr(10) ORDER BY seq) AS text FROM ({NUMBERED}) GROUP BY doc_id",
    "snk_01_text_files": f"SELECT doc_id, string_agg(CASE WHEN type = 'page_break' THEN '' WHEN type = 'header' THEN {TRIMMED} ELSE coalesce(CASE pos % 7 WHEN 3 THEN '• ' WHEN 4 THEN '%1. ' WHEN 6 THEN '• ' END, '') || line END, chr(10) ORDER BY seq) AS text FROM ({NUMBERED}) GROUP BY doc_id",
    "str_01_stream_documents": f"""WITH e AS (SELECT doc_id || '.docx' AS name, type, seq FROM ({NUMBERED}) UNION ALL SELECT doc_id || '.odt', type, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1
        FROM (SELECT doc_id, 'metadata' AS type, -1 AS place FROM documents WHERE doc_id % 97 <> 0 AND doc_id % 4 <> 0 AND doc_id % 5 <> 0 UNION ALL SELECT doc_id, CASE WHEN k = 0 THEN 'header' ELSE 'paragraph' END, k FROM ({ODT_LINES}) UNION ALL SELECT doc_id, 'table', 1000000 FROM documents WHERE doc_id % 97 <> 0)
        UNION ALL SELECT doc_id || '.txt', 'paragraph', 0 FROM documents WHERE doc_id % 10 = 0) SELECT name, type, count(*) AS n, max(seq)::BIGINT AS last FROM e GROUP BY name, type""",
    "str_01_quarantine": """SELECT doc_id || x AS name, doc_id % 97 <> 0 OR x = '.txt' AS ok, CASE WHEN doc_id % 97 <> 0 OR x = '.txt' THEN NULL WHEN x = '.docx' THEN 'Failed to open file' ELSE 'Not a valid ODT file: missing content.xml' END AS error
        FROM documents, (VALUES ('.docx'), ('.odt'), ('.txt')) AS v(x) WHERE CASE x WHEN '.txt' THEN doc_id % 10 = 0 WHEN '.odt' THEN doc_id % 97 <> 0 OR doc_id % 4 <> 0 ELSE true END""",
    "rec_01_stored_recents": f"SELECT uri, {NAME} AS file_name, {MIME} AS mime_type, epoch_us(ts) AS at FROM ({TOP})",
    "snk_02_export_docx": f"SELECT doc_id, CASE WHEN type = 'header' THEN CASE WHEN pos = 0 THEN 1 ELSE 2 END END AS level, type, CASE WHEN type = 'header' THEN {TRIMMED} ELSE coalesce(CASE pos % 7 WHEN 3 THEN '• ' WHEN 4 THEN '%1. ' WHEN 6 THEN '• ' END, '') || line END AS text FROM ({NUMBERED}) WHERE type <> 'page_break'",
    "snk_02_exported_spans": f"""SELECT doc_id, seq AS para, row_number() OVER (PARTITION BY doc_id, seq ORDER BY i) - 1 AS ordinal, CASE WHEN i = 1 THEN 14 ELSE 11 END AS size, {ALIGN.replace('k %', 'pos %')} AS alignment, t AS text, i = 1 AS bold, i = 2 AS italic, false AS underline,
        CASE WHEN i = 2 THEN 'FF0000' ELSE '000000' END AS color, CASE WHEN i > 0 AND pos % 11 = 10 THEN 'Arial' END AS font
        FROM (SELECT doc_id, seq, pos, i, t FROM ({NUMBERED}) JOIN (SELECT doc_id, k AS pos, i, t FROM ({RUNS}) WHERE t <> '') USING (doc_id, pos) WHERE type = 'paragraph'
        UNION ALL SELECT doc_id, seq, pos, 0, {LABEL.replace('k %', 'pos %')} || ' ' FROM ({NUMBERED}) WHERE type = 'paragraph' AND pos % 7 IN (3, 4, 6))""",
    "snk_02_exported_styles": f"""SELECT doc_id, seq AS para, CASE WHEN type = 'paragraph' THEN nullif(pos * 10, 0) END AS "left", NULL::BIGINT AS "right", CASE WHEN type = 'header' THEN CASE WHEN pos = 0 THEN 1 ELSE 2 END END AS heading_level,
        CASE WHEN type = 'header' THEN CASE WHEN pos = 0 THEN 'Heading1' ELSE 'Heading2' END END AS style_id, CASE WHEN type = 'paragraph' THEN {ALIGN.replace('k %', 'pos %')} ELSE 'START' END AS alignment FROM ({NUMBERED}) WHERE type <> 'page_break'""",
    "snk_02_exported_pictures": "SELECT o_orderkey AS doc_id, 'word/media/image1.jpeg' AS part, 'Document Image' AS alt, 'jpeg' AS ext, 'x' AS bytes FROM orders WHERE o_orderkey % 8 <> 0",
    "mrk_11_page_rows": f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS ordinal, 'page' AS kind, 'Page ' || row_number() OVER (PARTITION BY doc_id ORDER BY k) AS title, CASE WHEN k < 0 THEN 'start' ELSE 'explicit page break' END AS summary,
        (row_number() OVER (PARTITION BY doc_id ORDER BY k))::VARCHAR AS page, 1 AS attributes FROM (SELECT doc_id, k FROM ({WHOLE}) WHERE k % 20 = 19 UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id % 97 <> 0)""",
    "mrk_11_section_rows": "SELECT o_orderkey AS doc_id, i AS ordinal, k AS kind, t AS title, m AS summary, n AS section FROM orders, (VALUES (1, 'page', 'Page 1', 'start', NULL), (2, 'page-section', 'Section 2', 'sectionBoundary=true', '1')) AS v(i, k, t, m, n)",
    "snk_03_export_odt": f"SELECT doc_id, 'p' AS name, count(*) AS n FROM ({NUMBERED}) GROUP BY doc_id",
    "str_01_stream_corpus": f"SELECT doc_id, seq, type, CASE type WHEN 'header' THEN {TRIMMED} WHEN 'paragraph' THEN line END AS text FROM ({NUMBERED})",
    "str_02_stream_recents": f"SELECT uri, epoch_us(ts) AS at FROM ({TOP}) ORDER BY ts DESC, uri LIMIT 5",
    "rec_01_upsert_recent": f"SELECT uri, {NAME} AS file_name, {MIME} AS mime_type, epoch_us(ts) AS at FROM ({TOP})",
    "rec_02_visible_recent": f"SELECT uri, epoch_us(ts) AS at FROM ({TOP}) ORDER BY ts DESC, uri LIMIT 5",
    "rec_03_prune_recent": "SELECT greatest(count(DISTINCT user_id) - 20, 0) AS removed FROM events",
    "rec_04_recent_json": f"SELECT uri, {NAME} AS file_name, 0 AS file_size, epoch_us(ts) // 1000 AS at FROM ({TOP})",
    "rec_05_upsert_defaults": f"SELECT uri, event_type NOT IN ('view', 'click', 'purchase') AS untyped, 0 AS file_size FROM ({TOP})",
}
QUERIES = {name: globals()[name] for name in SQL}
