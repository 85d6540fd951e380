"""Queries of the text functions, each with its SQL on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.functions import strings as S
from docflow.plans import fixtures as X


def _docs(s, d):
    return X.table(s, d, "documents")


def fn_01_ktrim(s, d):
    padded = F.concat(F.lit(" \t\n"), "source", F.lit("\r\n "))
    return _docs(s, d).select("doc_id", S.ktrim(padded).alias("trimmed"), S.is_blank(F.when(F.col("doc_id") % 2 == 0, " \t").otherwise(padded)).alias("blank"))


def fn_02_to_int(s, d):
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("+"), F.col("doc_id"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" "), F.col("doc_id"))).otherwise(F.concat("doc_id", F.lit(".0")))
    return _docs(s, d).select("doc_id", S.to_int(made).cast("long").alias("n"))


def fn_03_to_float(s, d):
    return _docs(s, d).select("doc_id", S.to_float(F.concat("doc_id", F.when(F.col("doc_id") % 2 == 0, ".5pt").otherwise("cm"))).cast("double").alias("x"))


def fn_04_cuts(s, d):
    text = F.concat("lang", F.lit("="), "source", F.lit("="), F.col("doc_id"))
    return _docs(s, d).select("doc_id", S.after_last(text, "=").alias("last"), S.before_first(text, "=").alias("first"), S.after_first(text, "=").alias("rest"), S.after_last(F.col("lang"), "=", F.lit("none")).alias("fallback"))


def fn_05_first_letter(s, d):
    return _docs(s, d).select("doc_id", S.upper_first(F.col("source")).alias("upper"), S.lower_first(F.upper("source")).alias("lower"))


def fn_06_ignoring_case(s, d):
    return _docs(s, d).select("doc_id", S.contains_ignoring_case(F.upper("source"), "rc1").alias("has"), S.starts_ignoring_case(F.upper("lang"), "e").alias("starts"))


def fn_07_joined(s, d):
    maybe = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return _docs(s, d).select("doc_id", S.joined(", ", maybe, F.when(F.col("doc_id") % 3 == 0, F.col("source")), fallback=F.lit("nothing")).alias("text"))


def fn_08_non_blank_values(s, d):
    odd = F.when(F.col("doc_id") % 2 == 1, F.col("lang"))
    m = S.non_blank_values(F.create_map(F.lit("lang"), odd, F.lit("source"), F.col("source"), F.lit("gap"), F.when(F.col("doc_id") % 3 == 0, " \t\u00a0").otherwise("z")))
    return _docs(s, d).select("doc_id", F.array_join(F.map_keys(m), ",").alias("names"), F.array_join(F.map_values(m), ",").alias("texts"))


def fn_09_words(s, d):
    text = F.concat(F.lit("  "), "lang", F.lit("  "), "source", F.lit(" x y "))
    return _docs(s, d).select("doc_id", S.nth_word(text, 1).alias("second"), S.drop_words(text, 2).alias("rest"), S.unquoted(F.concat(F.lit('"'), "lang", F.lit('"'))).alias("bare"))


def fn_11_clamp(s, d):
    return _docs(s, d).select("doc_id", S.clamp(F.col("doc_id"), 1, 9).alias("n"))


def fn_13_repeat_and_prefix(s, d):
    return _docs(s, d).select("doc_id", S.repeated(F.col("lang"), (F.col("doc_id") % 4 - 1).cast("int")).alias("many"), S.repeated(F.lit("ab"), 2).alias("twice"), S.prefix(F.col("text"), 80).alias("start"))


def fn_12_iso_instant(s, d):
    return X.table(s, d, "events").select("event_id", S.iso_instant(F.col("ts")).alias("at"))


SQL = {
    "fn_01_ktrim": "SELECT doc_id, source AS trimmed, doc_id % 2 = 0 AS blank FROM documents",
    "fn_02_to_int": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS n FROM documents",
    "fn_03_to_float": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id + 0.5::DOUBLE END AS x FROM documents",
    "fn_04_cuts": "SELECT doc_id, doc_id::VARCHAR AS last, lang AS first, source || '=' || doc_id AS rest, 'none' AS fallback FROM documents",
    "fn_05_first_letter": "SELECT doc_id, upper(left(source, 1)) || substr(source, 2) AS upper, lower(left(source, 1)) || substr(upper(source), 2) AS lower FROM documents",
    "fn_06_ignoring_case": "SELECT doc_id, contains(lower(source), 'rc1') AS has, starts_with(lower(lang), 'e') AS starts FROM documents",
    "fn_07_joined": "SELECT doc_id, coalesce(nullif(concat_ws(', ', CASE WHEN doc_id % 2 = 0 THEN lang END, CASE WHEN doc_id % 3 = 0 THEN source END), ''), 'nothing') AS text FROM documents",
    "fn_08_non_blank_values": "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 2 = 1 AND trim(lang) <> '' THEN 'lang' END, CASE WHEN trim(source) <> '' THEN 'source' END, CASE WHEN doc_id % 3 <> 0 THEN 'gap' END) AS names, concat_ws(',', CASE WHEN doc_id % 2 = 1 AND trim(lang) <> '' THEN lang END, CASE WHEN trim(source) <> '' THEN source END, CASE WHEN doc_id % 3 <> 0 THEN 'z' END) AS texts FROM documents",
    "fn_13_repeat_and_prefix": "SELECT doc_id, repeat(lang, greatest(doc_id % 4 - 1, 0)) AS many, 'abab' AS twice, left(text, 80) AS start FROM documents",
    "fn_09_words": "SELECT doc_id, source AS second, 'x y' AS rest, lang AS bare FROM documents",
    "fn_11_clamp": "SELECT doc_id, greatest(1, least(9, doc_id)) AS n FROM documents",
    "fn_12_iso_instant": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events",
}
QUERIES = {name: globals()[name] for name in SQL}
