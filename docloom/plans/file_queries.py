"""Registered queries of sources and sinks: tables and texts written to the shared folder in each format, and read back by the readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..operators import profile, sessions
from ..sources import readers, sinks
from ..streaming import limits
from .queries import register, t


def work_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, one of this machine in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="files-")
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


@register("q_csv_source", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(spark, d):
    path, rows = work_folder(spark), t(spark, d, "supplier")
    rows.write.option("header", True).csv(path)
    return readers.csv(spark, path, schema=rows.schema.simpleString()[7:-1].replace(":", " "))


@register("q_tsv_source", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, d):
    path = work_folder(spark)
    t(spark, d, "nation").write.option("header", True).option("sep", "\t").csv(path)
    return readers.csv(spark, path, separator="\t")


@register("q_text_source", r"SELECT doc_id, text, CASE WHEN length(text) = 0 OR length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text) < 0.05 THEN 'failed' ELSE 'success' END AS status FROM documents")
def _(spark, d):
    files = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    found = readers.as_text(files.select("path", F.encode("text", "UTF-8").alias("content")))
    # a text that failed keeps none: the row says why, so the text is taken from the table
    return found.select("path", "status").join(files, "path").select(F.col("path").cast("long").alias("doc_id"), "text", "status")


@register("q_json_records", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def _(spark, d):
    path = work_folder(spark)
    sinks.write_records(t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), path)
    return spark.read.schema("c_custkey long, c_name string, c_nationkey int").json(path)


@register("q_export_import", "SELECT p_partkey, p_name FROM part")
def _(spark, d):
    path = work_folder(spark)
    sinks.write_export(t(spark, d, "part").select("p_partkey", "p_name"), path, "parts", "p_partkey", 1000)
    return readers.exported_records(spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name")


@register("q_parquet_sidecar", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(spark, d):
    path = work_folder(spark)
    sinks.write_table(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path, ["o_orderstatus"])
    return spark.read.parquet(path)


@register("q_material_texts", "SELECT 'm' || doc_id AS material_id, text FROM documents")
def _(spark, d):
    path = work_folder(spark)
    sinks.write_texts(t(spark, d, "documents").select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("material_id"), "text"), path)
    return spark.read.parquet(path)


@register("q_usage_log", "SELECT event_id, user_id, event_type FROM events")
def _(spark, d):
    path, rows = work_folder(spark), t(spark, d, "events").select("event_id", "user_id", "event_type")
    for part in (0, 1):
        sinks.append(rows.filter(F.pmod("event_id", F.lit(2)) == part), path)
    return spark.read.parquet(path)


@register("q_stream_log", "SELECT event_id, user_id FROM events")
def _(spark, d):
    base, path = work_folder(spark), work_folder(spark)
    rows = t(spark, d, "events").select("event_id", "user_id")
    rows.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    limits.append_log(stream, path, f"{base}/state").awaitTermination()
    return spark.read.parquet(path)


@register("q_preview", "SELECT p_partkey, p_name, p_brand FROM part ORDER BY p_partkey LIMIT 20")
def _(spark, d):
    return t(spark, d, "part").select("p_partkey", "p_name", "p_brand").orderBy("p_partkey").limit(20)


@register(
    "q_dtypes",
    "SELECT * FROM (VALUES ('c_custkey', 'bigint', 0), ('c_name', 'string', 1), ('c_nationkey', 'int', 2), ('c_acctbal', 'double', 3), ('c_mktsegment', 'string', 4)) AS v(\"column\", type, pos)",
)
def _(spark, d):
    return profile.kinds(spark, t(spark, d, "customer"))


@register("q_text_profile", 'SELECT \'p_brand\' AS "column", (SELECT count(DISTINCT p_brand) FROM part)::VARCHAR AS n_unique, p_brand AS top, count(*)::VARCHAR AS freq FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 1')
def _(spark, d):
    tall = profile.describe(t(spark, d, "part").select("p_brand"))
    wide = tall.groupBy("column").pivot("stat", ["unique", "top", "freq"]).agg(F.first("value"))
    return wide.withColumnRenamed("unique", "n_unique")


@register("q_emails", "SELECT conv_id, turn, len(regexp_extract_all(text, '\\S+'))::BIGINT AS n_words, role AS subject FROM conversations")
def _(spark, d):
    rows = t(spark, d, "conversations")
    raw = F.concat(F.lit("From: a@example.org\r\nTo: b@example.org\r\nSubject: "), "role", F.lit("\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"), F.base64(F.encode("text", "UTF-8")))
    found = readers.emails(rows.select(F.concat_ws("-", "conv_id", "turn").alias("path"), F.encode(raw, "UTF-8").alias("content")))
    body, head = F.split("text", "\n\n", 2)[1], F.regexp_extract("text", r"Subject: (\w+)", 1)
    return found.select(F.split("path", "-")[0].cast("long").alias("conv_id"), F.split("path", "-")[1].cast("long").alias("turn"), word_count(body).alias("n_words"), head.alias("subject"))


@register("q_rtf", "SELECT n_nationkey, n_name AS text FROM nation")
def _(spark, d):
    raw = F.concat(F.lit("{\\rtf1\\ansi{\\b "), "n_name", F.lit("}\\par}"))
    found = readers.rtf(t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("path"), F.encode(raw, "ISO-8859-1").alias("content")))
    return found.select(F.col("path").cast("int").alias("n_nationkey"), F.regexp_replace(F.trim("text"), r"\s+$", "").alias("text"))


@register(
    "q_session_export",
    """SELECT conv_id, n_segments, n_chapters, first_chapter, last_chapter FROM (
       SELECT c.conv_id, count(*)::INT AS n_segments, (max(turn) // 3 + 1)::INT AS n_chapters, 'c0' AS first_chapter, 'c' || (max(turn) // 3) AS last_chapter
       FROM conversations c GROUP BY c.conv_id)""",
)
def _(spark, d):
    c = t(spark, d, "conversations").withColumnRenamed("conv_id", "session_id")
    session = c.groupBy("session_id").agg(F.count("*").alias("n"))
    chapters = c.select("session_id", (F.floor(F.col("turn") / 3)).alias("k")).distinct().select("session_id", (F.col("k") * 3).alias("start"), F.concat(F.lit("c"), F.col("k").cast("string")).alias("title"), F.lit("").alias("summary"))
    segments = c.select("session_id", F.col("turn").alias("index"), F.col("role").alias("speaker"), "text", F.lit(500).alias("duration_ms"))
    marks = c.filter("turn = 1").select("session_id", F.col("turn").alias("index"))
    notes = marks.withColumns({"created_at": F.lit("2024-01-01"), "note": F.lit("n")})
    doubts = marks.select("session_id", F.col("index").alias("paused_at_segment"), F.lit("q").alias("question"), F.lit("a").alias("answer"))
    found = sessions.export(session, chapters, segments, marks, notes, doubts)
    parsed = F.from_json("json", "chapters array<struct<title:string>>, segments array<struct<index:int,chapter:string>>")
    rows = found.select(F.col("session_id").alias("conv_id"), parsed.alias("x"))
    at = lambda k: F.element_at("x.segments", F.lit(k))["chapter"]
    return rows.select("conv_id", F.size("x.segments").alias("n_segments"), F.size("x.chapters").alias("n_chapters"), at(1).alias("first_chapter"), at(-1).alias("last_chapter"))


@register("q_transcripts", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'en' WHEN s_suppkey % 3 = 1 THEN 'de' ELSE 'fr' END AS lang, s_suppkey % 3 <> 0 AS generated FROM supplier")
def _(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey")
    kind = F.pmod("s_suppkey", F.lit(3))
    have = F.when(kind == 0, F.array(F.lit("en-1"), F.lit("en-0"), F.lit("de-0"))).when(kind == 1, F.array(F.lit("fr-0"), F.lit("de-1"))).otherwise(F.array(F.lit("xx-1"), F.lit("fr-1")))
    tracks = s.select("s_suppkey", F.explode(have).alias("x")).select("s_suppkey", F.split("x", "-")[0].alias("lang"), (F.split("x", "-")[1] == "1").alias("generated"), F.lit("t").alias("text"))
    return readers.transcript_choice(tracks, "s_suppkey", ["en", "de", "fr"]).select("s_suppkey", "lang", "generated")


@register("q_pdf_routes", """SELECT l_orderkey, page_num, CASE WHEN digital AND chars >= 50 THEN 'text' ELSE 'ocr' END AS route FROM (
    SELECT *, avg(CASE WHEN page_num <= 5 THEN chars END) OVER (PARTITION BY l_orderkey) > 150 AS digital FROM (
    SELECT l_orderkey, l_linenumber AS page_num, sum(l_quantity::INT * 6)::BIGINT AS chars FROM lineitem GROUP BY ALL))""")
def _(spark, d):
    blocks = t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page_num"), F.repeat(F.lit("word, "), F.col("l_quantity").cast("int")).alias("text"))
    return readers.pdf_route(blocks, "l_orderkey").select("l_orderkey", "page_num", "route")


@register("q_block_rows", "SELECT doc_id, k::INT AS block_index, text[k * 200 + 1 : (k + 1) * 200] AS text FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 199) // 200)) AS k FROM documents)")
def _(spark, d):
    docs = t(spark, d, "documents")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") + 199) / 200).cast("int") - 1), lambda k: F.substring("text", k * 200 + 1, F.lit(200)))
    return sinks.block_rows(docs, F.when(F.length("text") > 0, parts).otherwise(F.array().cast("array<string>")), "doc_id")


@register("q_parquet_preview", """SELECT 'p_partkey' AS "column", 'bigint' AS type, 0 AS pos, string_agg(p_partkey::VARCHAR, '|' ORDER BY p_partkey) AS samples FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 5)
UNION ALL SELECT 'p_name', 'string', 1, string_agg(p_name, '|' ORDER BY p_partkey) FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 5) UNION ALL SELECT 'p_size', 'int', 2, string_agg(p_size::VARCHAR, '|' ORDER BY p_partkey) FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 5)""")
def _(spark, d):
    path = work_folder(spark)
    t(spark, d, "part").select("p_partkey", "p_name", "p_size").orderBy("p_partkey").write.parquet(path)
    return readers.parquet_preview(spark, path).select("column", "type", "pos", F.array_join("samples", "|").alias("samples"))
