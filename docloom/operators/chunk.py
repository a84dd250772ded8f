"""Documents to numbered, quality-filtered chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import heading_sections, packed
from ..functions.text import LIMIT, TARGET, alpha_ratio, good_chunk, has_heading, paragraphs, sentence_windows, sentences, stripped


def structured_chunks(text: Column) -> Column:
    """Array of (title, text) of the parts between === lines; each carries the table's header line."""
    parts = F.transform(F.split(text, "={3,}", -1), stripped)
    first = lambda p: F.element_at(F.split(p, "\n", -1), 1)
    heads = F.filter(parts, lambda p: F.contains(p, F.lit("Columns:")) | F.contains(p, F.lit("Shape:")))
    head = F.coalesce(first(F.get(heads, 0)), F.lit(""))
    body = lambda p: F.when((head == "") | F.contains(p, head), p).otherwise(F.concat(head, F.lit("\n\n"), p))
    found = F.transform(F.filter(parts, lambda p: F.length(p) >= 30), lambda p: F.struct(F.substring(stripped(first(p)), 1, 80).alias("title"), body(p).alias("text")))
    whole = F.array(F.struct(F.lit("Structured Data").alias("title"), text.alias("text")))
    return F.when(F.size(found) > 0, found).when(stripped(text) != "", whole).otherwise(F.slice(whole, 1, 0))


def paragraph_chunks(rows: DataFrame, semantic: bool = True) -> DataFrame:
    """Rows with a paragraph p and its pieces, by its size; only sentences of large paragraphs go through Python."""
    rows = rows.withColumn("found", F.when(F.length("p") > TARGET, sentences(F.col("p"))))
    few = F.size("found") <= 3
    middle = F.when(few, F.array("p")).otherwise(sentence_windows(F.col("found"))) if semantic else F.array("p")
    rows = rows.withColumn("packs", packed(F.when((F.length("p") > LIMIT) & (F.size("found") > 0), F.col("found"))))
    return rows.withColumn("pieces", F.when(F.length("p") <= TARGET, F.array("p")).when(F.length("p") <= LIMIT, middle).otherwise(F.coalesce("packs", F.array("p")))).drop("found", "packs")


def quality(chunks: DataFrame, key: str, order: str = "pos", always: Column | None = None) -> DataFrame:
    """good chunks, and those of `always`; where a document has none, its best three by letters among those over 50 characters."""
    doc = Window.partitionBy(key)
    good = good_chunk(F.col("text")) if always is None else good_chunk(F.col("text")) | always
    marked = chunks.withColumn("good", good).withColumn("long", F.length("text") > 50)
    marked = marked.withColumn("any_good", F.max("good").over(doc))
    best = Window.partitionBy(key, "long").orderBy(F.desc(alpha_ratio(F.col("text"))), order)
    marked = marked.withColumn("place", F.row_number().over(best))
    return marked.filter(F.col("good") | (~F.col("any_good") & F.col("long") & (F.col("place") <= 3))).drop("good", "long", "any_good", "place")


def chunk(docs: DataFrame, key: str = "doc_id", structured: Column | None = None, semantic: bool = True) -> DataFrame:
    """Key, chunk_index, total_chunks, section_title, text. Documents marked `structured` are cut at their === lines.

    One scan and one shuffle by key; only texts with headings and sentences of large paragraphs go through Python.
    """
    source = docs.select(key, F.col("text"), (structured if structured is not None else F.lit(False)).alias("structured"))
    source = source.withColumn("headed", heading_sections(F.when(~F.col("structured") & has_heading(F.col("text")), F.col("text"))))
    section = lambda title, text: F.struct(title.cast("string").alias("title"), text.alias("content"))
    tables = F.transform(structured_chunks(F.col("text")), lambda x: section(x["title"], x["text"]))
    headed = F.transform("headed", lambda x: section(x["title"], x["content"]))
    found = F.when(F.col("structured"), tables).when(F.col("headed").isNotNull(), headed).otherwise(F.array(section(F.lit(None), F.col("text"))))
    # the outer forms: from the inner ones the optimizer infers filters on sizes that make all sentences anew, for each window
    rows = source.select(key, "structured", F.posexplode_outer(found).alias("section", "s"))
    whole = F.when(F.col("structured"), F.array("s.content")).otherwise(paragraphs(F.col("s.content")))
    rows = rows.select(key, "structured", "section", F.col("s.title").alias("title"), F.posexplode_outer(whole).alias("paragraph", "p"))
    rows = paragraph_chunks(rows, semantic)
    pieces = F.when(F.col("structured"), F.array("p")).otherwise(F.col("pieces"))
    rows = rows.select(key, "structured", "title", "section", "paragraph", F.posexplode_outer(pieces).alias("piece", "text")).filter("text IS NOT NULL")
    rows = rows.select(key, "structured", F.struct("section", "paragraph", "piece").alias("pos"), "title", "text")
    rows = quality(rows, key, always=F.col("structured"))
    order = Window.partitionBy(key).orderBy("pos")
    return rows.select(
        key,
        (F.row_number().over(order) - 1).alias("chunk_index"),
        F.count("*").over(Window.partitionBy(key)).alias("total_chunks"),
        F.col("title").alias("section_title"),
        "text",
    )
