"""A training corpus from raw documents: STAGES, each reading what the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.decontaminate import decontaminate
from docloom.llm.language_id import identify, learn
from docloom.llm.mixing import in_training_order, mix
from docloom.llm.pipeline_io import shared_folder
from docloom.llm.simhash import simhash
from docloom.llm.suffix_dedup import suffix_dedup


LEAST_SURE = 0.5


def apart(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs whose columns other than `used` have names that no operator gives, and what puts all names and their order back."""
    names = {c: c if c in used else f"column_{i}_of_docs" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in names.items()])
    return plain, lambda rows: rows.select(*[F.col(name).alias(c) for c, name in names.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: those go whose text is null or has no letter, or whose likeliest language has not even half the posterior.

    Where nothing can be learned (no lang in any row, an empty table), every text with a letter stays. Rows that repeat, and
    texts of any length, are judged each by itself. Other columns stay as they are, whatever their names.
    """
    langs, log_p = learn(docs)
    if not langs:
        return docs.filter(F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)))
    plain, back = apart(docs, "text")
    return back(identify(plain, langs, log_p).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: that with the least doc_id (without one only if none has any), then the least hash of its text.

    Groups are of texts, so that unlike rows of one doc_id stay both, and documents without doc_id are compared like others;
    of rows that repeat both doc_id and text one stays. Texts without words, null ones too, are one group. Other columns stay
    as they are, whatever their names.
    """
    marked = simhash(docs.select("doc_id", "text"))
    first = marked.groupBy("group_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_hash")).alias("first"))
    plain, back = apart(docs, "doc_id", "text")
    own = plain.withColumn("row_hash_of_first", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    # the join's only key comes first among those of dropDuplicates, which needs no second shuffle therefore
    kept = own.join(first.select(F.col("first.row_hash").alias("row_hash_of_first")), "row_hash_of_first", "left_semi")
    return back(kept.dropDuplicates(["row_hash_of_first", "doc_id"]))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that earlier ones hold too; those with nothing but white space left go.

    Halves of cut characters go as well, and n_chars, if there is one, follows the text. A text from which nothing was removed
    stays as it is, also a null or blank one; rows that repeat a doc_id don't remove each other's bytes. Other columns stay as
    they are, whatever their names.
    """
    plain, back = apart(docs, "doc_id", "text", "n_chars")
    found = suffix_dedup(plain, as_text=True)
    found = found.withColumn("text", F.col("kept_text")).filter("n_removed = 0 OR text RLIKE '\\\\S'")
    return back(found.withColumn("n_chars", F.length("kept_text").cast("long")) if "n_chars" in docs.columns else found)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and wordless texts have none, with an empty benchmark all stay.

    Other columns stay as they are, whatever their names.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plain, back = apart(docs, "doc_id", "text")
    return back(decontaminate(plain, items).filter("n_hit = 0"))


MADE = ("size", "source_size", "target", "taken", "position", "words")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What training reads: a row for each reading of a document, with its position and words, in the order of positions.

    Documents without words are never read; a null source is a source of its own; an empty table gives an empty mix. Columns
    named like those that are made here (`MADE`) give way to them, all others stay as they are.
    """
    others = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in MADE])
    plain, _ = apart(others, "doc_id", "text", "source")
    read = in_training_order(mix(plain))
    return read.select(*[F.col(f"`{c}`").alias(name) for c, name in zip(plain.columns, others.columns, strict=True)], *MADE)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_copies),
    ("suffix_array_dedup", repeats),
    ("benchmark_decontamination", benchmark_free),
    ("source_mixing", mixed),
]

ORACLE_SQL = None


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a stage's folder, wherever it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before it wrote is deleted once the next has read it."""
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            dropped(spark, before)
        before = path
    return docs
