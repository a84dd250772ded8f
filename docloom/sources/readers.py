"""Sources and the registry of extractors."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import partial
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
import regex
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import Outline, email_text, mail_text, page_text
from ..functions.text import alpha_ratio, html_lang, html_title, meta_content, web_clean, word_count
from .compound import msg_text
from .kinds import detected
from .ooxml import docx_text, pptx_text
from .pdf import pdf
from .rtf import rtf_text
from .sheets import workbook_texts

#: Files whose results are held at once.
FILES_AT_ONCE = 64
RESULT = "path string, text string, status string, error string"


def csv(spark: SparkSession, path: str, separator: str = ",", schema: str | None = None) -> DataFrame:
    """A table with a header; give a schema to spare the pass that infers it."""
    reader = spark.read.option("header", True).option("sep", separator).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def parquet_preview(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    """Column, type, pos, samples (as text) of a Parquet table: its schema from a footer, and the first rows of its files in the order of their names.

    Only the first file is read, and further ones as long as there are fewer than n rows. Spark's own order of files is by size.
    """
    rows = spark.read.parquet(path)
    schema = rows.schema
    bare = lambda c: F.regexp_replace(c, "^([a-zA-Z0-9]+):/+", "$1:/")  # noqa: E731  file:/ and file:///
    chosen, have = [], 0
    for name in sorted(rows.inputFiles()):
        if have >= n:
            break
        chosen.append(re.sub("^([a-zA-Z0-9]+):/+", r"\1:/", name))
        have += rows.filter(bare(F.col("_metadata.file_path")) == chosen[-1]).limit(n).count()
    head = rows.withColumns({"file_of_row": bare(F.col("_metadata.file_path")), "index_of_row": F.col("_metadata.row_index")})
    some = head.filter(F.col("file_of_row").isin(chosen) & (F.col("index_of_row") < n)).orderBy("file_of_row", "index_of_row").limit(n)
    cells = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"`{f.name}`").cast("string").alias("value")) for i, f in enumerate(schema)])
    placed = some.select("file_of_row", "index_of_row", F.inline(cells))
    samples = F.transform(F.sort_array(F.collect_list(F.struct("file_of_row", "index_of_row", "value"))), lambda x: x["value"])
    found = placed.groupBy("pos").agg(samples.alias("samples"))
    names = spark.createDataFrame([(f.name, f.dataType.simpleString(), i) for i, f in enumerate(schema)], "column string, type string, pos int")
    return names.join(found, "pos", "left").select("column", "type", "pos", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def whole_texts(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """Whole files as text, NUL removed; too few letters is a failure. Failures are rows."""
    return as_text(spark.read.format("binaryFile").load(path), charset)


def as_text(files: DataFrame, charset: str = "UTF-8") -> DataFrame:
    """S07, S13 over rows of (path, content)."""

    @F.pandas_udf("string")
    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda b: bytes(b).decode(charset, errors="replace").replace("\0", "") if b is not None else None)

    rows = files.select("path", decode("content").alias("text"))
    few = F.coalesce(alpha_ratio(F.col("text")) < 0.05, F.lit(True))
    return rows.select("path", F.when(~few, F.col("text")).alias("text"), F.when(few, "failed").otherwise("success").alias("status"), F.when(few, "too few letters").alias("error"))


def pages(frame: DataFrame, url: str = "url", html: str = "html", ended: bool = False) -> DataFrame:
    """Fetched pages with title, metadata and light Markdown; `ended` as in page_text."""
    text = page_text(html, ended)
    h = F.col(html)
    rows = frame.withColumn("page_text", text)
    return rows.select(
        url, html_title(h).alias("title"), meta_content(h, "description").alias("description"), meta_content(h, "keywords").alias("keywords"), meta_content(h, "author").alias("author"), html_lang(h).alias("lang"),
        web_clean(F.col("page_text.structured")).alias("text"), F.when(F.trim(F.col("page_text.structured")) == "", "failed").otherwise("success").alias("status"),
    ).withColumn("word_count", word_count(F.col("text")))


def scrape_plan(status: Column, text_length: Column, least: int = 200) -> Column:
    """What to do with a fetch: keep it, try a browser, or fail."""
    return F.when((status == 200) & (text_length >= least), "keep").when(status.isin(403, 429, 503) | (status == 200), "browser").otherwise("fail")


def sliced(batches: Iterator[pa.RecordBatch], most: int = FILES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most`, so that what is made of them doesn't pile up; an empty batch stays."""
    for batch in batches:
        for i in range(0, max(1, len(batch)), most):
            yield batch.slice(i, most)


def file_texts(files: DataFrame, read: dict[str, Callable[[bytes], str]], kind: Column | None = None) -> DataFrame:
    """RESULT rows of (path, content): each file's text by the reader of its kind (or by the only one), in one pass over the files.

    A reader's ValueError, a null content and an empty text are failures, as rows. A task holds an Arrow batch of files, and the
    texts of FILES_AT_ONCE.
    """
    only = next(iter(read)) if kind is None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for path, content, of in zip(batch["path"].to_pylist(), batch["content"], batch["kind"].to_pylist(), strict=True):
                try:
                    if of not in read:
                        raise ValueError("unsupported type")
                    text = read[of](content.as_py() or b"")
                    rows.append((path, text, "success", None) if text else (path, None, "failed", "no text"))
                except ValueError as error:
                    rows.append((path, None, "failed", str(error)))
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "text", "status", "error"])

    rows = files.select(F.col("path").cast("string").alias("path"), "content", (F.lit(only) if kind is None else kind).alias("kind"))
    return rows.mapInArrow(run, RESULT)


def emails(files: DataFrame) -> DataFrame:
    """S12 over rows of (path, content)."""
    return files.select("path", email_text("content").alias("text"), F.lit("success").alias("status"), F.lit(None).cast("string").alias("error"))


def plain_text(content: bytes) -> str:
    """NUL removed; too few letters is a failure."""
    text = content.decode(errors="replace").replace("\0", "")
    if len(regex.findall(r"\p{L}", text)) < 0.05 * max(1, len(text)):
        raise ValueError("too few letters")
    return text


def page_file(content: bytes) -> str:
    """The visible text of a page that has letters enough."""
    return " ".join(Outline(plain_text(content)).visible)


def zipped_parts(content: bytes, inner: str) -> str:
    """Text of the XML or HTML parts of a zipped document (odt, odp, epub) whose names match `inner`, in order."""
    number = lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            found = []
            for name in sorted((n for n in z.namelist() if re.search(inner, n)), key=number):
                raw = z.read(name)
                if name.endswith(("html", "htm")):
                    found.append(" ".join(Outline(raw.decode(errors="replace")).visible))
                else:
                    lines = ("".join(t.itertext()).strip() for t in ElementTree.fromstring(raw).iter() if t.tag.rpartition("}")[2] in ("p", "h"))
                    found.append("\n".join(x for x in lines if x))
    except (zipfile.BadZipFile, ElementTree.ParseError, OSError, RuntimeError) as error:  # RuntimeError: encrypted
        raise ValueError(str(error)) from error
    return "\n\n".join(x for x in found if x)


# Which parts of zipped documents hold their text.
PARTS = {"odt": r"^content\.xml$", "odp": r"^content\.xml$", "epub": r"\.x?html?$"}
#: Readers of a file's bytes by extension.
READERS: dict[str, Callable[[bytes], str]] = {
    **dict.fromkeys(("txt", "md"), plain_text), "html": page_file, "eml": mail_text, "msg": msg_text, "rtf": rtf_text, "docx": docx_text, "pptx": pptx_text,
    **{ext: partial(zipped_parts, inner=inner) for ext, inner in PARTS.items()},
}


def zipped_text(files: DataFrame, inner: str) -> DataFrame:
    """S11 over rows of (path, content)."""
    return file_texts(files, {"zip": partial(zipped_parts, inner=inner)})


def rtf(files: DataFrame) -> DataFrame:
    """S11 over rows of (path, content)."""
    return file_texts(files, {"rtf": rtf_text})


def pdf_route(blocks: DataFrame, by: str, digital: int = 150, least: int = 50, sample: int = 5) -> DataFrame:
    """Each page read as digital text or by OCR, from characters on the page; the first pages say whether a file is digital at all."""
    chars = blocks.groupBy(by, "page_num").agg(F.sum(F.length("text")).alias("chars"))
    head = chars.filter(F.col("page_num") <= sample).groupBy(by).agg((F.avg("chars") > digital).alias("digital"))
    return chars.join(head, by, "left").withColumn("route", F.when(F.coalesce("digital", F.lit(False)) & (F.col("chars") >= least), "text").otherwise("ocr"))


def exported_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of an export file {meta, records: [...]}."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("records").alias("r")).select("r.*")


def transcript_choice(tracks: DataFrame, by: str, preferred: list[str]) -> DataFrame:
    """Of each video the transcript in the first preferred language, made by hand before made by machine."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in preferred]), F.col("lang")), F.lit(0))
    order = F.struct(F.when(place > 0, place).otherwise(F.lit(len(preferred) + 1)), F.col("generated"), F.col("lang"))
    return tracks.groupBy(by).agg(F.min_by(F.struct("lang", "generated", "text"), order).alias("t")).select(by, "t.*")


Extractor = Callable[[DataFrame], DataFrame]


class Registry:
    """Extractors by extension; models (OCR, speech, embedding, text) are functions that the user injects here.

    `read` has readers of one file's bytes, which share one pass over all files; `by_ext` has functions of frames, each with a
    pass of its own over the files of its kind, and comes first.
    """

    def __init__(self) -> None:
        self.read: dict[str, Callable[[bytes], str]] = dict(READERS)
        self.by_ext: dict[str, Extractor] = {"pdf": lambda files: pdf(files).select("path", "text", "status", "error"), "csv": workbook_texts, "tsv": workbook_texts, "xlsx": workbook_texts, "ods": workbook_texts}

    def register(self, *exts: str) -> Callable[[Extractor], Extractor]:
        def add(f: Extractor) -> Extractor:
            self.by_ext |= dict.fromkeys(exts, f)
            return f

        return add

    def extract(self, files: DataFrame) -> DataFrame:
        """Each file by its kind; kinds without an extractor are failures, as rows."""
        kind = detected(F.col("path"), F.col("content"))
        kinds = files.withColumn("kind", kind)
        own = F.coalesce(F.col("kind").isin(*self.by_ext), F.lit(False)) if self.by_ext else F.lit(False)
        found = file_texts(kinds.filter(~own), self.read, F.col("kind"))
        groups: dict[Extractor, list[str]] = {}
        for ext, f in self.by_ext.items():
            groups.setdefault(f, []).append(ext)
        for f, exts in groups.items():
            found = found.unionByName(f(kinds.filter(F.col("kind").isin(*exts))).select("path", "text", "status", "error"))
        return found


def with_model(rows: DataFrame, name: str, kind: str, model: Callable[[pd.Series], pd.Series], column: str) -> DataFrame:
    """A column by an injected model over Arrow batches."""
    return rows.withColumn(name, F.pandas_udf(model, kind)(column))


def structured_call(rows: DataFrame, model: Callable[[pd.Series], pd.Series], prompt: str, parse: Callable[[Column], Column], attempts: int = 3) -> DataFrame:
    """`answer` and `parsed`, the model being asked again, with a correction, for the rows whose answer doesn't parse; at most `attempts` times.

    Each round is kept until the caller's session ends, so that a row is asked no more often than it fails; what a lost
    executor had kept is asked again.
    """
    ask, asked, open_ = F.pandas_udf(model, "string"), prompt, rows
    done = None
    for turn in range(attempts):
        answered = open_.withColumn("answer", ask(asked)).withColumn("parsed", parse(F.col("answer"))).persist(StorageLevel.MEMORY_AND_DISK)
        part = answered if turn == attempts - 1 else answered.filter("parsed IS NOT NULL")
        part = part.select(*[F.col(f"`{c}`") for c in rows.columns], "answer", "parsed")
        done = part if done is None else done.unionByName(part)
        open_ = answered.filter("parsed IS NULL").drop("answer", "parsed")
        open_, asked = (open_.withColumn("asked_again", F.concat(F.col(prompt), F.lit("\nAnswer with valid JSON only."))), "asked_again") if asked == prompt else (open_, asked)
    return done
