"""Phrase collocation mining: weighted n-grams of distinct pieces, counted out of core in DuckDB per hash bucket.

Texts are cut into pieces, and identical pieces of one lang become one piece with a multiplicity, so that boilerplate is cut
into words once. Phrases grow a word a round: each task gathers the n-grams of its pieces in blocks (one row for each distinct
n-gram of a block, weighted by multiplicity), these are shuffled to hash buckets, and DuckDB sums each bucket, spilling what
memory doesn't hold, and keeps the phrases that occur often enough. A phrase can only be frequent if both its (n-1)-word parts
are, so the next round leaves out n-grams with a part that isn't in a bitmap of the frequent ones' hashes. The bitmap has a
fixed number of bits: two phrases that share a bit cost work, never a result; counts are by the words themselves.

A candidate's parts are looked up by shuffled requests: every sender (a hash range of candidates) asks once for each distinct
part, so a part that a third of the candidates share is a few rows, and the answers go back to the senders. Scores are whole
numbers of up to 38 digits.

Empty cases: a null text counts as empty, a null lang as `und`; a null doc_id is of no account; repeated rows count each
time; a text is read whole, however long, and a long piece is counted in segments; an empty table gives an empty result. Other columns
are neither read nor returned. DuckDB spills to a folder that only the running task uses and removes.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pipeline_io import shared_folder
from .textbytes import mix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PIECE_END, BLANK = r"[.,;:!?\x0A-\x0D]+", r"[\x20\x09]+"
LEAST, MOST_WORDS, TOP, WHOLE_PERCENT = 100, 5, 2000, 100
#: Words and bytes that a task gathers before it hands on their n-grams, words of a segment; bits of the bitmaps; bytes of text and memory of a bucket.
BLOCK_WORDS, BLOCK_BYTES, SEGMENT_WORDS, BITS, BUCKET_BYTES, BUCKET_MEMORY = 800_000, 32_000_000, 200_000, 1 << 25, 16_000_000, "256MB"
SENDERS, SLICES = 256, 16
#: What is sent: lang and phrase as one key, parted by a line end, which no phrase holds. What is kept of it.
SENT, KEPT = "key string, n long", "lang string, phrase string, mark long, n long"
SENT_ARROW = pa.schema([("key", pa.string()), ("n", pa.int64())])
KEPT_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("mark", pa.int64()), ("n", pa.int64())])
PACKED = "lang string, pieces string, n binary, n_words binary, words long"
PACKED_ARROW = pa.schema([("lang", pa.string()), ("pieces", pa.string()), ("n", pa.binary()), ("n_words", pa.binary()), ("words", pa.int64())])
U = np.uint64
STEP = U(0x9E3779B97F4A7C15)


def pieces(docs: DataFrame, most_words: int) -> DataFrame:
    """(lang, piece, n, n_words): the distinct pieces of each lang, words parted by one space, with their multiplicities.

    A piece of over SEGMENT_WORDS words is cut into segments of so many, its n_words, which the next segment's first words follow.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), low.alias("low"))
    single = F.when(F.col("low").contains("  ") | F.col("low").contains("\t"), F.regexp_replace("low", BLANK, " ")).otherwise(F.col("low"))
    cut = rows.withColumn("low", single).select("lang", F.explode(F.split("low", PIECE_END)).alias("raw"))
    once = cut.select("lang", F.trim("raw").alias("piece")).filter("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("n"))
    once = once.withColumn("n_words", (F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1).cast("long"))
    words, size = F.split("piece", " "), F.col("n_words").cast("int")
    segment = lambda i: F.struct(F.array_join(F.slice(words, i + 1, F.lit(SEGMENT_WORDS + most_words - 1)), " ").alias("piece"), F.least(size - i, F.lit(SEGMENT_WORDS)).cast("long").alias("n_words"))
    parts = F.when(size <= SEGMENT_WORDS, F.array(F.struct("piece", "n_words"))).otherwise(F.transform(F.sequence(F.lit(0), size - 1, F.lit(SEGMENT_WORDS)), segment))
    return once.select("lang", "n", F.inline(parts))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of pieces put together until they hold BLOCK_WORDS words or BLOCK_BYTES."""
    held, words, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        words, size = words + (pc.sum(batch["n_words"]).as_py() or 0), size + batch.nbytes
        if words >= BLOCK_WORDS or size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held)
            held, words, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of a block and a lang as one row, which each round reads at less cost than a row for each piece."""
    for block in blocks(batches):
        coded = block["lang"].combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        numbers, rows = coded.indices.to_numpy(), []
        order = np.argsort(numbers, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1) if len(order) else []:
            part = block.take(pa.array(own))
            lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), part["piece"].combine_chunks())
            n, n_words = part["n"].to_numpy(), part["n_words"].to_numpy()
            rows.append((part["lang"][0].as_py(), pc.binary_join(lists, "\n")[0].as_py(), n.tobytes(), n_words.tobytes(), int((n * n_words).sum())))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PACKED_ARROW)], schema=PACKED_ARROW)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            piece = pc.split_pattern(batch["pieces"].slice(i, 1), "\n").flatten()
            n, n_words = (pa.array(np.frombuffer(batch[c][i].as_buffer(), np.int64)) for c in ("n", "n_words"))
            lang = batch["lang"].take(pa.array(np.full(len(piece), i)))
            yield pa.RecordBatch.from_arrays([lang, piece, n, n_words], names=["lang", "piece", "n", "n_words"])


def number_of(values: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each value among the distinct ones, and the hashes of these."""
    coded = values.combine_chunks().dictionary_encode()
    coded = pa.chunked_array([coded]).combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy().astype(np.int64), np.array([xxhash.xxh64_intdigest(x) for x in coded.dictionary.to_pylist()], U)


def marked(totals: np.ndarray) -> np.ndarray:
    return mix(totals).view(np.int64)


def mark_of(lang: str, phrase: str) -> int:
    """The hash of one phrase before mixing, as grams_of makes it of many."""
    total = xxhash.xxh64_intdigest(lang)
    for word in phrase.split(" "):
        total = (total * int(STEP) + xxhash.xxh64_intdigest(word)) & 0xFFFFFFFFFFFFFFFF
    return total


def grams_of(block: pa.Table, width: int, frequent: np.ndarray | None) -> pa.Table:
    """(key, n): the block's distinct n-grams of `width` words whose parts of one word less are in the bitmap `frequent`."""
    lists = pc.split_pattern(block["piece"].combine_chunks(), " ")
    words = lists.flatten()
    lengths = np.diff(lists.offsets.to_numpy())
    piece = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(piece))  # words from here to the end of the piece
    own = lengths[piece] - left < block["n_words"].to_numpy()[piece]  # what follows is the next segment's to count
    word_no, word_hash = number_of(pa.chunked_array([words]))
    lang_no, lang_hash = number_of(block["lang"])
    hashes = word_hash[word_no]

    def marks(at: np.ndarray, n: int) -> np.ndarray:
        total = lang_hash[lang_no[piece[at]]]
        for k in range(n):
            total = total * STEP + hashes[at + k]
        return marked(total)

    at = np.flatnonzero((left >= width) & own)
    if frequent is not None and len(at):
        part = np.flatnonzero(left >= width - 1)
        bit = marks(part, width - 1).view(U) & U(BITS - 1)
        known = np.zeros(len(left) + 1, bool)
        known[part] = (frequent[(bit >> U(3)).astype(np.int64)] >> (bit & U(7)).astype(np.uint8)) & 1 == 1
        at = at[known[at] & known[at + 1]]
    # equal n-grams get one number, built from the first word on, and only their first places become text
    number, size = lang_no[piece[at]], max(len(word_hash), 1)
    for k in range(width):
        number = np.unique(number * size + word_no[at + k], return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    edges = np.flatnonzero(np.diff(number[order], prepend=-1))
    first = at[order[edges]] if len(at) else at
    total = np.add.reduceat(block["n"].to_numpy()[piece[at[order]]], edges) if len(at) else np.zeros(0, np.int64)
    langs = block["lang"].combine_chunks().take(pa.array(piece[first]))
    phrase = pc.binary_join_element_wise(*[words.take(pa.array(first + k)) for k in range(width)], " ") if width > 1 else words.take(pa.array(first))
    return pa.Table.from_arrays([pc.binary_join_element_wise(langs, phrase, "\n"), pa.array(total)], schema=SENT_ARROW)


def counted(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The sums of one hash bucket's n-grams, of those that reach `least`."""
    with tempfile.TemporaryDirectory(prefix="bucket-") as spill, duckdb.connect(config={"threads": 1, "memory_limit": BUCKET_MEMORY, "temp_directory": spill, "preserve_insertion_order": False}) as con:
        con.register("sent", pa.RecordBatchReader.from_batches(SENT_ARROW, (pa.RecordBatch.from_arrays(b.columns, schema=SENT_ARROW) for b in batches)))
        for batch in con.execute("SELECT key, sum(n)::BIGINT AS n FROM sent GROUP BY key HAVING sum(n) >= ?", [least]).to_arrow_reader(100_000):
            lang, phrase = zip(*(k.rsplit("\n", 1) for k in batch["key"].to_pylist()), strict=True)
            mark = marked(np.array([mark_of(a, b) for a, b in zip(lang, phrase, strict=True)], U))
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(phrase), pa.array(mark), batch["n"].cast(pa.int64())], schema=KEPT_ARROW)


def bitmap_of(counts: DataFrame) -> np.ndarray:
    """The marks' bits, BITS in all: at most BITS / 8 bytes come to the driver."""
    bit = counts.select((F.col("mark").bitwiseAND(F.lit(BITS - 1)) + 1).alias("bit"))
    parts = bit.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in parts:
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def frequent_phrases(spark: SparkSession, distinct: DataFrame, folder: str, buckets: int, least: int, most_words: int) -> DataFrame:
    """(lang, phrase, mark, n, width): all phrases of 1 to `most_words` words that occur `least` times or more, written to the folder."""
    bits = None
    for width in range(1, most_words + 1):
        sent = spark.sparkContext.broadcast(bits)  # BITS / 8 bytes

        def emit(batches: Iterator[pa.RecordBatch], width: int = width, sent: object = sent) -> Iterator[pa.RecordBatch]:
            for block in blocks(unpacked(batches)):
                yield from grams_of(block, width, sent.value).to_batches(max_chunksize=50_000)

        count = lambda batches: counted(batches, least)
        path = f"{folder}/phrases/width={width}"
        distinct.select("lang", "pieces", "n", "n_words").mapInArrow(emit, SENT).repartition(buckets, "key").mapInArrow(count, KEPT).write.parquet(path)
        if width < most_words:
            bits = bitmap_of(spark.read.schema(KEPT).parquet(path))
    return spark.read.schema(f"{KEPT}, width int").parquet(f"{folder}/phrases")


def scored(phrases: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score, width) of the phrases of two words or more: their lowest-scoring cut, the earliest of equals."""
    whole = F.split("phrase", " ")
    candidates = phrases.filter("width > 1").select("lang", "phrase", F.col("n").alias("a"), "width", F.pmod(F.xxhash64("lang", "phrase"), F.lit(SENDERS)).alias("sender"))
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("width") - 1)))
    cuts = cuts.withColumns({"left": F.array_join(F.slice(whole, F.lit(1), F.col("cut")), " "), "right": F.array_join(F.slice(whole, F.col("cut") + 1, F.col("width")), " ")})
    # requests: every sender asks once for each part
    asked = cuts.select("lang", "sender", F.explode(F.array("left", "right")).alias("part")).distinct()
    known = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("count"))
    answers = asked.join(known, ["lang", "part"])
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(answers.select("lang", "sender", F.col("part").alias(side), F.col("count").alias(name)), ["lang", "sender", side])
    cuts = cuts.join(sizes, "lang")
    number = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    cuts = cuts.withColumns({"above": number("a", 17) * F.lit(1000).cast("decimal(4,0)") * number("n", 15), "under": number("l", 18) * number("r", 18)})
    cuts = cuts.withColumn("score", F.expr("above DIV under"))
    lowest = cuts.groupBy("lang", "phrase", "a", "n", "width").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    return lowest.select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score", "width")


def independent(candidates: DataFrame, phrases: DataFrame, whole_percent: int, most_words: int) -> DataFrame:
    """Candidates without those that lie inside a longer one which makes up `whole_percent` of their occurrences or more."""
    words = F.split("phrase", " ")
    inside = [(start, n) for n in range(2, most_words) for start in range(1, most_words - n + 2)]
    parts = F.array(*[F.when((F.col("width") > n) & (F.col("width") >= start + n - 1), F.array_join(F.slice(words, start, n), " ")) for start, n in inside])
    longer = phrases.filter("width > 2").select("lang", F.explode(F.array_distinct(F.array_compact(parts))).alias("phrase"), "n")
    most = longer.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    found = candidates.join(most, ["lang", "phrase"], "left")
    return found.filter(F.coalesce(F.col("most"), F.lit(0)) * 100 < F.col("a") * whole_percent).drop("most")


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, whole_percent: int = WHOLE_PERCENT) -> DataFrame:
    """Each lang's first `top` phrases: lang, rank, phrase, a (its occurrences), l and r (its parts'), n (the lang's words), score."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    pieces(docs, most_words).select("lang", "piece", "n", "n_words").mapInArrow(packed, PACKED).write.parquet(f"{folder}/pieces")
    distinct = spark.read.parquet(f"{folder}/pieces")
    size = distinct.agg(F.coalesce(F.sum(F.octet_length("pieces").cast("long")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    phrases = frequent_phrases(spark, distinct, folder, buckets, least, most_words)
    sizes = distinct.groupBy("lang").agg(F.sum("words").alias("n"))
    rows = independent(scored(phrases, sizes), phrases, whole_percent, most_words)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first among slices of a lang, then among what these leave: `top` rows a slice
    slice_ = F.pmod(F.xxhash64("phrase"), F.lit(SLICES)).alias("slice")
    few = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", slice_).orderBy(*best))).filter(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
