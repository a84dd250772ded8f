"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window of `window` words keeps the least hash of its `gram`-word grams, so equal windows keep equal hashes: every shared
span of `window` words or more is found. Consecutive windows that keep the same hash are one fingerprint, with the run of
their places. Documents' fingerprints are joined with the benchmark's, and each hit is extended over its run: every window
of it is compared word by word with the benchmark's windows. Items of fewer words are one window of their own length, and
keep the least hash of their grams (of all their words, if these are fewer than a gram). One pass over the documents makes
the fingerprints of all lengths.

Empty cases: null or wordless texts have no windows; items with a null item_id take no part, rows that repeat an item_id
count as one item; a null or repeated doc_id is answered row by row like any other (rows are told apart by their texts, and
equal rows get equal answers); a text is read whole, however long; an empty table gives an empty result, an empty benchmark
leaves all documents clean; columns named like the new ones are replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, GRAM, BROADCAST_BYTES = 10, 5, 64_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """Words of the text in ASCII lower case; none of a null text."""
    plain = F.octet_length(text) == F.length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), NO_WORD), "")


def gram_hashes(words: Column, n: int) -> Column:
    """Hash of the n words from each position on."""
    heads = F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return F.transform(heads, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, n)]))


def fingerprints(frame: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """frame, whose words are w, with marks: for each length n and run of windows of n words that keep the same hash, (n, at, upto, mark).

    Grams and least hashes are columns of their own: inside a lambda they would be made anew for every element.
    """
    kept = frame.columns
    for g in sorted({min(gram, n) for n in lengths}):
        frame = frame.withColumn(f"grams_{g}", gram_hashes(F.col("w"), g))
    for n in lengths:
        grams, beside = F.col(f"grams_{min(gram, n)}"), n - min(gram, n)
        if beside:
            heads = F.slice(grams, F.lit(1), F.greatest(F.size(grams) - beside, F.lit(0)))
            least = F.transform(heads, lambda h, i: F.least(h, *[F.get(grams, i + k) for k in range(1, beside + 1)]))  # noqa: B023
        else:
            least = grams
        frame = frame.withColumn(f"least_{n}", least)
    for n in lengths:
        least = F.col(f"least_{n}")
        fresh = F.transform(least, lambda h, i: F.when((i == 0) | (h != F.get(least, i - 1)), F.struct(i.alias("at"), h.alias("mark"))))  # noqa: B023
        frame = frame.withColumn(f"fresh_{n}", F.filter(fresh, lambda x: x.isNotNull()))
    runs = []
    for n in lengths:
        fresh, last = F.col(f"fresh_{n}"), F.size(f"least_{n}") - 1
        until = lambda i: F.coalesce(F.get(fresh, i + 1)["at"] - 1, last)  # noqa: E731, B023
        runs.append(F.transform(fresh, lambda x, i: F.struct(F.lit(n).alias("n"), x["at"].alias("at"), until(i).alias("upto"), x["mark"].alias("mark"))))  # noqa: B023
    return frame.select(*kept, F.concat(*runs).alias("marks"))


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """(n, words, item_ids): the distinct windows of the items, n words each."""
    each = items.select(F.col("item_id").cast("string").alias("item_id"), word_array(F.col("text")).alias("w")).filter("item_id IS NOT NULL AND size(w) > 0")
    n = F.least(F.size("w"), F.lit(window))
    each = each.select("item_id", "w", n.alias("n")).select(
        "item_id", "n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " ")))).alias("words")
    )
    return each.groupBy("n", "words").agg(F.collect_set("item_id").alias("item_ids"))


def bounded(side: DataFrame, size: Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """`side`, to be broadcast if its rows' sizes sum to at most `most` bytes; a larger one is left to a shuffled join."""
    return F.broadcast(side) if side.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= most else side


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with n_words, n_hit (words in occurrences of windows) and item_ids (of the items that occur)."""
    known = windows_of(items, window)
    lengths = sorted(r[0] for r in known.select("n").distinct().collect())  # `window` of them at most
    text = F.col("text").cast("string")
    key = [F.col("doc_id"), F.xxhash64(text).alias("text_hash")]  # doc_id may repeat
    kept = [c for c in docs.columns if c not in ("n_words", "n_hit", "item_ids")]
    old, back = [F.col(f"`{c}`").alias(f"old_{i}") for i, c in enumerate(kept)], [F.col(f"old_{i}").alias(c) for i, c in enumerate(kept)]
    whole = docs.select(*key, *old, F.size(word_array(text)).cast("long").alias("n_words"))
    if not lengths:
        return whole.select(*back, "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"))
    theirs = fingerprints(known.select(F.col("n").alias("own"), F.split("words", " ").alias("w")), lengths, gram)
    # a window is one run of its own length
    theirs = theirs.select("own", F.inline_outer("marks")).filter("n = own").select("n", "mark").distinct()
    # the outer form: from the inner one the optimizer infers a filter that makes all hashes a second time
    ours = fingerprints(docs.select(*key, word_array(text).alias("w")), lengths, gram).select("doc_id", "text_hash", F.inline_outer("marks"))
    found = ours.join(bounded(theirs, F.lit(16)), ["n", "mark"], "left_semi")
    hits = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("n", "at", "upto")).alias("hits")).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "hits")
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
    near = docs.select(*key, text.alias("text")).join(hits, same).select("doc_id", "text_hash", "hits", word_array(F.col("text")).alias("w"))

    def tried(h: Column) -> Column:
        """The windows of a hit's run. It names w twice, else the optimizer moves the splitting of the text into this function."""
        window = lambda at: F.when(F.size("w") >= at + h["n"], F.array_join(F.slice("w", at + 1, h["n"]), " "))
        return F.transform(F.sequence(h["at"], h["upto"]), lambda at: F.struct(h["n"].alias("n"), at.alias("at"), window(at).alias("words")))

    tries = near.select("doc_id", "text_hash", F.flatten(F.transform("hits", tried)).alias("tries")).select("doc_id", "text_hash", F.inline_outer("tries"))
    weight = F.octet_length("words") + F.aggregate("item_ids", F.lit(0), lambda n, x: n + F.octet_length(x) + 8) + 32
    sure = (
        tries.join(bounded(known, weight), ["n", "words"])
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("end")))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"))
        .select(F.col("doc_id").alias("sure_id"), F.col("text_hash").alias("sure_hash"), "spans", "item_ids")
    )
    covered = F.aggregate(
        F.coalesce("spans", F.array().cast("array<struct<at:int,end:int>>")),
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["upto"], x["end"]).alias("upto"), (s["n"] + F.greatest(x["end"] - F.greatest(x["at"], s["upto"]), F.lit(0))).alias("n")),
        lambda s: s["n"],
    )
    checked = whole.join(sure, F.col("doc_id").eqNullSafe(F.col("sure_id")) & (F.col("text_hash") == F.col("sure_hash")), "left")
    return checked.select(*back, "n_words", covered.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
