"""Fill-in-the-middle transformation by escaped marker injection, with DataFrame functions only.

A marker is escaped in the text, then regexp_replace appends it after every unit (a run of ASCII letters, or one other code
point). Counting the markers counts the units, substring_index takes the parts before, between and after two of them, and
what is taken is cleared of markers and unescaped. An escaped character is one unit, as its plain form was, so a cut never
falls into an escape. Cuts and form come from a hash of doc_id, so that reruns agree and rows need nothing from each other:
there is no shuffle.

Empty cases: a null text counts as empty; an empty text, and one that holds a sentinel, is left plain; a null doc_id
counts as the empty string; rows that repeat get equal answers; a text is read whole (it may double while it is marked, so
one of over 1 GB is too long for a Spark string); an empty table gives an empty result; columns named like the new ones
are replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marker, and the character that begins the escaped forms of both.
MARK, ESCAPE = "\x01", "\x02"
UNIT = rf"[A-Za-z]+|{ESCAPE}[01]|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def swapped(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def marked(text: Column) -> Column:
    """The text with a marker after every unit; its own markers and escapes are escaped."""
    return F.regexp_replace(swapped(swapped(text, ESCAPE, f"{ESCAPE}0"), MARK, f"{ESCAPE}1"), UNIT, f"$0{MARK}")


def plain(c: Column) -> Column:
    """A part of a marked text as it was."""
    return swapped(swapped(swapped(c, MARK, ""), f"{ESCAPE}1", MARK), f"{ESCAPE}0", ESCAPE)


def draws(doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of doc_id."""
    digits = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_middle(docs: DataFrame, plain_from: int = 90, suffix_first_below: int = 20) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix, middle, suffix (null in a plain form) and output.

    Of every hundred draws those from `plain_from` on leave a text plain; of the others' hundred, those below
    `suffix_first_below` put the suffix first.
    """
    new = ("n", "form", "prefix", "middle", "suffix", "output")
    kept = [c for c in docs.columns if c not in new]
    old = [F.col(f"`{c}`").alias(f"old_{i}") for i, c in enumerate(kept)]
    rows = docs.select(*old, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id")), 1)])
    rows = rows.withColumn("marked", marked(F.col("text")))
    rows = rows.withColumn("n", (F.length("marked") - F.length(swapped(F.col("marked"), MARK, ""))).cast("long"))
    rows = rows.withColumns({"cut_1": F.col("h1") % (F.col("n") + 1), "cut_2": F.col("h2") % (F.col("n") + 1)})
    rows = rows.withColumns({"first": F.least("cut_1", "cut_2"), "last": F.greatest("cut_1", "cut_2")})
    holds = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | holds | (F.col("h3") % 100 >= plain_from), "plain").when(F.col("h4") % 100 < suffix_first_below, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    ranked = lambda text, count: F.call_function("substring_index", text, F.lit(MARK), count.cast("int"))
    shaped = F.col("form") != "plain"
    rows = rows.withColumn("upto", F.when(shaped, ranked(F.col("marked"), F.col("last"))))
    rows = rows.select(
        *[f"old_{i}" for i in range(len(kept))], "text", "n", "form",
        F.when(shaped, plain(ranked(F.col("marked"), F.col("first")))).alias("prefix"),
        plain(ranked(F.col("upto"), F.col("first") - F.col("last"))).alias("middle"),
        F.when(shaped, plain(ranked(F.col("marked"), F.col("last") - F.col("n") - 1))).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select(*[F.col(f"old_{i}").alias(c) for i, c in enumerate(kept)], "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text from which an output of the form was made.

    No part holds a sentinel, and none overlaps itself or another one, so the first found is the one that was put there.
    """

    def parts(second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(PREFIX) + 1))
        head = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(head) + len(second) + 1)
        mid = F.substring_index(rest, MIDDLE, 1)
        return head, mid, F.substr(rest, F.length(mid) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(SUFFIX)
    suffix_2, prefix_2, middle_2 = parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_2, middle_2, suffix_2)).otherwise(output)
