"""Text columns: cleaning, sentences, chunk building, titles, summaries. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET, LIMIT, OVERLAP, LEAST_CHARS, LEAST_ALPHA = 2000, 3200, 600, 100, 0.10
SENTENCE_GAP = r"""(?U)(?<=[.!?])\s+(?=[A-Z"'])"""
HEADING = r"(?m)(?d)^#{1,4}\s+.+$"
SCHEMES = r"https?://"


def stripped(c: Column) -> Column:
    """Without white space at the ends (Unicode's, like Python's strip)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def without_nulls(c: Column) -> Column:
    """NUL characters removed."""
    return F.translate(c, "\u0000", "")


def without_nulls_in(c: Column, kind: T.DataType) -> Column:
    """NUL characters removed from every string in a value of any nesting: arrays, maps (their values) and structs."""
    if isinstance(kind, T.StringType):
        return without_nulls(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: without_nulls_in(x, kind.elementType)) if holds_text(kind) else c
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: without_nulls_in(x, kind.valueType)) if holds_text(kind.valueType) else c
    if isinstance(kind, T.StructType) and holds_text(kind):
        return F.when(c.isNotNull(), F.struct(*[without_nulls_in(c.getField(f.name), f.dataType).alias(f.name) for f in kind]))
    return c


def holds_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(holds_text(f.dataType) for f in kind)
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType if isinstance(kind, T.MapType) else None
    return isinstance(kind, T.StringType) or (inner is not None and holds_text(inner))


def nul_free(rows: DataFrame) -> DataFrame:
    """a frame without NUL characters, whatever its columns hold."""
    return rows.select(*[without_nulls_in(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema])


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def alpha_ratio(c: Column) -> Column:
    """Letters per character (0 for empty text)."""
    return F.when(F.length(c) > 0, letters(c) / F.length(c)).otherwise(F.lit(0.0))


def word_count(c: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_count(c, F.lit(r"(?U)\S+")).cast("long")


def token_count(c: Column) -> Column:
    """A quarter of the characters; pass a counting column of your own where a tokenizer is at hand."""
    return F.floor(F.length(c) / 4).cast("long")


def sentences(c: Column) -> Column:
    """Sentences, stripped, without empty ones."""
    parts = F.split(c, SENTENCE_GAP, -1)
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def sentence_windows(parts: Column, window: int = 3, step: int = 2) -> Column:
    """Windows of `window` sentences, `step` apart."""

    def windows(own: Column) -> Column:
        starts = F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own), F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(own, i, window), " "))

    # the sentences are a lambda's variable, else they would be split again for each window
    return F.element_at(F.transform(F.array(parts), windows), 1)


def paragraphs(c: Column) -> Column:
    """Parts between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, "\n\n", -1), stripped), lambda p: p != "")


def good_chunk(c: Column) -> Column:
    """long enough, and enough letters."""
    return (F.length(c) >= LEAST_CHARS) & (F.length(stripped(c)) >= LEAST_CHARS) & (alpha_ratio(c) >= LEAST_ALPHA)


def has_heading(c: Column) -> Column:
    """Any Markdown heading of level 1 to 4."""
    return c.rlike(HEADING)


def web_clean(c: Column) -> Column:
    """Control characters to spaces, runs of blanks to one, stripped lines, no empty ones."""
    plain = F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "), r"[ \t]+", " ")
    return F.array_join(F.filter(F.transform(F.split(plain, "\n", -1), stripped), lambda x: x != ""), "\n")


def transcript_clean(c: Column) -> Column:
    """Bracketed and parenthesised notes removed, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"\[.*?\]", ""), r"\(.*?\)", "")
    return stripped(F.regexp_replace(bare, r"(?U)\s+", " "))


def html_strip(c: Column) -> Column:
    """Tags to spaces, white space collapsed."""
    return stripped(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"(?U)\s+", " "))


def html_title(c: Column) -> Column:
    """First title within the first 64 Ki characters."""
    return stripped(F.regexp_extract(F.substring(c, 1, 65536), r"(?is)<title[^>]*>(.*?)</title>", 1))


def meta_content(c: Column, name: str) -> Column:
    """Content of a named meta element."""
    return F.regexp_extract(c, rf"""(?is)<meta[^>]*name=["']{name}["'][^>]*content=["']([^"']*)["']""", 1)


def html_lang(c: Column) -> Column:
    return F.regexp_extract(c, r"""(?is)<html[^>]*\blang=["']([^"']*)["']""", 1)


def prefix_summary(c: Column, most: int = 1000) -> Column:
    """The first `most` characters, cut after the last sentence end beyond their half, with an ellipsis."""
    head = F.substring(c, 1, most)
    back = F.instr(F.reverse(head), " .")
    end = F.when(back > 0, F.length(head) - back).otherwise(F.lit(0))  # characters up to and with the full stop
    cut = F.when(end - 1 > most / 2, F.substring(head, F.lit(1), end)).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(cut, F.lit("...")))


def lead_summary(c: Column, n: int = 4) -> Column:
    """The first n sentences."""
    found = F.filter(F.split(c, r"(?<=[.!?])\s+", -1), lambda s: s != "")
    return F.when(F.size(found) <= n, c).otherwise(F.concat(F.array_join(F.slice(found, 1, n), " "), F.lit(" …")))


def short_title(c: Column, most: int = 30) -> Column:
    """The first characters, with an ellipsis if there are more."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def compressed(c: Column, most: int = 500) -> Column:
    """Cut, with an ellipsis character."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def file_name(c: Column) -> Column:
    """Base name without reserved characters, at most 255 long."""
    base = F.element_at(F.split(F.regexp_replace(c, r"\\", "/"), "/", -1), -1)
    clean = F.regexp_replace(F.regexp_replace(base, r"(?U)[^\w\s.\-]", "_"), r"_+", "_")
    return F.substring(F.when(clean == "", F.lit("file")).otherwise(clean), 1, 255)


def variable_name(c: Column) -> Column:
    """A name usable as a variable; number repeats with `row_number() - 1` over it."""
    stem = F.lower(F.regexp_replace(c, r"\.[^.]*$", ""))
    clean = F.regexp_replace(F.regexp_replace(stem, r"[^a-z0-9_]", "_"), r"^_+|_+$", "")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).when(clean == "", F.lit("data")).otherwise(clean)


def human_size(c: Column) -> Column:
    """Bytes as B, KB or MB."""
    return (
        F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
        .when(c < 1024 * 1024, F.concat(F.format_string("%.1f", F.bround(c / 1024, 1)), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", F.bround(c / 1048576, 1)), F.lit(" MB")))
    )


def two_decimals(c: Column) -> Column:
    """A number with two decimals, rounded from its exact value with halves to even, as printf and Python do (Java goes by its shortest decimals, halves up)."""
    size = F.abs(c)
    part = ((size - F.floor(size)) * float(1 << 60)).cast("long").cast("decimal(20,0)") * 100  # exact: what 60 bits lack is below half a hundredth
    one = F.lit(1 << 60).cast("decimal(20,0)")
    down = F.call_function("div", part, one)
    rest = part - down * one
    cents = F.floor(size) * 100 + down + ((2 * rest > one) | ((2 * rest == one) & (down % 2 == 1))).cast("long")
    text = F.concat(F.when(c < 0, "-").otherwise(""), F.call_function("div", cents, F.lit(100)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when(size < 1e15, text).otherwise(F.format_string("%.2f", c))


def filled_template(template: str, values: dict[str, Column]) -> Column:
    """Placeholders {{name}} replaced literally, in the order given."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


def code_clean(c: Column) -> Column:
    """Line ends unified, stripped."""
    return stripped(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))


def without_fences(c: Column) -> Column:
    """Lines of code without the fence lines around them."""
    return F.array_join(F.filter(F.split(stripped(c), "\n", -1), lambda x: ~stripped(x).startswith("```")), "\n")


def imports(c: Column) -> Column:
    """Top-level modules imported by Python source, in order of first use."""
    found = F.regexp_extract_all(c, F.lit(r"(?m)^\s*(?:import|from)\s+([A-Za-z_]\w*)"), 1)
    return F.array_distinct(found)


def closed_fences(c: Column) -> Column:
    """C11: text with an odd number of fences gets a closing one."""
    return F.when(F.regexp_count(c, F.lit(r"(?m)^`{3,}")) % 2 == 1, F.concat(c, F.lit("\n```"))).otherwise(c)


def no_adjacent_repeats(words: Column) -> Column:
    """Words equal to the one before (in any case) removed."""
    return F.filter(words, lambda w, i: (i == 0) | (F.lower(w) != F.lower(F.get(words, i - 1))))


def capitalized(c: Column) -> Column:
    """First character in upper case, the rest in lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def slide_text(title: Column, bullets: Column, notes: Column, content: Column) -> Column:
    """Bullets, notes and content by line, or else the title."""
    joined = F.concat_ws("\n", bullets, F.nullif(notes, F.lit("")), F.nullif(content, F.lit("")))
    return F.when(joined == "", title).otherwise(joined)


def presentable(c: Column) -> Column:
    """A whole HTML page without scripts, with a doctype and fixed heights."""
    bare = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", "")
    sized = F.replace(bare, F.lit("100vh"), F.lit("1080px"))
    return F.when(F.lower(F.ltrim(sized)).startswith("<!doctype"), sized).otherwise(F.concat(F.lit("<!DOCTYPE html>\n"), sized))


def slide_count(c: Column) -> Column:
    """Elements of class slide."""
    return F.regexp_count(c, F.lit(r"""(?i)<[a-z]+[^>]*\bclass=["'](?:[^"']*\s)?slide(?:\s[^"']*)?["']"""))


def slides(c: Column) -> Column:
    """Array of (title, text, html) of the elements of class slide, each up to the next one."""
    start = r"""(?i)<[a-z]+[^>]*\bclass=["'](?:[^"']*\s)?slide(?:\s[^"']*)?["']"""
    parts = F.split(F.regexp_replace(c, start, "\u0001$0"), "\u0001", -1)
    found = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    title = lambda x: stripped(F.regexp_replace(F.regexp_extract(x, r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", 1), r"<[^>]+>", ""))
    return F.transform(found, lambda x: F.struct(title(x).alias("title"), html_strip(x).alias("text"), x.alias("html")))


def markdown_table(rows: Column, escape: bool = False) -> Column:
    """Array of rows (arrays of cells) as a Markdown table; rows are padded or cut to the header's width."""
    width = F.size(rows[0])

    def line(row: Column) -> Column:
        cells = F.slice(F.concat(F.transform(row, lambda x: F.coalesce(x, F.lit(""))), F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0)))), F.lit(1), width)
        if escape:
            cells = F.transform(cells, lambda x: F.replace(x, F.lit("|"), F.lit("\\|")))
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    head = F.array(line(rows[0]), F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |")))
    body = F.filter(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.exists(r, lambda x: F.coalesce(x, F.lit("")) != "") if escape else F.lit(True))
    return F.array_join(F.concat(head, F.transform(body, line)), "\n")
