"""Numbers, vectors, JSON, lookups and small record rules as columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped


# vectors and scores
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 with a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    """M02"""
    return 1 / (1 + F.exp(-x))


def top_mean(scores: Column, n: int = 3) -> Column:
    """Mean of the first n scores."""
    head = F.slice(scores, 1, n)
    return F.when(F.size(head) > 0, F.aggregate(head, F.lit(0.0), lambda s, x: s + x) / F.size(head))


def answer_confidence(scores: Column, density: Column) -> Column:
    """From the best scores and the citation density; 0.5 without either."""
    relevance = F.when(F.size(scores) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (top_mean(scores) + 5) / 10)))
    cited = F.when(density > 0, F.least(F.lit(1.0), density / 3))
    both = F.when(relevance.isNotNull() & cited.isNotNull(), (relevance + cited) / 2).otherwise(F.coalesce(relevance, cited, F.lit(0.5)))
    return F.bround(both, 2)


def speech_confidence(segments: Column) -> Column:
    """Mean of words per second over 3, at most 1, in per cent; segments are (start, end, text)."""
    valid = F.filter(segments, lambda s: (s["end"] > s["start"]) & (stripped(s["text"]) != ""))
    rate = F.transform(valid, lambda s: F.least(F.lit(1.0), F.regexp_count(s["text"], F.lit(r"(?U)\S+")) / (s["end"] - s["start"]) / 3))
    return F.when(F.size(valid) > 0, F.aggregate(rate, F.lit(0.0), lambda a, x: a + x) / F.size(valid) * 100).otherwise(F.lit(0.0))


def speech_ms(text: Column, words_per_minute: int = 150) -> Column:
    """How long a text takes to speak, half a second at least."""
    return F.greatest(F.lit(500), (F.regexp_count(text, F.lit(r"(?U)\S+")) / words_per_minute * 60000).cast("int"))


def processing_seconds(duration: Column, model: Column, ratios: dict[str, float]) -> Column:
    """Duration times the ratio of a model (1 for an unknown one)."""
    return duration * F.coalesce(lookup(model, ratios), F.lit(1.0))


def month_bounds(day: Column) -> tuple[Column, Column]:
    """First day of the month, and of the next."""
    first = F.trunc(day, "month")
    return first, F.add_months(first, 1)


def minutes_before(now: Column, minutes: int) -> Column:
    """M11"""
    return now - F.make_dt_interval(mins=F.lit(minutes))


def progress(done: Column, total: Column) -> Column:
    """A quarter for the plan, the rest by parts done."""
    return F.round(F.lit(0.25) + F.lit(0.70) * done / F.greatest(total, F.lit(1)), 3)


def token_hash(c: Column) -> Column:
    """M17"""
    return F.sha2(c, 256)


# lookups and defaults
def lookup(key: Column, table: dict) -> Column:
    """Literal map lookup, null for an unknown key."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def or_default(c: Column, value: str) -> Column:
    """F16: the value for a null or empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(value))


def named_or_id(name: Column, key: Column, most: int = 8) -> Column:
    """A name, else the beginning of the id."""
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Source-"), F.substring(key, 1, most)))


def source_type(url: Column) -> Column:
    """T52"""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    return F.when(F.contains(host, F.lit("youtube.com")) | F.contains(host, F.lit("youtu.be")), "youtube").otherwise("url")


def youtube_id(url: Column) -> Column:
    """The id by the first of three forms of address."""
    forms = (r"(?:v=|/v/)([0-9A-Za-z_-]{11})", r"youtu\.be/([0-9A-Za-z_-]{11})", r"/(?:embed|shorts|live)/([0-9A-Za-z_-]{11})")
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in forms])


def public_https(url: Column) -> Column:
    """https, and no private or local address (names aren't resolved)."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.|\[?::1|\[?f[cd])")
    return F.lower(url).startswith("https://") & (host != "") & ~private


def search_terms(query: Column) -> Column:
    """C14: struct of the text and the file type asked for by filetype:..."""
    kind = F.lower(F.regexp_extract(query, r"(?i)\bfiletype:(\w+)", 1))
    return F.struct(stripped(F.regexp_replace(F.regexp_replace(query, r"(?i)\bfiletype:\w+", ""), r"\s+", " ")).alias("text"), F.nullif(kind, F.lit("")).alias("file_type"))


def date_bucket(at: Column, now: Column) -> Column:
    """By days before the day of `now`."""
    day = F.date_trunc("day", now)
    back = lambda n: day - F.make_dt_interval(days=F.lit(n))
    return F.when(at >= day, "Today").when(at >= back(1), "Yesterday").when(at >= back(7), "Previous 7 Days").otherwise("Older")


def mentions(title: Column, preview: Column, term: Column, default: str = "New Conversation") -> Column:
    """Title or preview holds the term, in any case."""
    low = F.lower(term)
    return F.contains(F.lower(or_default(title, default)), low) | F.contains(F.lower(F.coalesce(preview, F.lit(""))), low)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of the distinct words of a that are in b."""
    left = F.array_distinct(a)
    return F.when(F.size(left) > 0, F.size(F.array_intersect(left, b)) / F.size(left)).otherwise(F.lit(0.0))


def upload_problem(name: Column, size: Column, mime: Column, blocked_ext: tuple[str, ...], blocked_mime: tuple[str, ...], most_mb: int = 25) -> Column:
    """why a file isn't accepted; null if it is."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))
    return F.when(size > most_mb * 1024 * 1024, "too large").when(size == 0, "empty").when(ext.isin(*blocked_ext), "blocked extension").when(mime.isin(*blocked_mime), "blocked type")


# JSON from models
def json_clean(c: Column) -> Column:
    """Without reasoning, fences and lead-ins."""
    bare = stripped(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""))
    bare = stripped(F.regexp_replace(bare, r"(?im)^```(?:json)?\s*|\s*```\s*$", ""))
    return stripped(F.regexp_replace(bare, r"(?i)^(Here's|Here is|The JSON|Output:|Response:)\s*:?\s*", ""))


def json_block(c: Column) -> Column:
    """From the first opening brace or bracket to its last closing one; null if there is none."""
    brace, bracket = F.instr(c, "{"), F.instr(c, "[")
    curly = (brace > 0) & ((bracket == 0) | (brace < bracket))
    start = F.when(curly, brace).otherwise(bracket)
    back = F.when(curly, F.instr(F.reverse(c), "}")).otherwise(F.instr(F.reverse(c), "]"))
    end = F.length(c) - back + 1
    return F.when((start > 0) & (back > 0) & (end > start), F.substring(c, start, end - start + 1))


def json_repair(c: Column) -> Column:
    """Single quotes, missing and trailing commas."""
    quoted = F.regexp_replace(c, r"'([^']*)'(?=\s*[:,\}\]])", '"$1"')
    return F.regexp_replace(F.regexp_replace(quoted, r'"\s*\n\s*"', '",\n"'), r",(\s*[}\]])", "$1")


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def robust_json(c: Column) -> Column:
    """A variant by the first of: as it is, cleaned, its block, its block repaired; null if all fail."""
    in_block = lambda block: F.coalesce(F.try_parse_json(block), F.try_parse_json(json_repair(block)))
    return F.coalesce(F.try_parse_json(c), _with(json_clean(c), lambda clean: F.coalesce(F.try_parse_json(clean), _with(json_block(clean), in_block))))


def valid_items(raw: Column, schema: str, valid) -> Column:
    """the array items that satisfy `valid`; items that don't parse are null and go."""
    return F.filter(F.from_json(raw, schema), lambda x: x.isNotNull() & F.coalesce(valid(x), F.lit(False)))


def safe_map(c: Column) -> Column:
    """A JSON object as map of strings, empty if it isn't one."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def chapter(c: Column, number: Column) -> Column:
    """Title and first segment of a chapter under either of their names."""
    parsed = F.from_json(c, "title string, name string, startSegment int, start_segment int")
    return F.struct(F.coalesce(parsed["title"], parsed["name"], F.format_string("Chapter %d", number)).alias("title"), F.coalesce(parsed["startSegment"], parsed["start_segment"], F.lit(0)).alias("start"))


def tool_blocks(c: Column) -> Column:
    """Parts between --- lines: struct of source, tool and body."""
    parts = F.split(c, r"(?m)^\s*---\s*$", -1)
    head = r"(?s)^\s*\[Source (\d+) — ([^\]]+)\]\s*"
    return F.transform(parts, lambda p: F.struct(F.nullif(F.regexp_extract(p, head, 1), F.lit("")).cast("int").alias("source"), F.nullif(F.regexp_extract(p, head, 2), F.lit("")).alias("tool"), stripped(F.regexp_replace(p, head, "")).alias("body")))


def sse_frames(c: Column) -> Column:
    """Server-sent events of a stream: struct of event and data (a variant; frames whose data doesn't parse go)."""
    frames = F.filter(F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n\n", -1), lambda f: F.contains(f, F.lit("data:")))

    def frame(f: Column) -> Column:
        data = F.array_join(F.regexp_extract_all(f, F.lit(r"(?m)^data:[ ]?(.*)$"), 1), "\n")
        return F.struct(or_default(F.regexp_extract(f, r"(?m)^event:[ ]?(.*)$", 1), "message").alias("event"), F.try_parse_json(data).alias("data"))

    return F.filter(F.transform(frames, frame), lambda x: x["data"].isNotNull())


def saved_files(output: Column, mark: str = "FILE_SAVED:") -> Column:
    """Names after the marker, one a line."""
    lines = F.filter(F.split(output, "\n", -1), lambda x: x.startswith(mark))
    return F.filter(F.transform(lines, lambda x: stripped(F.substring(x, len(mark) + 1, 1 << 30))), lambda x: x != "")


def search_results(html: Column, most: int = 7) -> Column:
    """The first links of a result page, unwrapped from their redirects."""
    links = F.regexp_extract_all(html, F.lit(r"""(?is)<a[^>]*class=["'][^"']*result[^"']*["'][^>]*href=["']([^"']+)["']"""), 1)
    target = lambda u: F.coalesce(F.try_url_decode(F.nullif(F.regexp_extract(u, r"[?&]uddg=([^&]+)", 1), F.lit(""))), u)
    return F.slice(F.transform(links, target), 1, most)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def ownership(user: str | None, material_ids: list[str] | None = None, notebook: str | None = None, material: str | None = None) -> Column:
    """the filter of a search; it always names its user."""
    if not user:
        raise PermissionError("a search needs its user")
    found = [F.col("user_id") == user]
    if notebook:
        found.append(F.col("notebook_id") == notebook)
    if material_ids and len(material_ids) > 1:
        found.append(F.col("material_id").isin(*material_ids))
    elif material_ids or material:
        found.append(F.col("material_id") == (material_ids[0] if material_ids else material))
    return all_of(found)


def owned(owner: Column, user: str, strict: bool = True) -> Column:
    """the row is the user's; without strict, rows of nobody pass as well."""
    return owner == user if strict else owner.isNull() | (owner == "") | (owner == user)


def organic_results(raw: Column) -> Column:
    """Title, link and snippet of each result of a search service's answer, with empty defaults."""
    parsed = F.from_json(raw, "organic_results array<struct<title:string,link:string,snippet:string>>")["organic_results"]
    items = F.transform(parsed, lambda r: F.struct(*[F.coalesce(r[k], F.lit("")).alias(k) for k in ("title", "link", "snippet")]))
    return F.coalesce(items, F.array().cast("array<struct<title:string,link:string,snippet:string>>"))


def distinct_tools(steps: Column, used: Column) -> Column:
    """Names of tools from both lists, once each, without empty ones."""
    return F.filter(F.array_union(steps, used), lambda x: F.coalesce(x, F.lit("")) != "")


def suggestions(found: Column, most: int = 5) -> Column:
    """The first different suggestions, stripped, without empty ones."""
    return F.slice(F.array_distinct(F.filter(F.transform(found, stripped), lambda x: F.coalesce(x, F.lit("")) != "")), 1, most)


# Voices of host and guest by language.
VOICES = {
    "en": ("en-US-GuyNeural", "en-US-JennyNeural"),
    "hi": ("hi-IN-MadhurNeural", "hi-IN-SwaraNeural"),
    "gu": ("gu-IN-NiranjanNeural", "gu-IN-DhwaniNeural"),
    "es": ("es-ES-AlvaroNeural", "es-ES-ElviraNeural"),
    "ar": ("ar-SA-HamedNeural", "ar-SA-ZariyahNeural"),
    "fr": ("fr-FR-HenriNeural", "fr-FR-DeniseNeural"),
    "de": ("de-DE-ConradNeural", "de-DE-KatjaNeural"),
    "ja": ("ja-JP-KeitaNeural", "ja-JP-NanamiNeural"),
    "zh": ("zh-CN-YunxiNeural", "zh-CN-XiaoxiaoNeural"),
    "pt": ("pt-BR-AntonioNeural", "pt-BR-FranciscaNeural"),
}
# Names of the languages.
LANGUAGES = {"en": "English", "hi": "Hindi", "gu": "Gujarati", "es": "Spanish", "ar": "Arabic", "fr": "French", "de": "German", "ja": "Japanese", "zh": "Chinese", "pt": "Portuguese"}


def voice(language: Column, speaker: Column) -> Column:
    """The voice of a language's host, or of its guest for any other speaker; unknown languages speak English."""
    host, guest = ({k: v[i] for k, v in VOICES.items()} for i in (0, 1))
    spoken = F.when(language.isin(*VOICES), language).otherwise("en")
    return F.when(F.lower(speaker) == "host", lookup(spoken, host)).otherwise(lookup(spoken, guest))


def language_name(language: Column) -> Column:
    """A language's name; unknown ones keep their code."""
    return F.coalesce(lookup(language, LANGUAGES), language)
