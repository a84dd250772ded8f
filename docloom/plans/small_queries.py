"""Registered queries of the smaller column functions and state changes, on inputs on which they can fail."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import citations, records, text
from ..operators import jobs, layout, sessions
from .queries import NOW, r6, register, t

MARKED = "c.text || CASE WHEN turn % 3 = 0 THEN ' [SOURCE 1] ' || c.text WHEN turn % 3 = 1 THEN ' [SOURCE 12]' ELSE '' END"


def marked():
    more = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" [SOURCE 1] "), "text")).when(F.col("turn") % 3 == 1, F.lit(" [SOURCE 12]")).otherwise(F.lit(""))
    return F.concat("text", more)


@register("q_uncited", f"SELECT conv_id, turn, len(list_filter(string_split_regex({MARKED}, '\\[SOURCE\\s+\\d+\\]'), lambda x: length(trim(x, E' \\t\\n\\r')) > 50))::INT AS n FROM conversations c")
def _(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.size(citations.uncited(marked())).alias("n"))


@register(
    "q_annotated",
    r"""SELECT conv_id, turn, array_to_string(list_transform(string_split_regex(x, '\x01'), lambda s: CASE WHEN regexp_matches(s, '\[SOURCE\s+\d+\]') OR trim(s) = '' THEN s ELSE s || ' [CITATION NEEDED]' END), ' ') AS noted
FROM (SELECT conv_id, turn, regexp_replace(c.text || CASE WHEN turn % 2 = 0 THEN '. And so on [SOURCE 2]! Or not' ELSE '' END, '([.!?])\s+', '\1' || chr(1), 'g') AS x FROM conversations c)""",
)
def _(spark, d):
    x = F.concat("text", F.when(F.col("turn") % 2 == 0, F.lit(". And so on [SOURCE 2]! Or not")).otherwise(F.lit("")))
    return t(spark, d, "conversations").select("conv_id", "turn", citations.annotated(x).alias("noted"))


@register(
    "q_problem_messages",
    f"""SELECT conv_id, turn, CASE WHEN len(m) = 0 THEN 'No citations found: add [SOURCE n] after each claim.' WHEN len(list_filter(m, lambda n: n > 3)) > 0 THEN 'Citations out of range: ' || array_to_string(list_filter(m, lambda n: n > 3), ', ')
       WHEN words > 50 AND len(m) / words * 100 < 1 THEN printf('Citation density %.2f per 100 words is too low.', len(m) / words * 100) ELSE 'Citations are valid.' END AS message
FROM (SELECT conv_id, turn, list_transform(regexp_extract_all({MARKED}, '\\[SOURCE\\s+(\\d+)\\]', 1), lambda x: x::INT) AS m, greatest(len(regexp_extract_all({MARKED}, '\\S+')), 1) AS words FROM conversations c)""",
)
def _(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", citations.problem_message(citations.validated(marked(), F.lit(3))).alias("message"))


@register("q_code_clean", "SELECT conv_id, turn, trim(replace(replace(text, '. ', E'\\r\\n'), ', ', E'\\r'), E' \\t\\n\\r').replace(E'\\r\\n', E'\\n').replace(E'\\r', E'\\n') AS code FROM conversations")
def _(spark, d):
    code = F.replace(F.replace("text", F.lit(". "), F.lit("\r\n")), F.lit(", "), F.lit("\r"))
    return t(spark, d, "conversations").select("conv_id", "turn", text.code_clean(code).alias("code"))


@register("q_file_names", r"SELECT page_id, left(regexp_replace(regexp_replace(list_last(string_split(replace(url || '?a=' || page_id || '&b', '\', '/'), '/')), '[^\w\s.\-]', '_', 'g'), '_+', '_', 'g'), 255) AS name FROM pages")
def _(spark, d):
    return t(spark, d, "pages").select("page_id", text.file_name(F.concat("url", F.lit("?a="), F.col("page_id").cast("string"), F.lit("&b"))).alias("name"))


@register("q_slide_texts", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE concat_ws(chr(10), CASE WHEN event_id % 3 = 1 THEN 'a' || chr(10) || event_type END, CASE WHEN event_id % 2 = 0 THEN 'notes' END, CASE WHEN event_id % 3 = 2 THEN 'body' END) END AS slide FROM events")
def _(spark, d):
    k = F.col("event_id")
    bullets = F.when(k % 3 == 1, F.array(F.lit("a"), F.col("event_type"))).otherwise(F.array().cast("array<string>"))
    notes, body = F.when((k % 2 == 0) & (k % 3 != 0), F.lit("notes")).otherwise(F.lit("")), F.when(k % 3 == 2, F.lit("body"))
    return t(spark, d, "events").select("event_id", text.slide_text(F.col("event_type"), bullets, notes, body).alias("slide"))


@register("q_slide_counts", "SELECT event_id, (event_id % 4)::BIGINT AS n FROM events")
def _(spark, d):
    k = (F.col("event_id") % 4).cast("int")
    page = F.concat(F.lit("<div class='slides'>"), F.repeat(F.lit('<section class="big slide dark">x</section><p class="slideshow">'), k), F.lit("</div>"))
    return t(spark, d, "events").select("event_id", text.slide_count(page).cast("long").alias("n"))


@register("q_slides", "SELECT event_id, k::INT AS slide, 'Title ' || k AS title FROM (SELECT event_id, unnest(range(0, event_id % 4)) AS k FROM events)")
def _(spark, d):
    k = (F.col("event_id") % 4).cast("int")
    body = F.transform(F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("<div class='slide a'><h2>Title "), i.cast("string"), F.lit("</h2><ul><li>one</li><li>two</li></ul></div>")))
    rows = t(spark, d, "events").select("event_id", F.concat(F.lit("<html><body>"), F.array_join(body, ""), F.lit("</body></html>")).alias("html"))
    return rows.select("event_id", F.posexplode(text.slides(F.col("html"))).alias("slide", "s")).select("event_id", "slide", "s.title")


@register("q_presentable", "SELECT page_id, CASE WHEN lower(ltrim(b)) LIKE '<!doctype%' THEN b ELSE '<!DOCTYPE html>' || chr(10) || b END AS html FROM (SELECT page_id, replace(regexp_replace(CASE WHEN page_id % 2 = 0 THEN '<style>a{height:100vh}</style>' || html ELSE html END, '(?is)<script[^>]*>.*?</script>', '', 'g'), '100vh', '1080px') AS b FROM pages)")
def _(spark, d):
    html = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<style>a{height:100vh}</style>"), "html")).otherwise(F.col("html"))
    return t(spark, d, "pages").select("page_id", text.presentable(html).alias("html"))


@register("q_saved_files", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || '.csv,b.png' ELSE '' END AS files FROM events")
def _(spark, d):
    out = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("started\nFILE_SAVED: "), "event_type", F.lit(".csv \nFILE_SAVED:\n note FILE_SAVED:x\nFILE_SAVED:b.png"))).otherwise(F.lit("nothing FILE_SAVED:z"))
    return t(spark, d, "events").select("event_id", F.array_join(records.saved_files(out), ",").alias("files"))


@register("q_speech_confidence", "SELECT conv_id, turn, round(least(1.0, len(regexp_extract_all(text, '\\S+')) / (turn + 2.0) / 3) * 100, 4) AS confidence FROM conversations")
def _(spark, d):
    rows = t(spark, d, "conversations")
    part = lambda end, x: F.struct(F.lit(0.0).alias("start"), end.cast("double").alias("end"), x.alias("text"))
    segments = F.array(part(F.col("turn") + 2, F.col("text")), part(F.lit(0), F.col("text")), part(F.lit(1), F.lit(" ")))
    return rows.select("conv_id", "turn", F.round(records.speech_confidence(segments), 4).alias("confidence"))


@register("q_processing_seconds", "SELECT event_id, round(value * CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 2.0 ELSE 1 END, 6) AS seconds FROM events")
def _(spark, d):
    return t(spark, d, "events").select("event_id", r6(records.processing_seconds(F.col("value"), F.col("event_type"), {"click": 0.5, "view": 2.0})).alias("seconds"))


@register("q_minutes_before", "SELECT event_id, ts - INTERVAL 30 MINUTE AS since FROM events")
def _(spark, d):
    return t(spark, d, "events").select("event_id", records.minutes_before(F.col("ts"), 30).alias("since"))


@register("q_progress_fraction", "SELECT conv_id, turn, round(0.25 + 0.70 * turn / greatest(max(turn) OVER (PARTITION BY conv_id), 1), 3) AS done FROM conversations")
def _(spark, d):
    rows = t(spark, d, "conversations")
    last = rows.groupBy("conv_id").agg(F.max("turn").alias("last"))
    return rows.join(last, "conv_id").select("conv_id", "turn", records.progress(F.col("turn"), F.col("last")).alias("done"))


@register("q_json_clean", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE props END AS block FROM events")
def _(spark, d):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("<think>so {x} </think>```json\n"), "props", F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here's: "), "props", F.lit(" as asked"))).when(k == 3, F.concat(F.lit("The answer is "), "props", F.lit("."))).otherwise(F.lit("no such thing"))
    return t(spark, d, "events").select("event_id", records.json_block(records.json_clean(raw)).alias("block"))


@register("q_chapter_names", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'n' ELSE 'Chapter ' || (event_id % 7) END AS title, CASE event_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 9 ELSE 0 END AS start FROM events")
def _(spark, d):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.concat(F.lit('{"title": "'), "event_type", F.lit('", "startSegment": 4}'))).when(k == 1, F.lit('{"name": "n", "start_segment": 9}')).otherwise(F.lit("{}"))
    return t(spark, d, "events").select("event_id", records.chapter(raw, (F.col("event_id") % 7).cast("int")).alias("c")).select("event_id", "c.*")


@register("q_tool_blocks", "SELECT event_id, n::INT AS source, CASE n WHEN 1 THEN 'rag' WHEN 2 THEN event_type END AS tool, CASE n WHEN 1 THEN 'first' WHEN 2 THEN 'second --- part' ELSE 'third' END AS body FROM (SELECT event_id, event_type, unnest([1, 2, NULL]) AS n FROM events)")
def _(spark, d):
    raw = F.concat(F.lit("[Source 1 \u2014 rag]\nfirst\n---\n[Source 2 \u2014 "), "event_type", F.lit("]\nsecond --- part\n  ---  \nthird"))
    return t(spark, d, "events").select("event_id", F.explode(records.tool_blocks(raw)).alias("b")).select("event_id", "b.*")


@register("q_sse_frames", "SELECT event_id, k::INT AS k, CASE k WHEN 0 THEN event_type ELSE 'message' END AS event, CASE k WHEN 0 THEN '1' ELSE '[2,3]' END AS data FROM (SELECT event_id, event_type, unnest([0, 1]) AS k FROM events)")
def _(spark, d):
    raw = F.concat(F.lit("event: "), "event_type", F.lit("\r\ndata: 1\r\n\r\n: ping\n\ndata: [2,\ndata: 3]\n\ndata: {broken\n\n"))
    return t(spark, d, "events").select("event_id", F.posexplode(records.sse_frames(raw)).alias("k", "f")).select("event_id", "k", "f.event", F.to_json("f.data").alias("data"))


@register("q_closed_fences", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || chr(10) || '```py' || chr(10) || text || chr(10) || '```' ELSE text END AS closed FROM conversations")
def _(spark, d):
    half = F.concat("text", F.lit("\n```py\n"), "text")
    return t(spark, d, "conversations").select("conv_id", "turn", text.closed_fences(F.when(F.col("turn") % 2 == 0, half).otherwise(F.col("text"))).alias("closed"))


@register(
    "q_use_once",
    """WITH k AS (SELECT event_id, user_id AS family, event_type = 'error' AS used, event_id % 3 = 0 AS shown FROM events),
     burnt AS (SELECT DISTINCT family FROM k WHERE used AND shown AND event_id % 500 = 0)
SELECT event_id, used OR (shown AND (event_id % 500 = 0 OR NOT used)) AS used FROM k WHERE family NOT IN (SELECT family FROM burnt)""",
)
def _(spark, d):
    e = t(spark, d, "events")
    tokens = e.select(F.col("event_id").alias("token_hash"), F.col("user_id").alias("family"), (F.col("event_type") == "error").alias("used"))
    presented = tokens.filter("token_hash % 3 = 0 AND (NOT used OR token_hash % 500 = 0)").select("token_hash")
    return jobs.use_once(tokens, presented).select(F.col("token_hash").alias("event_id"), "used")


@register(
    "q_reindex",
    "SELECT CASE WHEN toxic = 1 OR toxic IS NULL OR trim(coalesce(text, ''), ' ') = '' THEN 'skipped' WHEN length(text) < 40 THEN 'failed' ELSE 'reindexed' END AS outcome, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
)
def _(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    materials = rows.select(F.col("doc_id").alias("material_id"), "text", F.when(F.col("toxic") == 0, "completed").otherwise("failed").alias("status"))
    return jobs.reindex(materials, lambda m: m.filter(F.length("text") >= 40).select("material_id", "text"))[1]


@register("q_cell_statistics", "SELECT n_nationkey, 3 AS n_rows, 3 AS n_columns, CASE WHEN n_nationkey % 2 = 0 THEN 4 ELSE 2 END AS empty_cells, n_nationkey % 2 = 1 AS valid FROM nation")
def _(spark, d):
    from ..operators.profile import cell_statistics

    empty = F.when(F.col("n_nationkey") % 2 == 0, F.lit(" ")).otherwise(F.lit("x"))
    row = lambda *cells: F.array(*cells)
    rows = F.array(row(F.lit("key"), F.lit("name"), F.lit("")), row(F.col("n_nationkey").cast("string"), F.col("n_name"), empty), row(F.lit(""), F.when(F.col("n_nationkey") % 2 == 0, F.lit("")).otherwise(F.lit("y"))))
    found = cell_statistics(t(spark, d, "nation").select("n_nationkey", rows.alias("rows")))
    return found.select("n_nationkey", F.col("n_rows").cast("int").alias("n_rows"), F.col("n_columns").cast("int").alias("n_columns"), F.col("empty_cells").cast("int").alias("empty_cells"), "valid")


@register("q_suggestions", "SELECT conv_id, list_slice(list(text ORDER BY turn), 1, 5) AS suggestions FROM (SELECT conv_id, trim(text) AS text, min(turn) AS turn FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY ALL) GROUP BY conv_id")
def _(spark, d):
    raw = t(spark, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("found"))
    return raw.select("conv_id", records.suggestions(F.col("found")).alias("suggestions")).filter(F.size("suggestions") > 0)


@register("q_index_order", "SELECT conv_id, turn, text FROM conversations ORDER BY conv_id, turn")
def _(spark, d):
    late = t(spark, d, "conversations").orderBy(F.md5("text"))
    return sessions.in_index_order(late, "conv_id", "turn").select("conv_id", "turn", "text")


@register("q_ready_prefix", "SELECT conv_id, turn FROM (SELECT conv_id, turn, bool_and(role <> 'assistant' OR turn < 4) OVER (PARTITION BY conv_id ORDER BY turn) AS ready FROM conversations) WHERE ready")
def _(spark, d):
    rows = t(spark, d, "conversations").withColumn("done", (F.col("role") != "assistant") | (F.col("turn") < 4))
    return sessions.ready_prefix(rows, "conv_id", "turn", "done").select("conv_id", "turn")


@register("q_status_exclusion", "SELECT event_id FROM events WHERE event_type NOT IN ('error', 'view')")
def _(spark, d):
    return sessions.without_status(t(spark, d, "events"), "event_type", ["error", "view"]).select("event_id")


@register("q_list_cuts", "SELECT source, n, first_ids FROM (SELECT source, count(*)::BIGINT AS n, array_to_string(list_slice(list(doc_id ORDER BY doc_id), 1, 15), ',') AS first_ids FROM documents GROUP BY source)")
def _(spark, d):
    docs = t(spark, d, "documents").select("source", "doc_id")
    few = sessions.first_n(docs, "source", ["doc_id"], 15).groupBy("source").agg(F.array_join(F.sort_array(F.collect_list("doc_id")).cast("array<string>"), ",").alias("first_ids"))
    return docs.groupBy("source").agg(F.count("*").alias("n")).join(few, "source")


@register("q_intersections", "SELECT conv_id, array_to_string(list_sort(list_intersect(list_distinct(list(role)), ['user', 'system', 'tool'])), ',') AS shared FROM conversations GROUP BY conv_id")
def _(spark, d):
    roles = t(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return roles.select("conv_id", F.array_join(F.sort_array(F.array_intersect("roles", F.array(F.lit("user"), F.lit("system"), F.lit("tool")))), ",").alias("shared"))


@register("q_owned_lookup", "SELECT event_id, user_id FROM events WHERE user_id = 1")
def _(spark, d):
    return t(spark, d, "events").filter(records.owned(F.col("user_id").cast("string"), "1")).select("event_id", "user_id")


@register("q_voices", "SELECT doc_id, CASE lang WHEN 'en' THEN 'voice-en' WHEN 'de' THEN 'voice-de' ELSE 'voice-any' END AS voice FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", F.coalesce(records.lookup(F.col("lang"), {"en": "voice-en", "de": "voice-de"}), F.lit("voice-any")).alias("voice"))


# ---- page layout: lines of orders as blocks and detections -----------------------------------------------------------------
#: Line numbers repeat within an order: lines are numbered anew.
NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey) AS nth FROM lineitem)"


def numbered(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey")
    return t(spark, d, "lineitem").withColumn("nth", F.row_number().over(order))


BLOCKS = """SELECT l_orderkey, l_linenumber AS k, (l_linenumber * 20 + CASE WHEN l_linenumber % 3 = 0 THEN 30 ELSE 0 END)::DOUBLE AS y0, l_extendedprice AS x0, 'Item ' || l_partkey AS text,
  CASE WHEN l_quantity > 45 THEN 20.0 WHEN l_quantity > 35 THEN 14.0 ELSE 10.0 END AS font_size, l_returnflag = 'R' AS is_bold, CASE WHEN l_linestatus = 'O' THEN 'Courier' ELSE 'Serif' END AS font_name FROM lineitem"""


def blocks(spark, d):
    size = F.when(F.col("l_quantity") > 45, 20.0).when(F.col("l_quantity") > 35, 14.0).otherwise(10.0)
    y0 = (F.col("l_linenumber") * 20 + F.when(F.col("l_linenumber") % 3 == 0, 30).otherwise(0)).cast("double")
    return t(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("k"), y0.alias("y0"), F.col("l_extendedprice").alias("x0"), (y0 + 10).alias("y1"), F.concat(F.lit("Item "), F.col("l_partkey").cast("string")).alias("text"),
        size.alias("font_size"), (F.col("l_returnflag") == "R").alias("is_bold"), F.when(F.col("l_linestatus") == "O", "Courier").otherwise("Serif").alias("font_name"),
    )


@register(
    "q_block_markdown",
    f"""SELECT l_orderkey, k, (row_number() OVER w - 1)::INT AS pos, CASE kind WHEN 'code' THEN '```' || chr(10) || text || chr(10) || '```' WHEN 'title' THEN '# ' || text WHEN 'heading' THEN '## ' || text ELSE text END AS markdown,
       coalesce(y0 - lag(y0 + 10) OVER w > 1.5 * size, false) OR kind IN ('title', 'heading') AS new_paragraph
FROM (SELECT *, CASE WHEN font_name = 'Courier' THEN 'code' WHEN font_size > size * 1.5 THEN 'title' WHEN font_size > size * 1.2 OR is_bold THEN 'heading' ELSE 'text' END AS kind
      FROM (SELECT *, avg(font_size) OVER (PARTITION BY l_orderkey) AS size FROM ({BLOCKS}))) WINDOW w AS (PARTITION BY l_orderkey ORDER BY y0, x0)""",
)
def _(spark, d):
    return layout.block_markdown(blocks(spark, d), ["l_orderkey"]).select("l_orderkey", "k", "pos", "markdown", "new_paragraph")


@register("q_confident", "SELECT l_orderkey, round(avg(l_quantity / 50) * 100, 6) AS confidence, count(*) AS n FROM lineitem WHERE l_quantity / 50 >= 0.35 GROUP BY l_orderkey")
def _(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") / 50).alias("conf"))
    return layout.confident(rows, ["l_orderkey"]).select("l_orderkey", r6("confidence").alias("confidence"), "n")


@register(
    "q_text_lines",
    """WITH RECURSIVE i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY y, x, bottom, text) AS k, y, x, text FROM (
         SELECT l_orderkey, floor(l_quantity)::DOUBLE AS y, l_linenumber::DOUBLE AS x, floor(l_quantity) + 9.0 AS bottom, 'w' || l_linenumber AS text FROM lineitem)),
     s AS (SELECT l_orderkey, k, 0 AS line, y AS anchor, x, text FROM i WHERE k = 1
           UNION ALL SELECT i.l_orderkey, i.k, CASE WHEN abs(i.y - s.anchor) > 25 THEN s.line + 1 ELSE s.line END, CASE WHEN abs(i.y - s.anchor) > 25 THEN i.y ELSE s.anchor END, i.x, i.text FROM s JOIN i ON i.l_orderkey = s.l_orderkey AND i.k = s.k + 1)
SELECT l_orderkey, line, string_agg(text, ' ' ORDER BY x, text) AS text FROM s GROUP BY ALL""",
)
def _(spark, d):
    y = F.floor("l_quantity").cast("double")
    rows = t(spark, d, "lineitem").select("l_orderkey", F.lit(1000).alias("page_height"), y.alias("y"), F.col("l_linenumber").cast("double").alias("x"), (y + 9).alias("bottom"), F.concat(F.lit("w"), F.col("l_linenumber").cast("string")).alias("text"), F.lit(0.9).alias("conf"))
    return layout.text_lines(rows, "l_orderkey", tasks=layout.tasks_of(rows)).select("l_orderkey", "line", "text")


@register(
    "q_line_paragraphs",
    f"""SELECT l_orderkey, line, coalesce(top - lag(top) OVER (PARTITION BY l_orderkey ORDER BY line) > 1.5 * h[len(h) // 2 + 1], false) AS new_paragraph, CASE WHEN l_returnflag = 'R' THEN '### TOTAL DUE' ELSE 'Item text' END AS markdown
FROM (SELECT *, list_sort(list(height) OVER (PARTITION BY l_orderkey)) AS h FROM (SELECT l_orderkey, nth AS line, l_returnflag, nth * nth * 10.0 AS top, 10.0 + nth AS height FROM {NUMBERED}))""",
)
def _(spark, d):
    top = F.col("nth") * F.col("nth") * 10.0
    rows = numbered(spark, d).select("l_orderkey", F.col("nth").alias("line"), top.alias("top"), (top + 10.0 + F.col("nth")).alias("bottom"), F.when(F.col("l_returnflag") == "R", "TOTAL DUE").otherwise("Item text").alias("text"))
    return layout.line_paragraphs(rows, "l_orderkey").select("l_orderkey", "line", "new_paragraph", "markdown")


@register("q_assembled", "SELECT conv_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (trim(t) <> ''), '') AS text, round(avg(CASE WHEN trim(t) <> '' THEN turn * 10.0 END), 6) AS confidence FROM (SELECT conv_id, turn, CASE WHEN role = 'system' THEN ' ' ELSE text END AS t FROM conversations) GROUP BY conv_id")
def _(spark, d):
    pages = t(spark, d, "conversations").select("conv_id", F.col("turn").alias("page"), F.when(F.col("role") == "system", F.lit(" ")).otherwise(F.col("text")).alias("text"), (F.col("turn") * 10.0).alias("confidence"))
    found = layout.assembled(pages, "conv_id")
    return found.select("conv_id", "text", r6("confidence").alias("confidence"))


@register(
    "q_merged_tables",
    f"""WITH RECURSIVE i AS (SELECT l_orderkey, nth AS k, nth * 100.0 AS y0, nth * 100.0 + l_quantity + 20 AS y1 FROM {NUMBERED}),
     s AS (SELECT l_orderkey, k, 0 AS pos, y0, y1, false AS paired FROM i WHERE k = 1
           UNION ALL SELECT i.l_orderkey, i.k, CASE WHEN NOT s.paired AND i.y0 - s.y1 < 50 THEN s.pos ELSE s.pos + 1 END, CASE WHEN NOT s.paired AND i.y0 - s.y1 < 50 THEN s.y0 ELSE i.y0 END, i.y1, NOT s.paired AND i.y0 - s.y1 < 50
           FROM s JOIN i ON i.l_orderkey = s.l_orderkey AND i.k = s.k + 1)
SELECT l_orderkey, pos, min(y0) AS y0, max(y1) AS y1, count(*)::INT AS n_rows FROM s GROUP BY l_orderkey, pos""",
)
def _(spark, d):
    y0 = F.col("nth") * 100.0
    rows = numbered(spark, d).select("l_orderkey", y0.alias("y0"), (y0 + F.col("l_quantity") + 20).alias("y1"), F.array(F.array(F.col("nth").cast("string"))).alias("rows"))
    return layout.merged_tables(rows, ["l_orderkey"]).select("l_orderkey", "pos", "y0", "y1", F.size("rows").alias("n_rows"))


@register(
    "q_reading_order",
    f"SELECT l_orderkey, k, (row_number() OVER (PARTITION BY l_orderkey ORDER BY y0, x0) - 1)::INT AS pos FROM ({BLOCKS})",
)
def _(spark, d):
    return layout.block_markdown(blocks(spark, d), ["l_orderkey"]).select("l_orderkey", "k", "pos")


# ---- the rate limiter, the agent loop, re-ranking and code checks in SQL ---------------------------------------------------
@register(
    "q_rate_decisions",
    """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, CASE event_type WHEN 'signup' THEN 'auth' WHEN 'purchase' THEN 'generation' ELSE 'chat' END AS kind, event_id, epoch_us(ts) // 600 AS tick FROM events),
     o AS (SELECT *, row_number() OVER (PARTITION BY key, kind ORDER BY tick, event_id) AS n, CASE kind WHEN 'chat' THEN 30 WHEN 'generation' THEN 5 ELSE 10 END AS most FROM e),
     r AS (SELECT key, kind, n, event_id, true AS allowed, [tick] AS log, most - 1 AS remaining FROM o WHERE n = 1
           UNION ALL SELECT o.key, o.kind, o.n, o.event_id, len(f) < o.most, CASE WHEN len(f) < o.most THEN list_append(f, o.tick) ELSE f END, CASE WHEN len(f) < o.most THEN o.most - len(f) - 1 ELSE 0 END
           FROM (SELECT o.*, list_filter(r.log, lambda x: x > o.tick - 60000000) AS f FROM r JOIN o ON o.key = r.key AND o.kind = r.kind AND o.n = r.n + 1) AS o)
SELECT key, kind, event_id AS request_id, allowed, remaining::INT AS remaining FROM r""",
)
def _(spark, d):
    from ..streaming import limits

    kind = F.when(F.col("event_type") == "signup", "auth").when(F.col("event_type") == "purchase", "generation").otherwise("chat")
    at = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600))  # 600 times as dense, so that limits are met
    rows = t(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), kind.alias("kind"), F.col("event_id").alias("request_id"), at.alias("ts"))
    return limits.limited(rows).select("key", "kind", "request_id", "allowed", "remaining")
