"""Operators that SQL can't express, against plain Python models, and cases that the fixtures lack."""


import random
import re
import zipfile
from collections import deque

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docloom.functions import citations, classify, records, text
from docloom.functions.markup import blocks_of, fixed_width, page_text, sections_of
from docloom.operators import chunk, jobs, layout, profile, retrieve, sessions
from docloom.sources import kinds, readers, sinks
from docloom.streaming import limits

GAP = re.compile(r"(?<=[.!?])\s+(?=[A-Z\"'])")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


# ---- chunks
def model_pack(sentences, size=2000, overlap=600):
    out, cur, n = [], [], 0
    for s in sentences:
        if cur and n + len(s) > size:
            out.append(" ".join(cur))
            keep = []
            for x in reversed(cur):
                if sum(map(len, keep)) + len(x) > overlap:
                    break
                keep.insert(0, x)
            cur, n = keep, sum(map(len, keep))
        cur.append(s)
        n += len(s)
    return out + ([" ".join(cur)] if cur else [])


def model_paragraph(p):
    if len(p) <= 2000:
        return [p]
    s = [x.strip() for x in GAP.split(p) if x.strip()]
    if len(p) <= 3200:
        return [p] if len(s) <= 3 else [" ".join(s[i : i + 3]) for i in range(0, len(s), 2)]
    return model_pack(s)


def model_chunks(t):
    found = [(title, c) for title, _, content in sections_of(t) for p in content.split("\n\n") if p.strip() for c in model_paragraph(p.strip())]
    alpha = lambda x: sum(c.isalpha() for c in x) / max(len(x), 1)
    good = [x for x in found if len(x[1]) >= 100 and len(x[1].strip()) >= 100 and alpha(x[1]) >= 0.1]
    return good or sorted((x for x in found if len(x[1]) > 50), key=lambda x: -alpha(x[1]))[:3]


def test_chunks_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {}
    for r in chunk.chunk(docs).collect():
        got.setdefault(r.doc_id, {})[r.chunk_index] = (r.section_title, r.text)
        assert r.total_chunks >= 1
    for r in docs.collect():
        want = model_chunks(r.text)
        assert sorted(got.get(r.doc_id, {}).values(), key=str) == sorted(want, key=str)


def test_chunks_of_markdown(spark):
    sentence = "This is a sentence of the text that goes on for a while. "
    rows = [
        (1, "Preamble " * 20 + "\n\n# One\n" + sentence * 3 + "\n##### not a heading\n\n#### Four\n\n" + sentence * 70 + "\n\nshort"),
        (2, "# Only\nshort chunk, but over fifty characters, so it is the best there is"),
        (3, ""),
        (4, sentence * 36 + "\n\n" + sentence * 57),
        (5, "```\n# comment\n```\n" + sentence * 4),
        (6, "#\n\nFoo\n" + sentence * 3),
    ]
    got = {}
    for r in chunk.chunk(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.section_title, r.text))
    for doc_id, t in rows:
        assert got.get(doc_id, []) == model_chunks(t)
    assert got[6][0][0] == "Foo" and got[1][0][0] is None


def test_structured_chunks(spark):
    t = "Sheet A\nShape: 3 x 2\nColumns: a, b and some more\n=== rows ===\n1 2 3 4 5 6 7 8 9 10 11 12 13 14 15\n====\nshort"
    got = chunk.chunk(spark.createDataFrame([(1, t), (2, "tiny")], "doc_id long, text string"), structured=F.lit(True)).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.total_chunks, r.section_title) for r in got] == [(1, 0, 2, "Sheet A"), (1, 1, 2, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"), (2, 0, 1, "Structured Data")]
    assert got[1].text.startswith("Sheet A\n\n1 2 3")


# ---- retrieval
def test_mmr_against_a_loop(spark):
    rng = np.random.default_rng(0)
    v, rel = rng.normal(size=(20, 5)), rng.random(20)
    v[3] = 0
    chosen = [int(rel.argmax())]
    unit = [x / np.linalg.norm(x) if np.linalg.norm(x) else x for x in v]
    while len(chosen) < 6:
        rest = [i for i in range(20) if i not in chosen]
        chosen.append(max(rest, key=lambda i: (0.5 * rel[i] - 0.5 * max(float(unit[i] @ unit[j]) for j in chosen), -i)))
    assert retrieve.select_diverse(rel, v, 6, 0.5) == chosen
    assert retrieve.select_diverse(rel[:3], v[:3], 6, 0.5) == [0, 1, 2]


def test_balance(spark):
    def run(rows):
        df = spark.createDataFrame(rows, "pos int, material_id string, score double")
        return [(r.material_id, r.pos) for r in retrieve.balanced(df).orderBy("place").collect()]

    assert run([(i, "a", 1.0) for i in range(14)]) == [("a", i) for i in range(10)]
    rows = [(i, "big", 1 - i / 100) for i in range(10)] + [(10 + i, f"m{i}", 0.1) for i in range(4)]
    got = run(rows)
    assert [x for x in got if x[0] == "big"] == [("big", 0), ("big", 1), ("big", 2)] and len(got) == 7
    assert len(run([(i, f"m{i}", 1.0) for i in range(12)])) == 10


def test_tenants():
    with pytest.raises(PermissionError):
        records.ownership("")


def test_owner_filter(spark):
    df = spark.createDataFrame([(1, "u"), (2, None), (3, ""), (4, "v")], "id int, owner string")
    ids = lambda strict: [r.id for r in df.filter(records.owned(F.col("owner"), "u", strict)).collect()]
    assert ids(True) == [1] and ids(False) == [1, 2, 3]


def test_rerank_without_scorer(spark):
    df = spark.createDataFrame([(1, i, "q", "t") for i in range(5)], "query_id int, rank int, question string, text string")
    assert [r["rank"] for r in retrieve.rerank(df, None, 3).orderBy("place").collect()] == [0, 1, 2]
    assert [r["rank"] for r in retrieve.rerank(df, lambda q, x: q.map(len) * 0.0, 2).orderBy("place").collect()] == [0, 1]


# ---- limits
def model_limit(times, limit):
    log, out = deque(), []
    for t in times:
        while log and log[0] <= t - 60_000_000:
            log.popleft()
        out.append(len(log) < limit)
        if out[-1]:
            log.append(t)
    return out


def test_rate_limit(spark):
    rng = random.Random(1)
    rows, n = [], 0
    for key in "abc":
        for kind in limits.LIMITS:
            for t in sorted(rng.randrange(0, 200_000) for _ in range(150)):
                rows.append((key, kind, n, t))
                n += 1
    rows += [("edge", "generation", n + i, t) for i, t in enumerate([0, 1, 2, 3, 4, 59_999, 60_000])]
    df = spark.createDataFrame(rows, "key string, kind string, request_id long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    got = {r.request_id: r for r in limits.limited(df).collect()}
    for key in {r[0] for r in rows}:
        for kind, limit in limits.LIMITS.items():
            mine = sorted((r[3] * 1000, r[2]) for r in rows if r[:2] == (key, kind))
            assert [got[i].allowed for _, i in mine] == model_limit([t for t, _ in mine], limit)
    edge = [got[n + i] for i in range(7)]
    assert [r.allowed for r in edge] == [True] * 5 + [False, True] and edge[5].retry_after == 1 and edge[0].remaining == 4


def test_rate_limit_on_a_stream(spark, tmp_path):
    rows = [("a", "generation", i, 1000 * i) for i in range(12)] + [("a", "generation", 50, 61_500)]
    df = spark.createDataFrame(rows, "key string, kind string, request_id long, ms long").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = limits.limited_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
        limits.append_log(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {r.request_id: r.allowed for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r.request_id: r.allowed for r in limits.limited(df).collect()}


def test_first_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 1, "c")], "session_id int, index int, text string").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000)))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = limits.first_of_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["session_id", "index"], "at")
    limits.append_log(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


# ---- text, rules, records
def test_markdown_blocks():
    t = "Intro line\nsame paragraph\n\n\n# Title\nunder\n\n```py\n# no heading\n\n```\nafter\n| a | b |\n|---|---|\n| 1 | 2 |\n- one\n  more\n- two\n\n> quote\n> on\n\n---\nend"
    assert blocks_of(t) == ["Intro line\nsame paragraph", "# Title\nunder", "```py\n# no heading\n\n```", "after", "| a | b |\n|---|---|\n| 1 | 2 |", "- one\n  more\n- two", "> quote\n> on", "---", "end"]


def test_page_outline(spark):
    html = "<html><head><title> T </title></head><body><nav>menu</nav><main><h1>A</h1><p>one <b>two</b></p><ul><li>x<li>y</ul><table><tr><td>1</td></tr></table></main><p>outside</p><script>s</script></body></html>"
    r = spark.createDataFrame([(html,)], "h string").select(page_text("h").alias("p")).first().p
    assert r.structured == "\n# A\n\none two\n- x\n- y\n\n1 | " and "menu" not in r.visible and "outside" in r.visible


def test_citation_rules(spark):
    cases = [("No marks at all.", 3), ("Fine [SOURCE 1].", 3), ("Bad [SOURCE 9].", 3), ("I could not find it", 3), ("w " * 120 + "[SOURCE 1]", 3), ("w " * 60 + "[SOURCE 1] [SOURCE 1]", 3)]
    df = spark.createDataFrame(cases, "t string, n int").select(citations.validated(F.col("t"), F.col("n")).alias("v"), citations.problem_message(citations.validated(F.col("t"), F.col("n"))).alias("m"))
    got = df.collect()
    assert [(r.v.is_valid, r.v.problem) for r in got] == [(False, "none"), (True, None), (False, "invalid"), (True, None), (False, "thin"), (True, None)]
    assert got[2].v.invalid_sources == [9] and got[2].m.endswith("9") and got[5].v.cited_sources == [1]
    assert one(spark, citations.annotated(F.lit("One. Two [SOURCE 1]."))) == "One. [CITATION NEEDED] Two [SOURCE 1]."
    assert one(spark, citations.uncited(F.lit("x" * 60 + " [SOURCE 1] short"))) == ["x" * 60]


def test_rules(spark):
    sat = lambda m, lang: tuple(one(spark, classify.satisfaction(F.lit(m), F.lit(lang))))
    assert sat("Got it", "en") == (True, 0.90) and sat("got it, but why", "en") == (False, 0.90) and sat("good", "en") == (None, 0.80)
    assert sat("entendido", "es") == (True, 0.90) and sat("xyz?", "fr") == (False, 0.90) and sat("全部", "zh") == (None, 0.0)
    assert sat("pourquoi", "fr") == (False, 0.90) and sat("okay", "xx") == (True, 0.85)
    assert one(spark, classify.compares_documents(F.lit("show dogs"))) and not one(spark, classify.compares_documents(F.lit("show dogs"), True))
    assert one(spark, F.size(classify.forbidden_code(F.lit("import subprocess; eval('1')")))) == 2


def test_json_ladder(spark):
    cases = ['{"a": 1}', '```json\n{"a": 1}\n```', '<think>x {</think>Here is the JSON: {"a": 1} ok', '{"a": 1,}', "{'a': 1}", "nothing", '[1, {"a": 1}]']
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").orderBy("i").select(F.to_json(records.robust_json(F.col("c"))).alias("j"))
    assert [r.j for r in df.collect()] == ['{"a":1}'] * 5 + [None, '[1,{"a":1}]']
    items = records.valid_items(F.lit('[{"q": "x", "o": ["1", "2"]}, {"q": null}]'), "array<struct<q:string,o:array<string>>>", lambda x: x["q"].isNotNull() & (F.size(x["o"]) >= 2))
    assert len(one(spark, items)) == 1
    assert one(spark, records.chapter(F.lit('{"name": "N", "start_segment": 4}'), F.lit(2))) == Row(title="N", start=4)


def test_small_functions(spark):
    assert one(spark, text.file_name(F.lit("../a/b c?.txt"))) == "b c_.txt"
    assert one(spark, text.variable_name(F.lit("2 My-File.csv"))) == "_2_my_file"
    assert one(spark, text.markdown_table(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"))))) == "| a | b |\n| --- | --- |\n| 1 |  |"
    assert one(spark, text.closed_fences(F.lit("a\n```\nb"))) == "a\n```\nb\n```"
    assert one(spark, text.imports(F.lit("import os\nfrom re import x\nimport os"))) == ["os", "re"]
    assert one(spark, text.presentable(F.lit("<p>x</p><script>y</script>"))) == "<!DOCTYPE html>\n<p>x</p>"
    assert one(spark, text.slide_count(F.lit('<div class="slide a"></div><section class="slide"></section><p class="slides">'))) == 2
    assert one(spark, text.slide_text(F.lit("T"), F.array(F.lit("b")), F.lit(""), F.lit("c"))) == "b\nc"
    assert one(spark, text.without_fences(F.lit("```py\nx\n```"))) == "x"
    assert one(spark, text.lead_summary(F.lit("A. B. C. D. E."))) == "A. B. C. D. …"
    assert one(spark, records.youtube_id(F.lit("https://youtu.be/abcdefghijk"))) == "abcdefghijk"
    assert one(spark, records.public_https(F.lit("https://192.168.0.1/x"))) is False
    assert one(spark, records.search_terms(F.lit("cats filetype:PDF dogs"))) == Row(text="cats dogs", file_type="pdf")
    assert one(spark, records.answer_confidence(F.array().cast("array<double>"), F.lit(0.0))) == 0.5
    assert one(spark, F.size(records.sse_frames(F.lit('event: a\ndata: {"x": 1}\n\ndata: bad{\n\ndata: 2')))) == 2
    assert one(spark, records.tool_blocks(F.lit('[Source 1 — rag]\nhello\n---\n{"a": 1}')))[0] == Row(source=1, tool="rag", body="hello")
    assert one(spark, records.saved_files(F.lit("x\nFILE_SAVED: a.csv\nFILE_SAVED:\n"))) == ["a.csv"]
    assert one(spark, records.search_results(F.lit('<a class="result__a" href="//x?uddg=https%3A%2F%2Fe.org%2F&r=1">')))[0] == "https://e.org/"
    assert one(spark, records.upload_problem(F.lit("a.exe"), F.lit(5), F.lit("x"), (".exe",), ())) == "blocked extension"
    assert one(spark, records.speech_confidence(F.array(F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.lit("a b c").alias("text"))))) == 100
    assert one(spark, records.processing_seconds(F.lit(10.0), F.lit("m"), {"m": 0.5})) == 5 and one(spark, records.progress(F.lit(1), F.lit(2))) == 0.6
    assert fixed_width("=== T ===\nname   n b\nxy     12\n")[0] == {"label": "T", "header": ["name", "n b"], "rows": [["xy", "12"]]}


# ---- layout
def test_lines_use_a_fixed_anchor(spark):
    rows = [(1, 1000, 0.0, y, y + 10, w, c) for y, w, c in ((0, "a", 0.9), (15, "b", 0.9), (30, "c", 0.9), (31, "no", 0.34), (32, "d", 0.35))]
    df = spark.createDataFrame([(p, h, float(i), float(y), float(b), w, c) for i, (p, h, _, y, b, w, c) in enumerate(rows)], "page int, page_height int, x double, y double, bottom double, text string, conf double")
    got = [r.text for r in layout.text_lines(df).orderBy("line").collect()]
    assert got == ["a b", "c d"]
    assert layout.confident(df, ["page"]).first().n == 4
    assert layout.line_paragraphs(layout.text_lines(df)).count() == 2


def test_blocks_noise_and_tables(spark):
    b = spark.createDataFrame([(1, "Big", 0.0, 0.0, 9.0, 10.0, 30.0, "Arial", False), (1, "ALL CAPS", 0.0, 12.0, 9.0, 20.0, 10.0, "Arial", False), (1, "code", 0.0, 90.0, 9.0, 99.0, 10.0, "Courier", False), (1, "plain", 0.0, 100.0, 9.0, 110.0, 10.0, "Arial", False)], "page_num int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, font_name string, is_bold boolean")
    assert [r.markdown for r in layout.block_markdown(b, ["page_num"]).orderBy("pos").collect()] == ["# Big", "## ALL CAPS", "```\ncode\n```", "plain"]
    t = "\n".join(["foot", "body line"] * 6 + ["body line"])
    noisy = spark.createDataFrame([(1, t.replace("body line", "long " * 20)), (2, "foot\n" * 5 + "x\n\n\ny")], "doc_id int, text string")
    got = {r.doc_id: r.clean for r in layout.without_noise(noisy, "doc_id").collect()}
    assert "foot" not in got[1] and got[2] == "foot\n" * 5 + "x\n\ny"
    tables = spark.createDataFrame([(1, 0.0, 10.0, [["a"]]), (1, 30.0, 40.0, [["b"]]), (1, 50.0, 60.0, [["c"]]), (1, 500.0, 510.0, [["d"]])], "page int, y0 double, y1 double, rows array<array<string>>")
    assert [r.rows for r in layout.merged_tables(tables, ["page"]).orderBy("pos").collect()] == [[["a"], ["b"]], [["c"]], [["d"]]]
    pages = spark.createDataFrame([(1, 2, "b", 50.0), (1, 1, "a", 100.0), (1, 3, " ", 0.0)], "doc int, page int, text string, confidence double")
    assert tuple(layout.assembled(pages, "doc").first()) == (1, "a\n\nb", 75.0)
    cells = profile.cell_statistics(spark.createDataFrame([([["h", "k"], ["1", ""]],)], "rows array<array<string>>")).first()
    assert cells.empty_cells == 1 and cells.has_header and cells.valid


# ---- state, sessions, sources
def test_tokens_are_used_once(spark):
    tokens = spark.createDataFrame([("a", "f1", False), ("b", "f1", False), ("c", "f2", True), ("d", "f2", False)], "token_hash string, family string, used boolean")
    got = {r.token_hash: r.used for r in jobs.use_once(tokens, spark.createDataFrame([("a",), ("c",)], "token_hash string")).collect()}
    assert got == {"a": True, "b": False}


def test_agent_limits(spark):
    rows = [(1, i, 10, True) for i in range(9)] + [(2, i, 7000, True) for i in range(3)] + [(3, i, 1, False) for i in range(4)]
    got = {r.run_id: r for r in jobs.agent_runs(spark.createDataFrame(rows, "run_id int, step int, tokens int, ok boolean")).collect()}
    assert (got[1].state, got[1].iterations) == ("iteration limit", 7) and (got[2].state, got[2].tokens) == ("token limit", 14000) and (got[3].skipped, got[3].failures) == (1, 1)


def test_reindex(spark):
    rows = spark.createDataFrame([(1, "completed", "word " * 60), (2, "completed", " "), (3, "failed", "x"), (4, "completed", "tiny")], "material_id int, status string, text string")
    chunks, counts = jobs.reindex(rows, lambda m: chunk.chunk(m, "material_id"))
    assert {r.material_id for r in chunks.collect()} == {1} and {r.outcome: r.n for r in counts.collect()} == {"reindexed": 1, "skipped": 2, "failed": 1}


def test_export_of_a_session(spark):
    import json

    make = spark.createDataFrame
    out = sessions.export(
        make([(1, "S")], "session_id int, title string"),
        make([(1, 2, "Two", ""), (1, 0, "One", "")], "session_id int, start int, title string, summary string"),
        make([(1, i, "host", f"t{i}", 10) for i in (2, 0, 1)], "session_id int, index int, speaker string, text string, duration_ms int"),
        make([(1, 1), (1, 1)], "session_id int, index int"),
        make([(1, 1, "n2", "b"), (1, 1, "n1", "a")], "session_id int, index int, note string, created_at string"),
        make([(1, 0, "q", "a")], "session_id int, paused_at_segment int, question string, answer string"),
    )
    j = json.loads(out.first().json)
    assert [(s["index"], s["chapter"], s["bookmarked"], [a["note"] for a in s["annotations"]]) for s in j["segments"]] == [(0, "One", False, []), (1, "One", True, ["n1", "n2"]), (2, "Two", False, [])]
    assert [c["title"] for c in j["chapters"]] == ["One", "Two"] and j["doubts"][0]["question"] == "q"


def test_as_of_before_the_first(spark):
    points = spark.createDataFrame([(1, 0), (1, 5)], "k int, at int")
    starts = spark.createDataFrame([(1, 3, "x")], "k int, s int, v string")
    assert {r["at"]: r.v for r in sessions.as_of(points, starts, "k", "at", "s", "v").collect()} == {0: None, 5: "x"}
    assert {r["at"]: r.v for r in sessions.as_of(points, starts, "k", "at", "s", "v", True).collect()} == {0: "x", 5: "x"}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Some letters \0 here ".encode() + b"\xff")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01\x02")
    (tmp_path / "c.md").write_text("12 34 56 78 90 12 34 56 78 90 11")
    (tmp_path / "m.eml").write_text("Subject: Hi\nFrom: a@example.org\nContent-Type: text/plain\n\nBody here\n")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document xmlns:w='w'><w:p><w:t>Hello </w:t><w:t>docx</w:t></w:p><w:p/></w:document>")
    (tmp_path / "r.rtf").write_text(r"{\rtf1 Plain\par Next}")
    (tmp_path / "p.html").write_text("<body><nav>x</nav><p>Shown text</p></body>")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.Registry().extract(files).collect()}
    assert got["a.txt"].text.startswith("Some letters  here") and got["b.bin"].error == "unsupported type" and got["c.md"].error == "too few letters"
    assert got["m.eml"].text == "Subject: Hi\nFrom: a@example.org\n\nBody here" and got["d.docx"].text == "Hello docx" and got["r.rtf"].text == "Plain\nNext" and got["p.html"].text == "Shown text"
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,\n")
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n")
    assert readers.csv(spark, f"{tmp_path}/t.csv").dtypes == [("a", "int"), ("b", "string")] and readers.csv(spark, f"{tmp_path}/t.tsv", "\t").count() == 1
    assert kinds.supported(spark).count() == len(kinds.MEDIA) == 49
    assert one(spark, kinds.detected(F.lit("x.bin"), F.lit(b"%PDF-1.4"))) == "pdf"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "id string, n int")
    sinks.write_records(rows, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 2
    (tmp_path / "x.json").write_text(sinks.records_with_header(rows, "c", "id").first().json)
    assert [r.id for r in readers.exported_records(spark, f"{tmp_path}/x.json").collect()] == ["a", "b"]
    ids = spark.createDataFrame([("ok-1", "t"), ("../x", "t"), (None, "t")], "material_id string, text string")
    for bad in (ids, ids.filter("material_id IS NULL")):
        with pytest.raises(ValueError, match="unsafe"):
            sinks.write_texts(bad, f"{tmp_path}/t")
    sinks.write_texts(ids.filter("material_id = 'ok-1'"), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1
    sinks.write_table(rows, f"{tmp_path}/p", ["id"])
    sinks.append(rows, f"{tmp_path}/log")
    sinks.append(rows, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4 and spark.read.parquet(f"{tmp_path}/p").count() == 2
    blocks = sinks.block_rows(spark.createDataFrame([(1, ["a" * 6000, "b"])], "message_id int, blocks array<string>"), F.col("blocks"))
    assert [(r.block_index, len(r.text)) for r in blocks.collect()] == [(0, 5000), (1, 1)]
    choice = readers.transcript_choice(spark.createDataFrame([(1, "de", False, "d"), (1, "en", True, "e")], "v int, lang string, generated boolean, text string"), "v", ["en"]).first()
    assert choice.lang == "en"
    route = readers.pdf_route(spark.createDataFrame([(1, 1, "x" * 400), (1, 2, "x" * 10)], "doc int, page_num int, text string"), "doc")
    assert {r.page_num: r.route for r in route.collect()} == {1: "text", 2: "ocr"}
    asked = readers.structured_call(spark.createDataFrame([("p",)], "prompt string"), lambda s: s.map(lambda x: '{"a":1}' if "valid JSON" in x else "no"), "prompt", records.robust_json)
    assert asked.select(F.to_json("parsed")).first()[0] == '{"a":1}'


# ---- searches over query sets that grow
def test_queries_go_in_blocks(spark):
    rng = random.Random(4)
    v = spark.createDataFrame([(i, i % 3, [rng.random() for _ in range(6)]) for i in range(120)], "vec_id long, label int, embedding array<double>")
    asked = v.filter("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for per in (None, ["label"]):
        at_once, blocks = (retrieve.top_k_of(asked, v, 5, per=per, sent=n).select("query_id", "label", "vec_id", "rank") for n in (30 * 80, 6 * 80))  # bytes: 80 a query
        assert sorted(at_once.collect()) == sorted(blocks.collect()) and at_once.count() == 30 * (15 if per else 5)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") >= 8


def test_mmr_asks_for_every_20th_vector(spark):
    from docloom.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, vectors = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=float)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = {ids[q]: {ids[i] for i in np.lexsort((ids, -(unit @ unit[q])))[:30]} for q in range(len(ids)) if ids[q] % 20 == 0}
    got = {}  # a query is its own first pick; after that all values are 0 but for rounding, so the order isn't compared
    for r in sorted(QUERIES["q_mmr"](spark, sf).collect(), key=lambda r: r.pick):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.keys() == near.keys() and len(near) == len(ids) / 20
    for q, picks in got.items():
        assert picks[0] == q and len(set(picks)) == 8 and set(picks) <= near[q]


def test_references_without_a_semicolon(spark):
    html = "<html><body><article><h1>a &amp;&amp</h1><p>x &copy 1 &lt;b&gt; &AMP; &#65; &nosuch; & y&amp<p>z</article></body></html>"
    r = spark.createDataFrame([(html,)], "h string").select(page_text("h", ended=True)["structured"].alias("ended"), page_text("h")["structured"].alias("all")).first()
    assert r["ended"] == "\n# a &&amp\n\nx &copy 1 <b> & A &nosuch; & y&amp\nz" and r["all"] == "\n# a &&\n\nx © 1 <b> & A &nosuch; & y&\nz"


def test_two_decimals_are_those_of_printf(spark):
    values = [0.625, 0.375, 0.125, 0.295, 0.285, 1.005, 2.675, 0.0, 99.995, 0.999, 1e-9, 7.0, -0.375, -2.5, 123456789.125, 1e20]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(text.two_decimals(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == [f"{v:.2f}" for v in values]
    words = "w " * 158 + "[SOURCE 1]"
    message = citations.problem_message(citations.validated(F.lit(words), F.lit(3)))
    assert one(spark, message) == "Citation density 0.62 per 100 words is too low."


def test_near_ties_and_copies_go_as_in_sql(spark):
    # similarities above 1 by rounding count as 1, so that equal ones go by key; copies give equal sums wherever they stand
    rng = np.random.default_rng(5)
    base = rng.integers(1, 9, size=(6, 4)).astype(float)
    rows = [(i, [float(x) for x in base[i % 6] * (1 + i // 6)], i % 3) for i in range(120)] + [(200, None, 0), (201, [0.0] * 4, 1), (202, [float("nan")] * 4, 2), (203, [1.0, None, 1.0, 1.0], 0), (204, [1.0], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    asked = v.filter("vec_id < 6").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))

    def alike(a, b):
        if a is None or None in a or len(a) != 4 or any(x != x for x in a) or not any(a):
            return 0.0
        total = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        return max(-1.0, min(1.0, total(a, b) / np.sqrt(total(a, a) * total(b, b))))

    for per in (None, ["label"]):
        want = set()
        for q in range(6):
            for group in ({0, 1, 2},) if per is None else ({0}, {1}, {2}):
                order = sorted((-alike(e, base[q]), i) for i, e, label in rows if label in group)
                want |= {(q, i, rank, -s) for rank, (s, i) in enumerate(order[:25], 1)}
        found = retrieve.top_k_of(asked, v, 25, per=per, whole=True)
        assert {(r.query_id, r.vec_id, r["rank"], r.similarity) for r in found.collect()} == want and "embedding" in found.columns


def test_few_rows_of_a_query_are_shuffled(spark):
    # each task hands on its k best, so vectors of no query's best stay where they are
    from docloom.operators.matrices import nearest

    rng = np.random.default_rng(6)
    v = np.repeat(rng.normal(size=(50, 8)), 40, axis=0)
    who, at, _ = nearest(v[:3], v, np.arange(len(v)), np.zeros(len(v), np.int64), 5, 64)
    assert len(who) == 15 and [list(at[who == q]) for q in range(3)] == [[0, 1, 2, 3, 4]] * 3


def test_sentences_are_split_once_for_all_windows(spark):
    rows = spark.createDataFrame([("A. B. C. D.",), ("",), (None,)], "t string").select(text.sentence_windows(F.split("t", text.SENTENCE_GAP, -1)).alias("w"))
    assert [r.w for r in rows.collect()] == [["A. B. C.", "C. D."], [""], []]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
