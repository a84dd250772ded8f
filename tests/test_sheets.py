"""Workbooks put together by hand, tools and nested cleaning."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import records
from docloom.functions.text import nul_free
from docloom.operators.tools import Tools
from docloom.plans.more_queries import column_name, xlsx_bytes
from docloom.plans.office_files import zipped
from docloom.sources import readers, sheets


def rows_of(spark, content):
    return [(r["sheet"], r["row"], r["cells"], r["error"]) for r in sheets.sheet_rows(spark.createDataFrame([("p", content)], "path string, content binary")).collect()]


def test_xlsx(spark):
    book = [("One & two", [["a", "b", "c"], [1, None, 2.5], [None, None, None], ["x<y", "", 41_000]]), ("Empty", []), ("Wide", [[None] * 27 + ["far"]])]
    assert rows_of(spark, xlsx_bytes(book)) == [("One & two", 1, ["a", "b", "c"], None), ("One & two", 2, ["1", None, "2.5"], None), ("One & two", 4, ["x<y", "", "2012-04-01"], None), ("Wide", 1, [None] * 27 + ["far"], None)]
    assert [column_name(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_xlsx_kinds_of_cells(spark):
    cells = '<c r="A1" t="b"><v>1</v></c><c r="B1" t="str"><v>made</v></c><c r="C1" t="e"><v>#N/A</v></c><c r="D1" s="1"><v>1.5</v></c><c r="E1" s="2"><v>3</v></c><c><v>6</v></c><c r="H1" t="s"><v>9</v></c>'
    parts = {
        "_rels/.rels": "<Relationships/>",
        "xl/workbook.xml": '<workbook xmlns:r="r"><workbookPr date1904="1"/><sheets><sheet name="S" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Type="x/worksheet" Target="/xl/s.xml"/><Relationship Id="b" Type="x/styles" Target="styles.xml"/></Relationships>',
        "xl/s.xml": f"<worksheet><sheetData><row>{cells}</row></sheetData></worksheet>",
        "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="200" formatCode="0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="200"/></cellXfs></styleSheet>',
    }
    assert rows_of(spark, zipped(parts)) == [("S", 1, ["true", "made", "#N/A", "1904-01-02 12:00:00", "3", "6", None, None], None)]


def test_ods(spark):
    table = '<table:table table:name="T"><table:table-row><table:table-cell office:value-type="string"><text:p>a</text:p><text:p>b</text:p></table:table-cell><table:table-cell table:number-columns-repeated="2" office:value-type="float" office:value="1.5"><text:p>1,5</text:p></table:table-cell><table:table-cell table:number-columns-repeated="1000"/></table:table-row><table:table-row table:number-rows-repeated="3"><table:table-cell/></table:table-row><table:table-row table:number-rows-repeated="2"><table:table-cell/><table:table-cell office:value-type="date" office:date-value="2024-01-02"/></table:table-row><table:table-row table:number-rows-repeated="1000000"><table:table-cell table:number-columns-repeated="1000"/></table:table-row></table:table>'
    names = 'xmlns:office="o" xmlns:table="t" xmlns:text="x"'
    content = zipped({"content.xml": f"<office:document-content {names}><office:body><office:spreadsheet>{table}</office:spreadsheet></office:body></office:document-content>"})
    assert rows_of(spark, content) == [("T", 1, ["a\nb", "1.5", "1.5"], None), ("T", 5, [None, "2024-01-02"], None), ("T", 6, [None, "2024-01-02"], None)]


def test_damage_and_side_cars(spark, tmp_path):
    good = xlsx_bytes([("S", [["k", "v"], *([i, f"v{i}"] for i in range(20))])])
    files = spark.createDataFrame([("good", good), ("cut", good[: len(good) // 2]), ("none", None), ("other", zipped({"x": "<a/>"})), ("empty", xlsx_bytes([("S", [])]))], "path string, content binary")
    texts = {r["path"]: r for r in sheets.workbook_texts(files).collect()}
    assert texts["good"]["text"].startswith("=== Sheet: S ===\nShape: 20 rows × 2 columns\nColumns: k, v\n\nSample (first rows):\n0 | v0\n") and texts["good"]["text"].endswith("18 | v18\n19 | v19")
    assert {p: texts[p]["status"] for p in texts} == {"good": "success", "cut": "failed", "none": "failed", "other": "failed", "empty": "failed"}
    sheets.write_side_cars(sheets.sheet_rows(files), f"{tmp_path}/cars")
    assert spark.read.parquet(f"{tmp_path}/cars").filter("path = 'good'").count() == 21
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.xlsx").write_bytes(good)
    found = readers.Registry().extract(spark.read.format("binaryFile").load(f"{tmp_path}/in").select("path", "content")).collect()
    assert found[0]["status"] == "success" and "Columns: k, v" in found[0]["text"]


def test_tools(spark):
    known = Tools()
    with pytest.raises(ValueError):
        known.run(spark.range(1), F.lit("A"))
    known.register("one", "first", "A", "B")(lambda rows: rows.withColumn("by", F.lit(1)))
    known.register("two", "second", "B")(lambda rows: rows.withColumn("by", F.lit(2)))
    rows = spark.createDataFrame([(1, "A", None), (2, "B", "two"), (3, "B", "none"), (4, "C", "one"), (5, "A", "two"), (6, None, None)], "id int, intent string, wanted string")
    got = {r["id"]: (r["tool"], r["by"]) for r in known.run(rows, F.col("intent"), F.col("wanted")).collect()}
    assert got == {1: ("one", 1), 2: ("two", 2), 3: ("one", 1), 5: ("one", 1)} and [x.name for x in known.for_intent("B")] == ["one", "two"]


def test_nul_free(spark):
    rows = spark.sql("SELECT 1 AS n, concat('a', chr(0)) AS s, array(struct(concat(chr(0), 'b') AS x, 2 AS y), null) AS list, map('k', array(concat('c', chr(0)))) AS m, cast(null AS struct<z: string>) AS gone, concat('d', chr(0)) AS `a.b`")
    r = nul_free(rows).first()
    assert (r["n"], r["s"], r["list"][0]["x"], r["list"][0]["y"], r["list"][1], r["m"], r["gone"], r["a.b"]) == (1, "a", "b", 2, None, {"k": ["c"]}, None, "d")
    assert nul_free(rows).schema.simpleString() == rows.schema.simpleString()


def test_voices(spark):
    rows = spark.createDataFrame([("ja", "Host"), ("ja", "guest"), ("xx", "host"), (None, None)], "lang string, who string")
    got = [tuple(r) for r in rows.select(records.voice(F.col("lang"), F.col("who")), records.language_name(F.col("lang"))).collect()]
    assert got == [("ja-JP-KeitaNeural", "Japanese"), ("ja-JP-NanamiNeural", "Japanese"), ("en-US-GuyNeural", "xx"), ("en-US-JennyNeural", None)]


def test_large_keys_are_no_dates(spark):
    from docloom.plans.more_queries import Number

    book = [("S", [["key", "day"], [Number(41_000), 41_000]])]
    assert rows_of(spark, xlsx_bytes(book))[1] == ("S", 2, ["41000", "2012-04-01"], None)


def test_sheets_of_suppliers_with_large_keys(spark, tmp_path):
    from docloom.plans.queries import QUERIES

    spark.createDataFrame([(40_597, "Supplier", 3, 1.5)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    assert {r["cells"] for r in QUERIES["q_sheets"](spark, str(tmp_path)).filter("sheet = 'Suppliers'").collect()} == {"key|name|balance", "40597|Supplier|1.5"}
