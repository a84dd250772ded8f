"""What the pipeline's stages do with columns whose names clash or hold dots, and language ID's letters and languages."""

import pytest
from pyspark.sql import functions as F

from docloom.llm import language_id

cp = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
CLASHING = ["kept", "kept_text", "n_bytes", "n_removed", "n_spans", "n_words", "n_hit", "item_ids", "lang_pred", "score", "fingerprint", "component_id", "group_key", "row_hash", "w", "marks", "order", "tie", "slice", "readings", "a.b", "a b", "`x", "kept_0"]


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_other_columns_stay_as_they_are(spark, name, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60")
    wide = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id")).alias(c) for c in CLASHING if c != "`x"])
    names = [c for c in CLASHING if c != "`x"]
    got = stage(spark, wide, SF)
    plain = stage(spark, docs, SF)
    assert got.columns[: len(wide.columns)] == wide.columns
    rows = got.collect()
    assert len(rows) == plain.count() and rows
    for r in rows:
        assert [r[c] for c in names] == [f"{c} of {r['doc_id']}" for c in names]
    common = docs.columns
    assert sorted(repr(tuple(r[c] for c in common)) for r in rows) == sorted(repr(tuple(r[c] for c in common)) for r in plain.collect())


def test_no_letters(spark):
    docs = spark.createDataFrame([(1, "the house and the tree", "en"), (2, "½ ² ³", "en"), (3, "Ⅳ ① ₂", None), (4, "日", None), (5, "_ 12", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, *language_id.learn(docs)).collect()}
    assert got == {1: "en", 2: "und", 3: "und", 4: "en", 5: "und"}


def test_languages_past_two_hundred_are_learned(spark, monkeypatch):
    rows = [(i, f"{chr(0x4E00 + i % 230)} " * 5, f"l{i % 230:03}") for i in range(460)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, table = language_id.learn(docs)
    assert len(langs) == 230
    assert all(r["lang_pred"] == r["lang"] for r in language_id.identify(docs, langs, table).collect())
    monkeypatch.setattr(language_id, "MATRIX_BYTES", 1 << 20)
    with pytest.raises(ValueError, match="230 values"):
        language_id.learn(docs)
