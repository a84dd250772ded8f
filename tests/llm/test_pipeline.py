"""The pipeline's stages against what they should keep, stage by stage."""

import pytest
from pyspark.sql import functions as F

cp = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    from docloom.llm.decontaminate import decontaminate
    from docloom.llm.simhash import simhash
    from docloom.llm.suffix_dedup import suffix_dedup

    raw = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "", None, None, 0), (9003, "12 ...", "en", "src1", 6), (9004, raw.filter("doc_id = 7").first().text, "en", "src2", 1), (9004, "Some words of their own here", "en", "src2", 1), (None, "Nobody numbered these words", "en", None, 1)], raw.schema)
    docs, kept = raw.unionByName(odd), []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        if k < len(cp.STAGES) - 1:
            assert out.columns == COLUMNS, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs)
    ids = [{r[0] for r in x.select("doc_id").collect()} for x in kept]
    everything = {r[0] for r in raw.select("doc_id").collect()}
    assert ids[0] == everything | {9004, None}
    groups = {}
    for r in simhash(kept[0]).collect():
        groups.setdefault(r.group_key, []).append((r.doc_id is None, r.doc_id or 0))
    assert sorted(min(g) for g in groups.values()) == sorted((r.doc_id is None, r.doc_id or 0) for r in kept[1].collect())
    assert [r.text for r in kept[1].filter("doc_id = 9004").collect()] == ["Some words of their own here"]  # its other row is a copy
    left = {r.doc_id: r.kept_text for r in suffix_dedup(kept[1], as_text=True).collect()}
    assert {r.doc_id: r.text for r in kept[2].collect()} == {i: x for i, x in left.items() if x.strip()}
    dirty = {r.doc_id for r in decontaminate(kept[2], spark.read.parquet(f"{SF}/benchmark.parquet")).filter("n_hit > 0").collect()}
    assert ids[3] == ids[2] - dirty and dirty
    assert ids[4] <= ids[3] and kept[4].filter("taken <= 0").count() == 0


def test_run(spark):
    assert cp.run(spark, SF).count() > 50
    assert [n for n, _ in cp.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "source_mixing"]


def test_unlike_rows_of_one_doc_id_stay_both(spark):
    rows = [(5, "a text about rivers and the towns that lie along them in the north"), (5, "wholly other words on cooking lentils with cumin, garlic and lemon"), (None, "a text about rivers and the towns that lie along them in the north"), (6, None), (7, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_hash", F.lit("mine"))
    kept = cp.near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([rows[0], rows[1], (6, "")])


def test_language_stage_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "words", None, "a"), (2, "12", None, "a"), (3, None, None, "a")], "doc_id long, text string, lang string, score string")
    assert [r.doc_id for r in cp.language(spark, docs, SF).collect()] == [1]
    known = docs.withColumn("lang", F.lit("en"))
    assert [(r.doc_id, r.score) for r in cp.language(spark, known, SF).collect()] == [(1, "a")]


def test_stages_on_empty_tables_and_long_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    long = docs.filter("doc_id = 3").withColumn("text", F.repeat(F.concat(F.col("text"), F.lit(" ")), 300)).withColumn("size", F.lit(1))
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, long, SF).select(long.columns).count() == 1, name
