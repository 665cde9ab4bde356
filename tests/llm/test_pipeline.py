"""The stages of the pipeline, one after the other, over the smallest tables."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert docs.columns == columns
        assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] == sizes[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_empty_and_null(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    none = spark.createDataFrame([], schema)
    nulls = spark.createDataFrame([(None,) * len(schema.fields)] * 2, schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
        assert stage(spark, nulls, SF).count() <= 2


def test_clashing_columns_ties_and_a_long_text(spark, tmp_path):
    """Columns that are called like what the operators add are handed on, repeated rows don't crash, a long text goes through whole."""
    clash = {"n_words": 1, "kept": 2, "secrets": 3, "clean_text": 4, "n_failed_lines": 5, "n_removed": 6, "kept_text": 7, "_id": 8, "_key": 9, "_stays": 10}
    line = "The %s sentence of document %d says something about %s. "
    rows = [(i, "".join(line % (f"w{i}a{k}", i * 100 + k + 70_000, f"x{k}y{i}") for k in range(12)), "en", "s") for i in range(12)]
    rows += [rows[3], rows[3], (4, "Another text under the same id has some words of its own, so that it stays here. " + rows[5][1][:60] + "end.", "en", "s")]
    rows += [(50, "".join(line % (f"v{k}", k, f"u{k * 7}") for k in range(60_000)), "en", "s"), (None, None, None, None), (51, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit(x) for c, x in clash.items()})
    columns, long = docs.columns, rows[-3][1]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert docs.columns == columns
        found = docs.collect()
        assert all(r[c] == x for r in found for c, x in clash.items()) and all(len(r.text) == r.n_chars for r in found)
        assert [r.text for r in found if r.doc_id == 50] == [long]
    assert sorted(r.doc_id for r in found) == sorted([*range(12), 4, 50])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("doc_id = 50").agg(F.sum("length")).first()[0] > 500_000
