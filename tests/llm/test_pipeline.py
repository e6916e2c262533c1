"""The pipeline's stages, each on what the one before kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from quantspark.llm import mixing, neardup, quality, suffix

ROOT = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, ROOT).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() > 0
        if name in ("quality", "near_dedup"):  # texts stay as they are
            assert docs.join(before, columns, "left_semi").count() == docs.count() <= before.count()
        if name == "near_dedup":
            assert docs.select("text").distinct().count() == docs.count()
        if name == "suffix_dedup":
            assert docs.count() <= before.count() and suffix.removed_of_documents(docs).where("n_removed > n_bytes").count() == 0
        if name != "bpe":
            assert docs.columns == columns
    assert docs.columns == ["doc_id", "ids", "decoded"] and docs.count() == before.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, ROOT).count() > 0


CLASHING = ("score", "predicted", "_id", "_key", "_text_key", "t1", "k1", "taken", "parts", "size", "text_key", "source_key", "copy", "words_", "node", "root", "y")


def stage_results(spark, docs, labels):
    return {
        "keep_good": quality.keep_good(docs, labels), "keep_first": neardup.keep_first(docs),
        "without_repeats": suffix.without_repeats(docs), "mixed_texts": mixing.mixed_texts(docs),
    }


def test_stages_keep_clashing_columns_and_odd_rows(spark):
    rows = [(None, "no id " * 30, "en", "a", 1), (1, None, None, None, 2), (2, "", "en", "", 3), (3, "one two three four five six seven", "en", "a", 4)]
    rows += [(3, "one two three four five six seven", "en", "a", 4)] * 2 + [(4, "long words here " * 20_000, "de", "b", 5), (5, "ünïcode ✓ text " * 30, None, None, 6)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (5, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    wide = plain
    for c in CLASHING:
        wide = wide.withColumn(c, F.concat(F.lit(f"{c} of "), F.coalesce("lang", F.lit("none"))))
    due = stage_results(spark, plain, labels)
    for name, out in stage_results(spark, wide, labels).items():
        assert out.columns == wide.columns, name
        got = out.collect()
        assert all(r[c] == f"{c} of {r.lang or 'none'}" for r in got for c in CLASHING), name
        assert sorted(map(str, (tuple(r[c] for c in plain.columns) for r in got))) == sorted(str(tuple(r)) for r in due[name].collect()), name
    for name, out in stage_results(spark, wide.limit(0), labels).items():
        assert out.count() == 0 and out.columns == wide.columns, name


def test_labels_of_other_documents_take_no_place(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    labels = spark.read.parquet(f"{ROOT}/labels.parquet")
    foreign = spark.range(30_000).select((F.col("id") + 10_000_000).alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality.learn(docs, labels.unionByName(foreign, allowMissingColumns=True)).base == quality.learn(docs, labels).base
