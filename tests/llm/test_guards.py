"""What must not happen without a word: wrapped scores, a corpus dropped whole, codes that overflow."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from drawscope.llm import langid, queries, topk

VECTORS = "vec_id long, embedding array<double>"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_scores_that_could_pass_64_bits_are_an_error(spark):
    far = spark.createDataFrame([(0, [1e300, 1.0]), (1, [10.0, 1.0]), (2, [3.0, 2.0])], VECTORS)
    with pytest.raises(PySparkException, match="62 bits"):
        topk.top_k(far, far.where("vec_id = 1")).collect()
    near = spark.createDataFrame([(0, [3e16, 1.0]), (1, [10.0, 1.0]), (2, [3e16, -3e16])], VECTORS)
    with pytest.raises(PySparkException, match="64 bits"):
        topk.top_k(near, near.where("vec_id = 0")).collect()
    large = spark.createDataFrame([(0, [1.0, 0.0]), (1, [3e16, 5.0]), (2, [-3e16, 7.0]), (3, [2.0, 3e16])], VECTORS)
    got = topk.top_k(large, large.where("vec_id = 0"), scale=1.0).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 3 * 10**16), (3, 2), (2, -3 * 10**16)]


def kept(spark, rows):
    import corpus_pipeline

    return sorted((r.text, r.lang) for r in corpus_pipeline.language(spark, spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], DOCS), "").collect())


def test_no_document_goes_where_no_language_can_be_learnt(spark):
    texts = [f"the quick brown fox number {'x' * i} jumps" for i in range(8)]
    assert kept(spark, [(i, t, None) for i, t in enumerate([*texts, "12 34", None, ""])]) == sorted((t, None) for t in texts)
    held = [r.i for r in spark.range(200).select(F.col("id").alias("i"), queries.remainder("id", 4).alias("r")).where("r = 2").limit(8).collect()]
    assert kept(spark, [(i, t, "en") for i, t in zip(held, texts, strict=True)]) == sorted((t, "en") for t in texts)


def test_rows_without_ids_train_and_are_not_held_out(spark, tmp_path):
    rows = [(None, f"der schnelle braune fuchs {i} springt über den hund", "de") for i in range(20)] + [(None, f"the quick brown fox {i} jumps over the dog", "en") for i in range(20)]
    assert [x for _, x in kept(spark, rows)] == ["de"] * 20 + ["en"] * 20
    spark.createDataFrame([(*r, "s", 9) for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, 1), (None, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op10_language_id(spark, str(tmp_path)).collect()
    assert len(got) == 40 and not any(r.held_out for r in got) and {r.lang_pred for r in got} == {"de", "en"}
    assert not any(r.held_out for r in queries.op9_quality(spark, str(tmp_path)).collect())


def test_a_filter_on_the_language_runs_it_once_a_row(spark):
    import corpus_pipeline

    rows = [(i, f"{t} {i}", lang, "s", 9) for i in range(8) for t, lang in (("the quick brown fox", "en"), ("der schnelle fuchs", "de"))]
    out = corpus_pipeline.language(spark, spark.createDataFrame(rows, DOCS), "")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(r.lang for r in out.collect()) == ["de"] * 8 + ["en"] * 8


def test_orders_whose_codes_would_overflow_are_refused(spark):
    docs = spark.createDataFrame([(1, "abcdefghij", "en")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="order 7"):
        langid.fit(docs, order=7)
    model = langid.fit(docs, order=6)
    assert langid.with_language(docs, model).first().lang_pred == "en"
