from docloom import plans


def test_release_index_holds_whole_texts(spark, tmp_path):
    texts = ["short", "x" * 200, "word " * 400 + "needle", None]
    rows = [(i, t, "en", "src1") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    index = plans.QUERIES["k2_q5_release_index"](spark, str(tmp_path))
    assert {r.ord: r.text for r in index.where("part = 1").collect()} == dict(enumerate(texts))
    assert index.where("contains(text, 'needle')").count() == 1
