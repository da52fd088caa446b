"""The pipeline's stage of secrets on documents with and without n_chars."""

import corpus_pipeline


def test_secrets_with_and_without_lengths(spark):
    docs = spark.createDataFrame([(1, "token = abcdefghijklmnop", 24), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    with_, without = (corpus_pipeline.secrets(spark, d, "").orderBy("doc_id").collect() for d in (docs, docs.drop("n_chars")))
    assert [r["text"] for r in with_] == [r["text"] for r in without]
    assert "abcdefghijklmnop" not in with_[0]["text"] and with_[2]["text"] == "clean" and with_[1]["text"] is None
    assert [r["n_chars"] for r in with_] == [len(with_[0]["text"]), None, 5]
