import corpus_pipeline as P


def test_texts_that_share_an_id_stay(spark):
    one, two = "one text about ships that sail over the wide sea", "another text about trains that cross the high hills"
    docs = spark.createDataFrame([(1, one), (1, two), (1, two), (2, "a third text of some few plain words about nothing")], "doc_id long, text string")
    kept = P.near_duplicates(spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, two), (1, one), (2, "a third text of some few plain words about nothing")]
