from rolloutlens.plans import entities


def test_all_words_of_the_reference_are_excluded(spark):
    assert len(set(entities.EXCLUDED)) == len(entities.EXCLUDED) == 295
    docs = spark.createDataFrame([(1, "From Of To Walmart Grandma Legos. Christmas As Was By With Anna's Brothers Boyd")], "doc_id long, text string")
    assert entities.entity_names(docs).first()["names"] == ["Anna", "Boyd"]
