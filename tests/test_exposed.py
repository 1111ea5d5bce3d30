from pyspark.sql import functions as F

from podia.operators import privacy


def test_a_word_is_one_row_whatever_the_lengths_of_names(spark):
    texts = spark.createDataFrame([("one Two three\nfour\nFive STRASSE ß",)], "text string")
    _, latin = privacy._in_text(F.col("text"))
    assert texts.select(F.explode(latin).alias("r")).toPandas()["r"].tolist() == ["one two three", "two three", "five strasse ss", "strasse ss"]


def test_names_share_their_first_words(spark):
    names = spark.createDataFrame([("Ann Lee",), ("Ann Lee Roe",), ("Ann Lee Roe Poe",), ("Roe Poe",), ("Iz Ok",), ("王大明",)], "name string")
    texts = spark.createDataFrame([(1, "x ANN lee  roe Poe, Ann\nLee; 小王大明"), (2, "Ann Lee İz Ok"), (3, "ẞ Ann Lee"), (4, None)], "id int, text string")
    got = {(r.id, r.key): r.hits for r in privacy.exposed_names(texts, names, by=["id"]).collect()}
    assert got == {(1, "ann lee"): 1, (1, "ann lee roe"): 1, (1, "ann lee roe poe"): 1, (1, "roe poe"): 1, (1, "王大明"): 1, (2, "ann lee"): 1, (3, "ann lee"): 1}
