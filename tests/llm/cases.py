"""A small documents table with the awkward cases: nulls, empty and long texts, ties, repeats, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, fp string, size string, key string, root string, block string, kept string"

LONG = " ".join(f"word{i % 977} more{i % 13}" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf tonight " * 6
TEXTS = [
    (1, BASE, "en", "a"),
    (2, BASE.replace(" ", "  ", 3).replace("fox ", "fox\t"), "en", "a"),
    (3, BASE + "again", "en", None),
    (4, "", None, "a"),
    (5, None, "en", "b"),
    (6, " \n\t ", "en", "b"),
    (7, "Der schnelle braune Fuchs springt über den faulen Hund und läuft weg", "de", "c"),
    (8, "one", "en", "c"),
    (9, "One", "en", "c"),
    (10, LONG, "en", "a"),
    (11, LONG + " end", "en", "a"),
    (12, "12345 678 !!!", None, "d"),
    (13, "Released under the MIT License. Licenced under teh Apache License, Version 2.0", "en", "é"),
    (14, "日本語 テキスト ▁ 😀 naïve", "de", "é"),
    (8, "one", "en", "c"),
    (None, "nobody knows this text at all", "en", None),
    (None, None, None, None),
]


def documents(spark, rows=TEXTS):
    data = [(i, t, lang, s, len(t or ""), 7, "x", "y", "z", "r", "b", "k") for i, t, lang, s in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
