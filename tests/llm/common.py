"""Rows that every operator must stand: nulls, empty and long texts, ties, repeats, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rid long, row string, key string, n int, number int, taken long, task string"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns only carry names that operators use inside."""
    return spark.createDataFrame([(i, t, l, s, len(t or ""), 1, 2, "r", "k", 3, 4, 5, "t") for i, t, l, s in rows], SCHEMA)


LONG = " ".join(f"word{k % 977} thing{k % 31}" for k in range(20_000))
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "one", "en", None), (5, LONG, "en", "a"), (6, LONG, "en", "b"),
    (7, "same text here for all of us to see", "de", "b"), (8, "same text here for all of us to see", "de", "b"), (8, "same text here for all of us to see", "de", "b"),
    (8, "another text with the same id, quite another one", "de", "b"), (None, "no id at all but some words", "fr", "c"), (9, "naïve çedilla ünïcode 日本語 \U0001f600 text", "fr", "c"),
]
