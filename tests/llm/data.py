"""Rows that every operator must bear."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, label string, shard int, print long, content long, block long, u long"


def odd_rows():
    long = "word number after word and so on. " * 20_000
    texts = [
        "The quick brown fox jumps over the lazy dog near the river bank today.",
        "The quick brown fox jumps over the lazy dog near the river bank today.",
        "the QUICK brown fox jumps over the lazy dog near the river bank today.",
        "", None, " \t\n ", "one", "One two", "1234 !!! ???", "Der schnelle Fuchs läuft über die Straße.", "Le renard brun saute par-dessus le chien.", long, long, "日本語のテキスト", "a b c <|endoftext|> d",
    ]
    rows = [(i, t, ["en", "de", "fr", None][i % 4], ["a", "b", "c", None][i % 4] if i != 3 else "", 7, 8, 9, "x", 1, 2, 3, 4, 5) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "no id here", None, None, *rows[0][4:]), (None, None, None, None, *[None] * 9), (-5, "a negative id", "en", "a", *rows[0][4:])]
    return rows


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
