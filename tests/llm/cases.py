"""Awkward rows that every operator must take."""

LONG = "word " * 40_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, hash string, bucket int, score double, labels string, label int, key string, vector string"
_REST = (7, "x", "h", 3, 0.5, "l", 4, "k", "v")
ROWS = [
    (1, None, "en", "a", 0, *_REST),
    (2, "", "en", "a", 0, *_REST),
    (3, " \t\n ", None, "b", 4, *_REST),
    (4, "One two three four five six seven eight nine ten.", "en", "b", 50, *_REST),
    (5, "One two three four five six seven eight nine ten.", "en", None, 50, *_REST),
    (5, "One two three four five six seven eight nine ten.", "en", None, 50, *_REST),
    (None, "A text without an id, twice.", "en", "a", 20, *_REST),
    (None, "A text without an id, twice.", "en", "a", 20, *_REST),
    (6, LONG, "en", "c", len(LONG), *_REST),
    (7, "Ünïcödé 漢字 😀 <|endoftext|> it's\r\n\r\n  x", "de", "a", 30, *_REST),
    (8, "!!! ... ???", "en", "a", 11, *_REST),
    (9, "hi", "en", "a", 2, *_REST),
]


def edge_docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def no_docs(spark):
    return edge_docs(spark, [])
