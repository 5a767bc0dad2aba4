import os

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, a string, g string, words string, _cut string, _cut_id long, key string, row string, probability string"
have_tables = os.path.isdir(MID)


def messy(spark, texts=None):
    """Nulls in every column, empty, blank, tiny and very long texts, repeated rows and ids, columns whose names clash."""
    rows = texts if texts is not None else [
        (1, "one two three four five six seven eight"), (1, "one two three four five six seven eight"), (2, "one two three four five six seven eight"), (3, ""), (4, None), (None, "one two three four five six seven eight"), (5, "   \n\t "), (6, "x"),
        (7, "lorem ipsum dolor " * 20000), (8, "é😀" * 3), (9, "w" * 50000), (10, "a b"), (1, "another text under the same id"), (None, None),
    ]
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", None if k % 2 else "s", None if t is None else len(t), 99, "x", "y", None, "z", 5, None, "r", "p") for k, (i, t) in enumerate(rows)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
