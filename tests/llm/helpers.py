"""Awkward rows that every corpus operator has to survive."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} the" for i in range(40_000))
BASE = " ".join(f"alpha{i} beta{i % 7} gamma" for i in range(60))
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b\x0c\r ", "en", "a", 7),
    (4, "one", "en", "b", 3),
    (5, "One  TWO\nthree", "en", "b", 14),
    (6, "one two three", "en", "b", 13),
    (7, LONG, "en", "a", len(LONG)),
    (8, BASE, "en", "a", len(BASE)),
    (9, BASE, "en", "c", len(BASE)),
    (9, BASE, "en", "c", len(BASE)),
    (10, BASE + " more", "en", "c", 1),
    (11, "éÉ ñ 😀 x y #tag$ a|b <c>", "fr", "d", 1),
    (12, "same line here\nsame line here\n\nother\nsame line here ", "en", None, 1),
    (None, "no id at all", "en", "a", 1),
    (14, "'s don't 'still abc123def !!! \r\n\n  x", "en", "d", 1),
]


def frame(spark, rows=ROWS):
    """With extra columns whose names clash with results and internals."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("h", "fp", "size", "target", "block", "keep_id", "n_words", "kept", "fail_bits", "draws", "s", "b", "d", "body", "id", "score", "_c0"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
