import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, empty texts, white space, copies, a repeated row and extra columns of clashing names."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a", 1),
        (2, "the  quick\tbrown fox\njumps over the lazy dog", "en", "a", 1),
        (3, None, "en", None, 1),
        (4, "", None, "b", 1),
        (5, " \n", "fr", "b", 1),
        (6, "le renard brun saute par dessus le chien paresseux", "fr", "b", 1),
        (6, "le renard brun saute par dessus le chien paresseux", "fr", "b", 1),
        (7, "12345 !!! 678", "fr", "c", 1),
        (None, "a row without an id", "en", "a", 1),
        (8, "word " * 30000, "en", "a", 1),
        (9, "x" * 200000, "fr", "a", 1),
        (0, "le renard brun saute par dessus le chien paresseux", "fr", "a", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("digest", "content", "members", "size", "taken", "f", "d", "score", "ids", "_key", "kept", "keep_id", "_id", "_sha", "_f", "_doc", "_salt", "row", "d", "t", "sha", "id", "stays", "times", "mark", "n", "key", "salt", "content", "member", "words", "label", "rank", "text_sha256", "n_tokens", "_source", "_range", "_name"):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(4)
