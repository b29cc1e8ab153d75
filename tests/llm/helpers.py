"""Small documents with every awkward case, and reference versions of the words' definitions."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


AWKWARD = [
    (1, "The cat sat on the mat. " * 8, "en", "s", 1),
    (2, "", "en", None, 0),
    (3, None, None, "s", None),
    (None, "no id here but some words", "en", "s", 5),
    (None, "no id here but some words", "en", "s", 5),
    (4, "The cat sat on the mat. " * 8, "en", "s", 1),
    (4, "The cat sat on the mat. " * 8, "en", "s", 1),
    (5, " \t\n \x0b\x0c\r", "xx", "s", 2),
    (6, "Éa ÀB straße \u2003 中文 😀 <|endoftext|> a\xa0b\x85c \x1c d", "fr", "s", 3),
    (7, "long " * 60_000, "en", "s", 9),
    (8, "x" * 200_000, "en", "s", 9),
    (9, "one", "en", "s", 1),
]


def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns under names that operators use themselves."""
    from pyspark.sql import functions as F

    for name in "words m r n_words kept fp root node blob spans terms block name kept_id row_id row_text text_ shard size copy k1 a b u v host path rule verdict id t at".split():
        if name not in df.columns:
            df = df.withColumn(name, F.lit("z"))
    return df
