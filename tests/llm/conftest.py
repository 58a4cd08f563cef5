import pytest

#: Null, empty, very long and repeated texts, ties, repeated and null ids.
LONG = " ".join(f"word{i % 997} and, so on" for i in range(40_000))
TEXTS = [
    (1, "The General Public License. CC BY! All rights reserved"), (2, "the general public license. cc by! all rights RESERVED"),
    (3, None), (4, ""), (5, LONG), (6, LONG + " tail"), (7, " \t\n "), (8, "two  spaces\u00a0and \x1c odd \u2003 ones"),
    (9, "éÉ ßẞ İı Σσς naïve <|endoftext|> it's"), (9, "same id, other text"), (10, "a b c d e f g h i j"),
    (10, "a b c d e f g h i j"), (None, "no id at all here"), (50, "x"), (60, "don't stop...\n\n\nnow   please"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", f"s{k % 3}" if k % 4 else None, 0, 7, "x", 1) for k, (i, t) in enumerate(TEXTS)]
    return stored(spark, rows, "doc_id long, text string, lang string, source string, n_chars long, size long, "
                               "label string, node int")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


def stored(spark, rows, schema):
    from sigwin.llm.common import stored as write
    return write(spark.createDataFrame(rows, schema).repartition(3), "fixture")
