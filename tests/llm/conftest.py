import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, id long, size int"

PASSAGE = "The quick brown fox jumps over the lazy dog while seventeen other animals watch from the hill and count every leap that it makes in the long summer evening before the rain begins to fall. " * 3
LONG = " ".join(f"word{i * 7919 % 10007}" for i in range(30_000))
WORDS = " ".join(f"w{i}" for i in range(100))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, near copies, clashing extra columns."""
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a"), (6, "A"), (7, "one two"), (7, "one two"), (None, "no id at all but some words"),
        (9, LONG), (10, LONG + " tail"), (11, "x" * 5 + PASSAGE + "left é"), (12, "ñandú " + PASSAGE), (13, PASSAGE + PASSAGE), (14, WORDS), (15, WORDS.replace("w50 ", "other ")),
        (16, "aaaa " * 300), (17, "<|endoftext|> and <b>#1</b>"), (18, "line one\nline one\nline two !!\n\nline one"), (19, "😀   nbsp  spaces"), (20, "12345 67890 !!! ???"),
    ]
    rows = [(i, t, None if i and i % 5 == 0 else "en", None if i and i % 4 == 0 else "s" + str((i or 0) % 3), len(t) if t else None, "c", 1, 2) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
