import pytest

ODD = [
    (1, "The cat sat on the mat and the dog lay by the door."), (2, None), (3, ""), (4, "   \n\t "), (5, "12345 !!! ..."),
    (6, "The cat sat on the mat and the dog lay by the door."), (7, "word " * 30000), (8, "é́\U0001f600 ñandú 漢字 ｆｕｌｌ"),
    (9, "x" * 40000), (None, "A text without an id, which has some words in it."), (1, "The cat sat on the mat and the dog lay by the door."),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, a null id, repeated rows and texts, very long ones, and columns with clashing names."""
    rows = [(i, t, "en", f"s{i}", 0, "mine", 0.5, "f", 3, True) for i, t in ODD]
    names = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score double, shard string, piece int, held_out boolean"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
