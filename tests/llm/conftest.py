import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, anchor int, kept_id bigint, own_id string, values array<int>, content string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text, source), with extra columns named as operators might name theirs."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", 1, 2, "y", [1], "z") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


#: Nulls, empty and blank texts, a tie, a repeated row, a very long text, and text that isn't ASCII.
ODD = [
    (None, None, None),
    (1, None, "s"),
    (2, "", None),
    (3, " \n\t ", "s"),
    (4, "one", "s"),
    (5, "The same text for both of them, twelve words long, so it says.\nAnd a second line that has seven words", "a"),
    (6, "The same text for both of them, twelve words long, so it says.\nAnd a second line that has seven words", "b"),
    (6, "The same text for both of them, twelve words long, so it says.\nAnd a second line that has seven words", "b"),
    (7, "été 漢字 😀 " * 40, "a"),
    (8, " ".join(f"w{i}" for i in range(30_000)), "b"),
    (None, "a text without an id but with words in it", "s"),
]


@pytest.fixture(scope="session")
def odd(frame):
    return frame(ODD)


@pytest.fixture(scope="session")
def nothing(frame):
    return frame([])
