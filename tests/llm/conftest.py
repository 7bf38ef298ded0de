import pytest

ROWS = [
    (1, "The red fox runs over the hill. " * 30, "en", "a"),
    (2, "", "en", "a"),
    (3, None, None, None),
    (4, "Der rote Fuchs läuft über den Hügel und ruht. " * 20, "de", "b"),
    (5, "The red fox runs over the hill. " * 30, "en", "a"),
    (6, "12 34 !!", "en", "b"),
    (7, "x" * 3000, "en", "b"),
    (8, "one", "en", "b"),
    (9, " \n\t ", "de", "b"),
    (10, "日本語のテキスト 😀 ß İ Σ " * 40, "ja", "c"),
    (11, "Start here. " + "The red fox runs over the hill. " * 12 + " and ends there", "en", "a"),
]
#: Extra columns whose names the operators use inside.
CLASHING = "doc_id long, text string, lang string, source string, fp long, owner long, score double, spans string, piece string"


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty and long texts, copies, and columns that clash with inner names."""
    return spark.createDataFrame([(*r, 1, 2, 0.5, "s", "p") for r in ROWS], CLASHING)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], CLASHING)


@pytest.fixture
def folder(spark):
    from quernstone.llm.common import shared_dir

    return shared_dir(spark)
