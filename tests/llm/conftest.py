import pytest

DOCS = "doc_id long, text string, source string, `index` int, lang string"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards box with quartz judges".split()


def prose(seed: int, n: int = 60) -> str:
    return " ".join(WORDS[(seed * 7 + i * i + i // 3 * seed) % len(WORDS)] + str((seed * 31 + i) % 97) for i in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty, blank and very long texts, copies, near copies, ties, repeated rows, extra columns."""
    base = prose(1)
    rows = [
        (1, base), (2, base), (3, base.replace("quick", "Quick")), (4, base + " tail"), (5, None), (6, ""), (7, " \n\t "), (8, "one two"), (9, "One  two"), (10, "word " * 3000),
        (11, "x" * 30000), (12, prose(2, 900)), (13, prose(2, 900) + " " + prose(3, 40)), (14, "É ñ 中文 <|endoftext|> it's 42!!\n\nB\nB\n"), (15, prose(4)), (15, prose(4)), (None, base), (None, None),
    ]
    return spark.createDataFrame([(i, t, "s", 0, "en") for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
