import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, h long, score double, start long, word string, row long, trained boolean, shard long"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, extra columns with clashing names."""
    own = [
        (None, None, None, None, None), (None, "a text without an id", "en", "s", 20), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \n\t ", None, None, 4),
        (4, "same words again and again", "en", "s", 26), (4, "same words again and again", "en", "s", 26), (4, "another text of that id", "en", "s", 23), (5, "123 456", "de", "s", 7),
        (6, "Über große Wälder 你好 mail a.b@c-d.org, call +49 (30) 1234567-8, ip 1.2.3.4, card 4111 1111 1111 1111", "de", "s", 90), (7, "word " * 60_000, "en", "s", 300_000), (8, "x" * 100_000, None, "s", 100_000), (9, "<|endoftext|> ### \x1c \x00 it's", "fr", "s", 20),
    ]
    return spark.createDataFrame([(*r, 1, 2, 0.5, 3, "w", 4, True, 5) for r in own], SCHEMA)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
