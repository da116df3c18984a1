import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null and empty texts, ties and repeated rows, a very long text, columns with clashing names."""
    long = " ".join(f"w{k % 977} zeta{k % 13}" for k in range(30_000))
    same = "alpha beta gamma delta\n  Footer LINE \nepsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 3), (4, long, "en", "a", len(long)), (5, same, "en", "b", 9), (5, same, "en", "b", 9), (6, same + " nu", "de", "b", 9), (None, same, "en", "b", 9), (7, "x", "en", "b", 1), (8, "É é ß 中 \x00 👍", "fr", None, 9)]
    rows += [(k, f"Line {k}\nfooter line\nanother {k % 3}", "en", "c", 9) for k in range(20, 40)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 as key", "'x' as shard", "2 as size", "'y' as window", "3 as pos", "4 as h1", "5L as fp", "6 as score", "7 as bits", "8 as hits", "9 as kept_text", "10 as row", "11 as text_", "12 as scan", "13 as component", "14 as __row", "15 as made", "16 as number")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
