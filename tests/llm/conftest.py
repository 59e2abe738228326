import pytest

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 12_000  # about 320,000 characters


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns that clash with internal names."""
    texts = [
        (1, "Alpha beta gamma delta.", "en", "s1", 23),
        (1, "Alpha beta gamma delta.", "en", "s1", 23),
        (2, "alpha  beta\tgamma\ndelta.", "en", "s1", 24),
        (3, None, None, None, None),
        (4, "", "en", "s2", 0),
        (5, " \n\t ", "de", None, 4),
        (6, LONG, "en", "s1", len(LONG)),
        (7, LONG, "en", "s1", len(LONG)),
        (None, "Ünïcode — text ▁ with 😀 signs", "fr", "s3", 28),
        (None, None, None, None, None),
        (8, "AlphaBetaGammaDelta.", "en", "s1", 20),
        (9, "x", "en", "s1", 1),
    ]
    clash = ("fp", "cell", "digest", "kept", "label", "score", "base", "terms", "head", "len", "f", "_gone_id", "rep", "items", "starts")
    rows = [(*t, *([7] * len(clash))) for t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clash)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def plain(spark, sf):
    """Documents of the smallest folder as (doc_id, text)."""
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
