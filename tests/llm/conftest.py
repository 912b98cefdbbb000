import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, label string, term string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty, very long and repeated texts, and columns whose names clash with the operators' own."""
    prose = "the quick brown fox jumps over the lazy dog and runs through the green field again "
    texts = [None, "", "  \t\n", "one", "Über straße für", prose * 3, prose * 3, prose.upper() * 3, "x" * 70_000, prose * 900, "1234 5678", "a <|im_end|> b", 'token = "0123456789abcdef0123"']
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, None, "z", "k", "l", "t") for i, t in enumerate(texts)]
    rows += [(None, prose, "en", "s1", 3, None, None, None, None), rows[5], rows[5]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)
