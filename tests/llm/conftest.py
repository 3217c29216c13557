import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def llm(spark):
    from reeltide.llm.common import ship
    return ship(spark)


@pytest.fixture(scope="session")
def documents(llm):
    return [(r["doc_id"], r["text"], r["lang"]) for r in llm.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="session")
def odd(llm):
    """Nulls in every column, empty and very long texts, repeated rows, one id with two texts, clashing extra columns."""
    long = " ".join(f"w{i % 997} " for i in range(30_000))
    texts = [None, "", " \t\n", "one", "one two", "the same words again and again " * 8, "the same words again and again " * 8, long, "ünï çödé 日本語 😀 the\x0bend", "#$% & | 12 34"]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, "an id that is null", None, None, None), (3, "one", "en", None, 3), (3, "another text of the same id", "en", "s", 5), rows[5], rows[5]]
    return llm.createDataFrame([(*r, i, "x", 1.5, i) for i, r in enumerate(rows)], COLUMNS + ", row int, `_t` string, bits double, n_words int")


@pytest.fixture(scope="session")
def empty(llm):
    return llm.createDataFrame([], COLUMNS)
