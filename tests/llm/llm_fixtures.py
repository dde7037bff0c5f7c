import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (id, text) pairs, with columns whose names operators use inside."""

    def build(*rows):
        wide = [(i, text, None, "s", None if text is None else len(text), 7, "x") for i, text in rows]
        return spark.createDataFrame(wide, DOCS + ", id int, digest string")

    return build


@pytest.fixture(scope="session")
def prose():
    """Distinct sentences of a given number of words, by a rule."""

    def build(seed, words=60):
        state, out = seed * 7919 + 17, []
        for _ in range(words):
            state = (state * 1103515245 + 12345) % (1 << 31)
            out.append("w" + format(state >> 8, "x"))
        return " ".join(out)

    return build
