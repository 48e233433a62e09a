import pytest
from conftest import SF

from fleetlake.llm.common import session

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
# Null key and text, empty and blank texts, one very long text, ties and rows that are there twice; other columns bear names used inside.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it all again", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog and runs away from it all again", "en", "a"),
    (2, None, "en", None), (3, "", None, "a"), (4, " \t\n ", "de", "a"), (None, "no key here", "en", "a"), (5, LONG, "en", "b"),
    (6, "The quick brown fox jumps over the lazy dog and runs away from it all again", None, "b"), (7, "été ü 中文 🎉 ok", "fr", "b"), (8, "x", "de", "b"),
    (None, None, None, None),
]
CLASHING = "doc_id long, text string, lang string, source string, k string, chunk int, shelf int, part int, same string, component long, n int, registers string, score double, ids string, spans string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every defined special case, and columns with clashing names."""
    return session(spark).createDataFrame([(*r, "k", 1, 2, 3, "s", 4, 5, "r", 0.5, "i", "p") for r in ODD], CLASHING)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def texts(spark):
    """All documents of the smallest tables as (doc_id, text)."""
    rows = session(spark).read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r[0]: r[1] for r in rows}
