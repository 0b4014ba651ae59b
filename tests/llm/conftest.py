"""A table of awkward documents, shared by the tests of all operators."""

import pytest
from odd_rows import EXTRA, ODD


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, *[i] * len(EXTRA)) for i, r in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{c}` int" for c in EXTRA))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("1 = 0")
