import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from samples import FILMS  # noqa: E402

from findrift import schemas, session  # noqa: E402
from findrift.operators.index import build_index  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build_session(
        "local[8]",
        spark_sql_shuffle_partitions="4",
        spark_driver_memory="6g",
        spark_ui_showConsoleProgress="false",
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def films(spark):
    return spark.createDataFrame(FILMS, schemas.CATALOG)


@pytest.fixture(scope="session")
def index(films):
    return build_index(films, session.workspace(films.sparkSession, "test-index"), 3)


@pytest.fixture(scope="session")
def ask(spark):
    """A query table from strings; query_id is the place in the list."""

    def table(*texts):
        return spark.createDataFrame(list(enumerate(texts)), "query_id BIGINT, query STRING")

    return table
