import pathlib
import sys

import pytest

sys.path[:0] = [str(pathlib.Path(__file__).resolve().parents[1]), str(pathlib.Path(__file__).resolve().parent)]

from palimpsa.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "palimpsa-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def texts(spark):
    """Build a document frame from a list of texts, ids in order."""

    def build(values, **extra):
        names = list(extra)
        rows = [(i, v, *[extra[n][i] for n in names]) for i, v in enumerate(values)]
        schema = "doc_id long, text string" + "".join(f", {n} string" for n in names)
        return spark.createDataFrame(rows, schema)

    return build
