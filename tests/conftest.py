import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from corpusctx.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        4,
        "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Build a DataFrame from rows and a DDL schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def values(spark):
    """Apply a column function to a list of values of one column ``v`` and return the results in order."""

    def run(data, function, kind="string"):
        df = spark.createDataFrame(list(enumerate(data)), f"i int, v {kind}")
        return [r[1] for r in df.select("i", function("v").alias("o")).orderBy("i").collect()]

    return run
