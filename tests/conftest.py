import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bibspan.fixtures.views import Inputs  # noqa: E402
from bibspan.plans.datasets import Datasets  # noqa: E402
from bibspan.session import configured  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configured(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def data(spark, sf_dir):
    """All datasets of the smallest scale, each made once for the whole session."""
    return Datasets(spark, Inputs(spark, sf_dir))


@pytest.fixture
def no_auto_broadcast(spark):
    """Joins as they are when no side is small."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def rows(df):
    """The rows in an order of their own, for comparing results."""
    return sorted((tuple(row) for row in df.select(*sorted(df.columns)).collect()), key=repr)


def plan(df):
    """Text of the executed plan."""
    import contextlib
    import io

    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("simple")
    return text.getvalue()
