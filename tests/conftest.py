import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tsubo.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, 4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture
def rows(spark):
    """Collect a frame as a sorted list of tuples."""
    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return collect


@pytest.fixture
def apply(spark):
    """Values of a column function over inline one-column or many-column rows."""
    def run(function, inputs, kind="string"):
        from pyspark.sql import functions as F

        many = isinstance(inputs[0], tuple)
        width = len(inputs[0]) if many else 1
        names = [f"c{i}" for i in range(width)]
        schema = ", ".join(f"{n} {kind}" for n in ["i int", *names][1:])
        data = [(i, *(x if many else (x,))) for i, x in enumerate(inputs)]
        df = spark.createDataFrame(data, f"i int, {schema}").coalesce(1)
        out = df.select("i", function(*[F.col(n) for n in names]).alias("v")).orderBy("i")
        return [r.v for r in out.collect()]

    return run
