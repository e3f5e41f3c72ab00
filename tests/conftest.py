import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from millrace.session import build_session

    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


def rows(df, *order):
    """Rows as tuples, in order of some columns or of all."""
    got = [tuple(r) for r in df.collect()]
    at = [df.columns.index(c) for c in order]
    return sorted(got, key=lambda r: [(r[i] is not None, r[i]) for i in at] if at else repr(r))
