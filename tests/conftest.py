import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))


@pytest.fixture(scope="session")
def spark():
    from check import session

    from flowspark.session import prepare

    s = session(4)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield prepare(s)
    s.stop()


def rows(df, *order):
    """Rows as tuples, sorted."""
    out = [tuple(r) for r in df.select(*(order or df.columns)).collect()]
    return sorted(out, key=lambda t: tuple((v is None, v) for v in t))
