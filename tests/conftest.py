import os
import sys
from datetime import datetime

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from tillroll.plans.session import build_session  # noqa: E402
from tillroll.sources.seed import seed_tables  # noqa: E402

T0 = datetime(2026, 3, 28)


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", app_name="tillroll-tests", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def seed(spark):
    return seed_tables(spark, T0)


def rows(df, *cols):
    """Collected rows as plain tuples (optionally only some columns)."""
    if cols:
        df = df.select(*cols)
    return [tuple(r) for r in df.collect()]
