import os
import sys
from datetime import date, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kpiloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "4g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def trend_of(spark):
    """A trend table with one series of daily values."""

    def make(values, kpi="k", start=date(2024, 1, 1)):
        rows = [(kpi, i, start + timedelta(days=i), float(v)) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "kpi string, idx bigint, period date, value double")

    return make


def records(df):
    return [r.asDict(recursive=True) for r in df.collect()]
