from __future__ import annotations

import pytest
from months import month

from brickline.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture
def panel_of(spark):
    """Series rows ``city, target, ds, y`` from lists of values; None leaves the month out."""

    def build(**series):
        rows = [
            (city, "price", month(i), float(v)) for city, values in series.items() for i, v in enumerate(values) if v is not None
        ]
        return spark.createDataFrame(rows, "city string, target string, ds date, y double")

    return build
