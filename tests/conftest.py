import datetime as dt

import pytest

from tests.oracle import connect, session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session()
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    return connect(SF)


def month(i: int) -> dt.date:
    """The i-th month from January 2020."""
    return dt.date(2020 + i // 12, i % 12 + 1, 1)


@pytest.fixture(scope="session")
def make_panel(spark):
    """Monthly panel from {series: values}."""

    def make(series: dict):
        rows = [(s, month(i), float(v)) for s, values in series.items() for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "s string, period date, qty double")

    return make
