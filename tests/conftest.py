import pytest

from tests.session import make_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return make_session()


@pytest.fixture(scope="session")
def warehouse(spark):
    from shipsight.sources.fact import Warehouse

    return Warehouse(spark, SF)
