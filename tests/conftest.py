import pytest

from tidemark.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, app="tidemark-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from tidemark.plans.registry import Tables

    return Tables(spark, SMALL)
