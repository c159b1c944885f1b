import os

import pytest

from binledger.session import local_session
from binledger.sources.seed import seed_tables
from binledger.sources.testdata import DerivedTables

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def seeded(spark):
    return {name: df.coalesce(1).cache() for name, df in seed_tables(spark).items()}


@pytest.fixture(scope="session")
def derived(spark):
    return DerivedTables(spark, SF_DIR)


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
