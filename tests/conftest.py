import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from trackloom.session import local

    session = local(8, partitions=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    from compare import open_tables

    return open_tables(SF)


@pytest.fixture(scope="session")
def sf_dir():
    return SF
