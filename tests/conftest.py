import pytest

from corpusloom.session import session


@pytest.fixture(scope="session")
def spark():
    found = session("local[4]", 4)
    found.sparkContext.setLogLevel("ERROR")
    return found


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
