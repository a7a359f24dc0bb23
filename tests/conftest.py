import pytest

from checks.compare import session


@pytest.fixture(scope="session")
def spark():
    return session(4, "6g")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
