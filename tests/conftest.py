import pytest

from gridreach.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", "gridreach-tests")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
