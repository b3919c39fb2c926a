import pytest

from parlance.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", cpus=4)
