import pytest

from siren.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("8")
