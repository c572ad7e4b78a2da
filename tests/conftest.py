import pytest

from termforge.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    return session
