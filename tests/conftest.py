from datetime import datetime, timedelta

import pytest

from symweave.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def at():
    """A moment: so many hours after a fixed one."""
    return lambda hours: datetime(2026, 3, 1) + timedelta(hours=hours)
