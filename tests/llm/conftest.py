from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def spark():
    from quorate.session import local_session

    session = local_session("tests", "4", 4)
    yield session
    session.stop()
