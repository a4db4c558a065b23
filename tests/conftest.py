from __future__ import annotations

import pytest

from marketloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=4, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session
