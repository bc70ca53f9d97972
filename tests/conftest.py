import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session, ship

    session = local_session(cores=8, shuffle_partitions=4, memory="6g")
    ship(session)
    yield session
    session.stop()
