import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from gleanery.session import make_session

    session = make_session("local[4]", 4, spark__driver__memory="3g")
    yield session
    session.stop()
