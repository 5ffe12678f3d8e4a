import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from priorform.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    stages = str(tmp_path_factory.mktemp("stages"))
    session = local_session(4, app="tests", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=stages)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
