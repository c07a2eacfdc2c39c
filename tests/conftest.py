import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from lodestar.session import local_session

    s = local_session(cores=4, warehouse=str(tmp_path_factory.mktemp("warehouse")), checkpoints=str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()
