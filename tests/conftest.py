import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from loupe.session import checkpoint_dir, get_session
    s = get_session(master="local[4]", shuffle_partitions=4)
    checkpoint_dir(s)
    yield s
