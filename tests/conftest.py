import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from heredium.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("4", 4, "4g", str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()


@pytest.fixture()
def rows():
    return lambda df, *cols: sorted(tuple(r[c] for c in cols) for r in df.collect())
