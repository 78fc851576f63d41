import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from siltstone.session import local_session

    session = local_session(4, shuffle_partitions=4, app="siltstone-tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}") if not session.conf.get("spark.checkpoint.dir", None) else None
    return session
