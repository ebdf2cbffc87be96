import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from civitally.session import local_session

    root = tmp_path_factory.mktemp("layers")
    session = local_session(
        4,
        "tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(root)},
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"
