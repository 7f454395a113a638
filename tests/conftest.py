import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
DATA = os.environ.get("LODESTAR_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodestar.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session(
        4,
        "tests",
        **{
            "spark.driver.memory": "3g",
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": f"file://{shared}/checkpoints",
            "spark.sql.warehouse.dir": f"{shared}/warehouse",
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
