import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from millrace import plans, session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session_ = session.build(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    session_.sparkContext.setLogLevel("ERROR")
    yield session.tune(session_)
    session_.stop()


@pytest.fixture(scope="session", autouse=True)
def registered():
    plans.load_all()
