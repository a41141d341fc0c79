import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from srcatlas.session import session

    made = session(
        "tests",
        "local[4]",
        **{"spark_sql_shuffle_partitions": "4", "spark_ui_enabled": "false", "spark_ui_showConsoleProgress": "false", "spark_driver_memory": "4g", "spark_sql_adaptive_coalescePartitions_enabled": "true"},
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def sf_dir():
    found = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(found):
        pytest.skip("no test tables")
    return found
