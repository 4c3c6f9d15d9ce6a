import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from terrasift.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build("tests", f"local[{os.environ.get("TEST_CPUS", "8")}]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    s.sparkContext.setLogLevel("ERROR")
    return s
