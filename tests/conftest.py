import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from factweave.session import build

    s = build("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g", "spark.log.level": "ERROR", "spark.sql.ansi.enabled": "true"})
    yield s
    s.stop()


@pytest.fixture
def scratch(spark):
    from factweave.session import Scratch

    return Scratch(spark, "test")
