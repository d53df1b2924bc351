import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from codexmill.session import local_session, ship_package

    s = local_session("4", 4, **{"spark.driver.memory": "4g", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4"})
    ship_package(s)
    yield s
    s.stop()
