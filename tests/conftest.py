import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from siltstream.session import local_session, ship_package

    session = local_session(4, 4, **{"spark.driver.memory": "4g", "spark.sql.streaming.metricsEnabled": "false"})
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    """The smallest of the driver's tables, where they are there."""
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test tables here")
    return folder
