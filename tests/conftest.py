import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from terrane.session import local_session

    session = local_session(2, "tests", "3g")
    session.conf.set("spark.sql.shuffle.partitions", "3")
    yield session
    session.stop()
