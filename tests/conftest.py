from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from compare import session

    s = session(8)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
