from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for place in (str(ROOT), str(ROOT / "tests")):
    if place not in sys.path:
        sys.path.insert(0, place)


@pytest.fixture(scope="session")
def spark():
    from tablemirror.session import build_session

    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-checkpoint-"),
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-warehouse-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
