import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from glyphmill.session import build_session

    folder = str(tmp_path_factory.mktemp("shared"))
    session = build_session("tests", cores=4, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.driver.memory": "6g"})
    session.sparkContext.setCheckpointDir(folder)
    yield session
    session.stop()
