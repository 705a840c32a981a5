import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallyframe.session import session

    home = tmp_path_factory.mktemp("spark")
    s = session(
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
            "spark.sql.warehouse.dir": str(home / "warehouse"), "spark.checkpoint.dir": str(home / "checkpoints"),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
