import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from corvane.session import session

    out = session(**{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                     "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()
