import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": f"file://{shared}/checkpoints", "spark.sql.warehouse.dir": f"file://{shared}/warehouse", "spark.executorEnv.PYTHONPATH": str(ROOT),
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.addPyFile(_zipped(shared))
    yield session
    session.stop()


def _zipped(folder):
    """The package for the workers, who may start elsewhere."""
    import shutil

    return shutil.make_archive(str(folder / "package"), "zip", ROOT, "tallygrove")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
