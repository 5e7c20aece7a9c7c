import os
import tempfile

import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def spark():
    from voxelweave.session import get_spark

    folder = tempfile.mkdtemp(prefix="voxelweave-tests-")
    s = get_spark("local[4]", 4, **{"spark.ui.enabled": "false", "spark.checkpoint.dir": folder, "spark.driver.memory": "4g", "spark.sql.warehouse.dir": f"{folder}/warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
