import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from lifetrail import get_session
    scratch = tempfile.mkdtemp(prefix="lifetrail-test-session-")
    os.mkdir(f"{scratch}/events")
    s = get_session("lifetrail-tests", cores="*", shuffle_partitions=8,
                    extra={"spark.sql.warehouse.dir": f"{scratch}/warehouse",
                           "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file:{scratch}/events",
                           "spark.eventLog.rolling.enabled": "false", "spark.eventLog.compress": "false",
                           "spark.driver.extraJavaOptions": f"-Dderby.stream.error.file={scratch}/derby.log"})
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lifetrail-test-ckpt-"))
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="lifetrail-test-")
