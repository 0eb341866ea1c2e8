import tempfile

import pytest

from querylode.session import local_session


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="querylode-tests-")
    session = local_session(8, "tests", **{"spark.checkpoint.dir": f"file://{folder}/checkpoints", "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.driver.memory": "6g"})
    yield session
    session.stop()
