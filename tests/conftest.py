import pytest

from driftledger.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[2]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
