import pytest

from lexloom.session import session


@pytest.fixture(scope="session")
def spark():
    out = session("local[2]", 4, **{"spark.driver.memory": "3g"})
    out.sparkContext.setLogLevel("ERROR")
    return out
