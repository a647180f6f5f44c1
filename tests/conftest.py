import pytest

from tests.session import spark_session


@pytest.fixture(scope="session")
def spark():
    return spark_session()
