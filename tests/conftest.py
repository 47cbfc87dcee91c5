import pytest

from korpora.session import session


@pytest.fixture(scope="session")
def spark():
    return session(cpus="4", partitions=4)
