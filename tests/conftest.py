import pytest


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import local_session

    return local_session(4, "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
