import pytest

from lexiscore.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "lexiscore-tests",
        master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
