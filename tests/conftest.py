import pytest

from corpuslab.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", 8, scratch=str(tmp_path_factory.mktemp("stored")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
