import os
import sys
import tempfile

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark():
    """A session whose workers can't import the package: they start in another folder, without a path to it."""
    from tidewright.session import session

    home, path = os.getcwd(), os.environ.pop("PYTHONPATH", None)
    os.chdir(tempfile.mkdtemp(prefix="spark-"))
    try:
        s = session("local[4]", 4)
    finally:
        os.chdir(home)
        if path is not None:
            os.environ["PYTHONPATH"] = path
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
