import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from quarryline.session import local_session

    session = local_session("4", 2)
    session.conf.set("spark.sql.codegen.wholeStage", "false")  # small data: compiling would take longer than running
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    """A folder with the smallest test tables; tests that need it are left out where it is missing."""
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables here")
    return str(folder)
