import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lanecost.session import session_builder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        session_builder("tests").master("local[4]").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lanecost-tests-")).getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
