import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fieldsense.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[*]", shuffle_partitions=8, extra={"spark.driver.memory": "6g"})
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fieldsense-test-"))
    yield s
