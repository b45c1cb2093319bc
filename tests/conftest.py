import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from tallyforge.session import local_session

    s = local_session(4, "tests", memory="2g", partitions=4)
    yield s
    s.stop()


@pytest.fixture
def rows():
    """The rows of a frame as a sorted list of tuples, nulls first."""

    def of(df, *cols):
        out = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
        return sorted(out, key=lambda t: tuple((x is not None, str(type(x)), x) if not isinstance(x, (list, dict)) else (True, "", str(x)) for x in t))

    return of
