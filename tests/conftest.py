import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from siftwork.plans.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests")


def rows(df, *cols):
    """Rows as sorted tuples."""
    out = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in out.collect()), key=lambda t: tuple((x is not None, str(x)) for x in t))
