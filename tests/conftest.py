import os
import sys

import pytest

for path in (os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))):
    if path not in sys.path:
        sys.path.insert(0, path)


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_session

    s = get_session("local[4]", app="tessera-tests", shuffle_partitions=4)
    yield s


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]
