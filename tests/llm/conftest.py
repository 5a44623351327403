import os

import pytest

FOLDER = os.environ.get("LOOMLINE_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def folder():
    """The smallest test data; tests that need it are skipped where it is missing."""
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    return FOLDER
