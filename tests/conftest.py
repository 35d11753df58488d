import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.oracle import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session(8)
    yield spark
    spark.stop()


@pytest.fixture
def rows(spark):
    """300 rows: id, x, a noisy y, and heavily tied t."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    pdf = pd.DataFrame({"id": np.arange(300) * 3 + 1, "x": x, "y": 2 * x + rng.normal(size=300), "t": rng.integers(0, 4, 300).astype(float)})
    return spark.createDataFrame(pdf)
