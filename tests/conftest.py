import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def same_rows(a, b) -> None:
    """Two pandas frames with the same rows in any order."""
    import pandas as pd

    assert set(a.columns) == set(b.columns)
    columns = sorted(a.columns)

    def plain(d):
        rows = [tuple(None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v for v in r) for r in d[columns].astype(object).itertuples(index=False)]
        return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in r))

    assert isinstance(a, pd.DataFrame)
    assert plain(a) == plain(b)
