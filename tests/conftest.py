from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from framescope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="*", shuffle_partitions=8, app="framescope-tests")
    yield s


def readings_pandas() -> pd.DataFrame:
    """Weather stations: 160 readings, 12 without rain, seven stored twice,
    a remark column that nobody filled."""
    i = np.arange(160)
    rain = (i * 53 % 97) / 3.0
    rain[40:160:10] = np.nan
    table = pd.DataFrame({
        "taken": pd.Timestamp("2023-03-05") + pd.to_timedelta(i * 36, unit="h"),
        "station": np.array(["north", "pier", "mill", "tower"])[(i * i + i // 7) % 4],
        "wind": 3 + (i * 37 % 101) / 4.0,
        "rain": rain,
        "remark": pd.Series([None] * 160, dtype="object"),
    })
    return pd.concat([table, table.iloc[20:27]], ignore_index=True)


def bodies_pandas() -> pd.DataFrame:
    """36 complete rows without repeats: two measures and a side."""
    i = np.arange(36)
    return pd.DataFrame({"height": 150 + (i * 17 % 41) * 1.25, "weight": 50 + (i * 29 % 53) * 0.75,
                         "side": np.where(i % 3 == 0, "left", "right")})


def to_spark(spark, pdf: pd.DataFrame, schema: str | None = None):
    return spark.createDataFrame(pdf, schema=schema) if schema else spark.createDataFrame(pdf)


@pytest.fixture
def readings_pdf():
    return readings_pandas()


@pytest.fixture
def readings_df(spark):
    return to_spark(spark, readings_pandas(), "taken timestamp, station string, wind double, rain double, remark string")


@pytest.fixture
def bodies_pdf():
    return bodies_pandas()


@pytest.fixture
def bodies_df(spark):
    return to_spark(spark, bodies_pandas())


@pytest.fixture
def correlated_df(spark):
    """y falls by half of x, with a small wave on it."""
    x = np.arange(80) * 1.5
    return spark.createDataFrame(pd.DataFrame({"x": x, "y": 90 - x / 2 + np.sin(x)}))


@pytest.fixture
def tiny_df(spark):
    return spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "a bigint, b string")
