import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tideline.runtime import local_session
    s = local_session("tests", cpus="8", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_panel(spark):
    """Wide numpy array (days x tickers, NaN = not traded) -> panel rows."""
    import datetime as dt
    import math

    from tideline.sources.panel import price_panel

    def build(close, volume=None, tickers=None):
        days, n = close.shape
        tickers = tickers or [f"{i:06d}" for i in range(n)]
        start = dt.date(2020, 1, 1)
        rows = [(start + dt.timedelta(days=d), tickers[j], float(close[d, j]),
                 float(volume[d, j]) if volume is not None else 1.0, float(close[d, j]) * 10)
                for d in range(days) for j in range(n) if not math.isnan(close[d, j])]
        df = spark.createDataFrame(rows, "base_date date, ticker string, close double, volume double, value double")
        return price_panel(df)
    return build
