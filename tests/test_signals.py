import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.operators import market as M
from tideline.operators import signals as sig
from tideline.sources import panel as P


def random_walks(days=130, n=12, seed=0, holes=0.01):
    rng = np.random.default_rng(seed)
    close = 1000 * np.exp(np.cumsum(rng.normal(0, 0.03, (days, n)), axis=0))
    close[rng.random((days, n)) < holes] = np.nan
    close[:80, 0] = np.nan              # listed too recently
    close[-1, 1] = np.nan               # halted today
    close[-21, 2] = np.nan              # no price 20 days ago
    return close, rng.integers(1, 500, (days, n)).astype(float)


def test_signals_match_a_restatement_on_the_dense_grid(make_panel):
    close, vol = random_walks()
    got = sig.compute_signals(make_panel(close, vol)).toPandas().set_index("ticker").sort_index()
    c = pd.DataFrame(close, columns=[f"{i:06d}" for i in range(close.shape[1])])
    v = pd.DataFrame(np.where(np.isnan(close), np.nan, vol), columns=c.columns)
    c, v = c.loc[:, c.notna().sum() >= 60], v.loc[:, c.notna().sum() >= 60]
    ma20, ma60 = c.rolling(20).mean(), c.rolling(60).mean()
    up = ma20 > ma60
    want = pd.DataFrame({
        "ret5": c.iloc[-1] / c.iloc[-6] - 1, "ret20": c.iloc[-1] / c.iloc[-21] - 1,
        "ret60": c.iloc[-1] / c.iloc[-61] - 1, "golden_cross": up.iloc[-1] & ~up.iloc[-8],
        "slope_turn": (ma60.iloc[-1] > ma60.iloc[-11]) & (ma60.iloc[-31] < ma60.iloc[-41]),
        "vol_surge": v.iloc[-5:].mean() / v.iloc[-25:-5].mean(),
        "high_proximity": c.iloc[-1] / c.iloc[-120:].max()}).dropna(subset=["ret20", "high_proximity"])
    assert list(got.index) == list(want.index) and "000001" not in got.index
    for col in want:
        assert np.allclose(got[col].astype(float), want[col].astype(float), equal_nan=True), col


def test_too_short_a_panel_is_an_error(make_panel):
    with pytest.raises(Exception, match="at least 21 trading days"):
        sig.compute_signals(make_panel(np.full((20, 2), 100.0))).collect()


def test_trigger_priority_and_flat_series(spark):
    rows = [("m", 0.2, 0.5, True, True, 9.0), ("t", 0.0, 0.5, True, False, 3.0), ("f", 0.0, 0.5, False, False, 9.0),
            ("n", 0.0, 0.5, True, False, None)]
    df = spark.createDataFrame(rows, "ticker string, ret20 double, high_proximity double, golden_cross boolean, "
                                     "slope_turn boolean, vol_surge double")
    got = {r["ticker"]: r["trigger"] for r in sig.with_trigger(df, S.ScreenSettings()).collect()}
    assert got == {"m": S.TRIGGER_MOMENTUM, "t": S.TRIGGER_TURNAROUND, "f": None, "n": None}


def test_missing_caps_stop_the_run(spark):
    m = spark.createDataFrame([("a", None)], "ticker string, market_cap long")
    with pytest.raises(ValueError, match="no market cap"):
        sig.require_caps(m)


def test_market_return_weights_and_fallback(spark):
    rets = spark.createDataFrame([("a", 1, 0.1), ("b", 1, -0.1), ("a", 2, None), ("b", 2, 0.3)],
                                 "ticker string, dt_idx int, ret double")
    caps = lambda a, b: spark.createDataFrame([("a", a), ("b", b)], "ticker string, market_cap long")
    pick = lambda df: {r["dt_idx"]: r["ret"] for r in df.collect()}
    assert pick(M.market_return(rets, caps(3, 1))) == pytest.approx({1: 0.05, 2: 0.3})
    assert pick(M.market_return(rets, caps(0, None))) == pytest.approx({1: 0.0, 2: 0.3})
    assert pick(M.market_return(rets, caps(1, 0)))[2] is None


def test_halted_days_are_missing_unless_padded(make_panel):
    close = np.array([[10.0], [np.nan], [12.0]])
    panel = make_panel(np.hstack([close, [[1.0], [1.0], [1.0]]]))
    rets = {r["dt_idx"]: r["ret"] for r in sig.with_daily_return(panel).where("ticker = '000000'").collect()}
    assert rets == {0: None, 2: None}
    padded = {r["dt_idx"]: r["ret"] for r in M.padded_returns(panel).where("ticker = '000000'").collect()}
    assert padded[1] == 0.0 and padded[2] == pytest.approx(0.2)


def test_code_rules(spark):
    raw = [("5930", "005930"), ("KR7005930003", "005930"), (" 00680k ", "00680K"), ("1234567", "1234567")]
    df = spark.createDataFrame(raw, "raw string, want string")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", P.normalize_ticker(F.col("raw"))).collect())
    shape = spark.createDataFrame([("5930",), ("XX0",), ("00680K",)], "raw string").select(
        P.looks_like_code(F.col("raw")).alias("ok"))
    assert [r["ok"] for r in shape.collect()] == [True, False, True]
    with pytest.raises(P.SourceError, match="unexpected shape"):
        P.gate_codes(spark.createDataFrame([("XX0",), ("005930",)], "raw string"), "raw")
    with pytest.raises(P.SourceError, match="columns present"):
        P.resolve_fields(df, {"close": ["TDD_CLSPRC"]})


def test_turnover_is_the_exact_mean(make_panel):
    """Amounts in cents whose mean is 51978 exactly, though their doubles sum to less in either direction."""
    cents = [5615379, 1079282, 449797, 4872763, 1418594, 106757, 8530861, 3060432, 4254754, 4620027,
             7354291, 6215525, 9496720, 4597757, 9206254, 1404412, 9766394, 6942585, 8320995, 6642421]
    panel = make_panel(np.arange(1.0, 131)[:, None])
    value = F.get(F.array(*[F.lit(x) for x in cents]), F.col("age").cast("int")) / 100.0
    got = sig.compute_signals(panel.withColumn("value", value)).select(F.floor("avg_turnover")).first()
    assert got[0] == sum(cents) // 2000 == 51978


def test_universe_sql_states_order_and_exact_floor():
    from oracles import all_sql
    sql = all_sql()["t2_universe_by_cap"]
    assert "ORDER BY market_cap DESC, ticker" in sql and "floor(round(avg_turnover, 6))" in sql
