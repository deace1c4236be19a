import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.operators import factors as X
from tideline.operators import groups as G
from tideline.operators import signals as sig

DAYS, SEED = 130, 7


@pytest.fixture(scope="module")
def world(spark, make_panel):
    """Market, one factor, two opposite exposures, a lagging group member and a halted one."""
    rng = np.random.default_rng(SEED)
    mkt, fac, grp = (rng.normal(0, s, DAYS) for s in (0.01, 0.02, 0.02))
    grp[-5:] += 0.03
    noise = lambda: rng.normal(0, 0.004, DAYS)
    rets = np.column_stack([mkt + 1.2 * fac + noise(), 0.8 * mkt - 0.9 * fac + noise(), mkt + grp + noise(),
                            mkt + 1.1 * grp + noise(), mkt + grp + noise(), mkt + grp + noise(), mkt + noise()])
    rets[-5:, 4] = mkt[-5:]             # ticker 4 has not reacted
    close = 100 * np.cumprod(1 + rets, axis=0)
    close[-6:, 5] = np.nan              # ticker 5 is halted
    close[10, 2] = np.nan
    panel = make_panel(close)
    r = sig.with_daily_return(panel).select("ticker", "dt_idx", "age", "n_days", "ret")
    cal = panel.select("base_date", "dt_idx", "age", "n_days").distinct()
    market = spark.createDataFrame([(i, float(mkt[i])) for i in range(1, DAYS)], "dt_idx int, ret double")
    fclose = 50 * np.cumprod(1 + fac)
    base = [row["base_date"] for row in cal.orderBy("dt_idx").collect()]
    fpanel = spark.createDataFrame([(base[i], "copper", float(fclose[i])) for i in range(DAYS)],
                                   "base_date date, factor string, close double")
    return dict(close=close, r=r, cal=cal, market=market, fpanel=fpanel, mkt=mkt)


def returns_of(close):
    return close[1:] / close[:-1] - 1


def slope(x, y):
    x = x - x.mean()
    return float(x @ (y - y.mean()) / (x @ x))


def test_exposures_equal_two_step_regression(world):
    window = X.market_window(world["cal"], world["market"], 120)
    f = X.factor_returns(world["fpanel"], world["cal"])
    cfg = S.HorizontalSettings(min_abs_corr=0.0)
    got = {r["ticker"]: r for r in X.exposures(world["r"], f, window, X.market_betas(world["r"], window), cfg).collect()}
    fr = (world["fpanel"].orderBy("base_date").toPandas()["close"].pct_change().to_numpy())[-120:]
    m, y = world["mkt"][-120:], returns_of(world["close"])[-120:]
    e = fr - slope(m, fr) * m
    for j in range(7):
        yj = np.nan_to_num(y[:, j])
        if np.isnan(y[:, j]).mean() > 0.2:
            continue
        resid = yj - slope(m, yj) * m
        row = got[f"{j:06d}"]
        assert row["beta"] == pytest.approx(slope(e, resid), rel=1e-8)
        assert row["corr"] == pytest.approx(np.corrcoef(e, resid)[0, 1], rel=1e-8)
    assert got["000000"]["beta"] > 0.9 and got["000001"]["beta"] < -0.7


def test_market_that_does_not_align_gives_nothing(spark, world):
    off = spark.createDataFrame([(i + 10_000, 0.01) for i in range(DAYS)], "dt_idx int, ret double")
    assert X.market_window(world["cal"], off, 120).count() == 0
    mean = X.gap_market(world["r"], off, world["cal"])
    assert mean.where("ret is null").count() <= 1


def test_gap_finds_the_laggard_and_skips_the_halted(spark, world):
    members = spark.createDataFrame([("g", f"{j:06d}") for j in range(2, 6)], "grp string, ticker string")
    gret = G.group_returns(world["r"], members)
    gaps = X.group_gaps(world["r"], members, gret, world["market"], world["cal"])
    rows = {r["ticker"]: r for r in gaps.collect()}
    assert "000005" not in rows
    assert max(rows, key=lambda t: rows[t]["gap"]) == "000004" and rows["000004"]["gap"] > 0.05
    best = {r["ticker"]: r["grp"] for r in X.best_gap(gaps).collect()}
    assert best["000004"] == "g"


def test_group_day_needs_three_observations(spark):
    r = spark.createDataFrame([("a", 1, 0, 5, 0.1), ("b", 1, 0, 5, 0.2), ("c", 1, 0, 5, 0.3), ("a", 2, 0, 5, 0.1),
                               ("b", 2, 0, 5, None), ("c", 2, 0, 5, 0.1)],
                              "ticker string, dt_idx int, age int, n_days int, ret double")
    m = spark.createDataFrame([("g", t) for t in "abc"], "grp string, ticker string")
    assert [(x["dt_idx"], round(x["ret"], 6)) for x in G.group_returns(r, m).collect()] == [(1, 0.2)]


def test_flat_ticker_has_no_correlation_and_flat_series_no_rows(spark):
    r = spark.createDataFrame([("flat", i, 0.0) for i in range(10)], "ticker string, dt_idx int, ret double")
    moving = spark.createDataFrame([(i, float(i % 3)) for i in range(10)], "dt_idx int, x double")
    still = moving.withColumn("x", F.lit(1.0))
    row = X.beta_corr(r, moving).first()
    assert row["beta"] == 0.0 and row["corr"] is None
    assert X.beta_corr(r, still).count() == 0


def test_constant_series_have_no_correlation(spark):
    """Rounding residue of sums is no variance: constants of many sizes give NULL, not a number near 0."""
    rows = [(f"t{k}", d, 0.001 * (k + 1) / 3) for k in range(59) for d in range(60)]
    rets = spark.createDataFrame(rows, "ticker string, dt_idx int, ret double")
    x = spark.createDataFrame([(d, ((d * 7) % 11) / 100.0) for d in range(60)], "dt_idx int, x double")
    got = X.beta_corr(rets, x).collect()
    assert len(got) == 59 and all(r["corr"] is None for r in got)
