import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from tideline.operators.order_stats import exact_median, in_order, largest, with_pct_rank


def data(spark, seed, scale):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=400) * scale, 2)
    pdf = pd.DataFrame({"id": range(400), "k": rng.choice(["a", "b", "c"], 400, p=[.6, .3, .1]), "v": v})
    pdf.loc[rng.choice(400, 40, replace=False), "v"] = None
    pdf.loc[:130, "v"] = 0.25      # a third of all rows share one value
    rows = [(int(i), k, None if pd.isna(x) else float(x)) for i, k, x in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, "id long, k string, v double")


def test_pct_rank_equals_average_rank(spark):
    for seed, scale in ((1, 1.0), (2, 500.0)):
        pdf, df = data(spark, seed, scale)
        got = with_pct_rank(df, "v", "p").toPandas().set_index("id")["p"].sort_index()
        want = pdf["v"].rank(pct=True)
        assert np.allclose(got.astype(float), want, equal_nan=True)


def test_exact_median_per_key(spark):
    pdf, df = data(spark, 3, 2.0)
    got = {r["k"]: r["median"] for r in exact_median(df, ["k"], "v").collect()}
    want = pdf.groupby("k")["v"].median()
    assert got.keys() == set(want.index) and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_largest_share_with_ties_on_the_cut(spark):
    pdf, df = data(spark, 4, 0.2)
    got = sorted(r["id"] for r in largest(df, "v", 4, ["id"]).collect())
    seen = pdf.dropna(subset=["v"]).sort_values(["v", "id"], ascending=[False, True])
    assert got == sorted(seen["id"].head(max(1, len(seen) // 4)))


def test_medians_of_rows_with_several_keys(spark):
    pdf, df = data(spark, 6, 1.0)
    both = lambda rows: rows.withColumn("g", F.explode(F.array(F.lit("all"), F.col("k"), F.lit(None).cast("string"))))
    got = {r["g"]: r["median"] for r in exact_median(df, ["g"], "v", each=both).collect()}
    whole = pdf["v"].median()
    assert got == {"all": whole, None: whole} | dict(pdf.groupby("k")["v"].median())


def test_narrow_values_and_ties_fill_all_partitions_alike(spark):
    """Values in 0.02, near 1, or equal in a third of the rows: no partition holds a few times the mean."""
    rng, parts = np.random.default_rng(9), int(spark.conf.get("spark.sql.shuffle.partitions"))
    for values in (rng.uniform(-0.02, 0.02, 8000), rng.uniform(0.97, 1.0, 8000), np.where(rng.random(8000) < 0.34, 0.5, rng.normal(size=8000)), np.zeros(8000)):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, v double")
        sizes = [r["n"] for r in in_order(df, F.col("v"), F.xxhash64("id", "v")).groupBy("_pid").agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == parts and max(sizes) < 1.5 * 8000 / parts
        got = with_pct_rank(df, "v", "p").toPandas().set_index("id")["p"].sort_index()
        assert np.allclose(got, pd.Series(values).rank(pct=True))


def test_ranks_of_empty_and_missing(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, v double")
    assert [r["p"] for r in with_pct_rank(df, "v", "p").collect()] == [None, None]
    assert with_pct_rank(df.limit(0), "v", "p").count() == largest(df, "v", 4, ["id"]).count() == exact_median(df, ["id"], "v").count() == 0
