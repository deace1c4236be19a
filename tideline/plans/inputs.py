"""Market inputs derived from the shared star-schema tables.

    instruments   suppliers (monthly panel, grows with the data) and brands (weekly and daily panels)
    prices        quantity-weighted unit price of the period; volume = quantity; value = revenue
    market cap    revenue to date in cents, an exact integer
    industries    nations (suppliers), part types (brands)
    factors       part types, monthly unit price
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.plans.shared import kept
from tideline.sources.panel import pad_code, price_panel

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(col: str) -> Column:
    return F.round(F.col(col) * 100).cast("long")


def supplier_ticker(col: str) -> Column:
    return pad_code(F.col(col).cast("string"))


def brand_ticker(col: str = "p_brand") -> Column:
    return pad_code(F.regexp_extract(col, r"(\d+)$", 1))


def _cells(rows: DataFrame, *keys: str) -> DataFrame:
    agg = rows.groupBy(*keys).agg(F.sum("cents").alias("cents"), F.sum("qty").alias("volume"))
    return agg.select(*keys, (F.col("cents") / (F.col("volume") * 100.0)).alias("close"),
                      "volume", (F.col("cents") / 100.0).alias("value"))


@kept
def supplier_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_suppkey, base_date, cents, qty): lineitem summed once for supplier prices and caps."""
    return (table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.trunc("l_shipdate", "MM").alias("base_date"))
            .agg(F.sum(cents("l_extendedprice")).alias("cents"), F.sum("l_quantity").alias("qty")))


@kept
def supplier_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(supplier_months(spark, sf_dir).withColumn("ticker", supplier_ticker("l_suppkey")), "base_date", "ticker")


@kept
def supplier_goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_suppkey, p_type, p_name, l_returnflag, cents, max_cents): what a supplier sold; lineitem meets part once."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag",
                                                 cents("l_extendedprice").alias("cents"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    return (li.join(part, li.l_partkey == part.p_partkey).groupBy("l_suppkey", "p_type", "p_name", "l_returnflag")
            .agg(F.sum("cents").alias("cents"), F.max("cents").alias("max_cents")))


@kept
def supplier_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_suppkey, o_custkey, cents): who bought from whom; the one join of lineitem with orders."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", cents("l_extendedprice").alias("cents"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (li.join(o, li.l_orderkey == o.o_orderkey).groupBy("l_suppkey", "o_custkey")
            .agg(F.sum("cents").alias("cents")))


@kept
def brand_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, p_type, band, day, cents, qty): the one join of lineitem with part for brand prices.

    Rows are bounded by brands x types x size bands x days, however large lineitem is.
    """
    li = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("day"),
                                                 cents("l_extendedprice").alias("cents"), "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", brand_ticker().alias("ticker"),
                                               F.floor((F.col("p_size") - 1) / 10).alias("band"))
    return (li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("ticker", "p_type", "band", "day")
            .agg(F.sum("cents").alias("cents"), F.sum("l_quantity").alias("qty")))


@kept
def brand_week_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = brand_trades(spark, sf_dir)
    return _cells(t.withColumn("base_date", F.trunc("day", "week")), "base_date", "ticker")


@kept
def brand_day_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = brand_trades(spark, sf_dir)
    return _cells(t.withColumn("base_date", F.col("day")), "base_date", "ticker")


def supplier_panel(spark: SparkSession, sf_dir: str, n_days: int | None = None) -> DataFrame:
    return price_panel(supplier_cells(spark, sf_dir), n_days)


def brand_week_panel(spark: SparkSession, sf_dir: str, n_days: int | None = None) -> DataFrame:
    return price_panel(brand_week_cells(spark, sf_dir), n_days)


def brand_day_panel(spark: SparkSession, sf_dir: str, n_days: int | None = None) -> DataFrame:
    return price_panel(brand_day_cells(spark, sf_dir), n_days)


@kept
def supplier_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (supplier_months(spark, sf_dir).groupBy("l_suppkey").agg(F.sum("cents").alias("market_cap"))
            .select(supplier_ticker("l_suppkey").alias("ticker"), "market_cap"))


@kept
def supplier_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, name, market (region), sector (nation), market_cap."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(supplier_ticker("s_suppkey").alias("ticker"), F.col("s_name").alias("name"),
                    F.col("r_name").alias("market"), F.col("n_name").alias("sector"))
            .join(supplier_caps(spark, sf_dir), "ticker", "left"))


@kept
def brand_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = brand_trades(spark, sf_dir)
    return (t.groupBy("ticker").agg(F.sum("cents").alias("market_cap"))
            .select("ticker", F.concat(F.lit("Brand "), F.ltrim(F.col("ticker"), F.lit("0")))
                    .alias("name"), "market_cap"))


def supplier_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(industry, ticker): a supplier belongs to its nation."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    return (s.join(n, s.s_nationkey == n.n_nationkey)
            .select(F.col("n_name").alias("industry"),
                    supplier_ticker("s_suppkey").alias("ticker")))


@kept
def factor_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(base_date, factor, close): monthly unit price per part type."""
    t = brand_trades(spark, sf_dir)
    return _cells(t.select(F.trunc("day", "MM").alias("base_date"),
                           F.col("p_type").alias("factor"), "cents", "qty"),
                  "base_date", "factor").select("base_date", "factor", "close")


@kept
def nation_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(supplier_nation, customer_nation, cents): who sells to whom, summed once per pair."""
    sold = supplier_customers(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    keyed = (sold.join(c, sold.o_custkey == c.c_custkey).join(s, sold.l_suppkey == s.s_suppkey)
             .groupBy("s_nationkey", "c_nationkey").agg(F.sum("cents").alias("cents")))
    sn = n.select(F.col("n_nationkey").alias("sk"), F.col("n_name").alias("supplier_nation"))
    cn = n.select(F.col("n_nationkey").alias("ck"), F.col("n_name").alias("customer_nation"))
    return (keyed.join(sn, F.col("s_nationkey") == F.col("sk"))
            .join(cn, F.col("c_nationkey") == F.col("ck"))
            .select("supplier_nation", "customer_nation", "cents"))
