"""Groups of tickers that share a theme, a basket or an industry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.functions import nodes as N
from tideline.functions.numbers import positive_or_zero, ratio


def group_catalog(listing: DataFrame, min_theme: int = 3, min_basket: int = 5,
                  max_basket: int = 80) -> DataFrame:
    """(grp, ticker) out of listing(kind, name, ticker).

    Only plain six-digit codes count as members. Themes need ``min_theme`` members; baskets need
    between ``min_basket`` and ``max_basket`` and a name that does not mark them as broad.
    """
    plain = listing.where(F.col("ticker").rlike(S.BASKET_MEMBER_CODE)).distinct()
    is_theme = F.col("kind") == "theme"
    plain = plain.where(is_theme | ~F.col("name").rlike(S.BROAD_BASKET_NAME))
    sizes = plain.groupBy("kind", "name").agg(F.count("*").alias("n"))
    kept = sizes.where((is_theme & (F.col("n") >= min_theme))
                       | (~is_theme & F.col("n").between(min_basket, max_basket)))
    prefix = F.when(is_theme, S.THEME_GROUP_PREFIX).otherwise(S.BASKET_GROUP_PREFIX)
    return (plain.join(kept.select("kind", "name"), ["kind", "name"], "left_semi")
            .select(F.concat(prefix, F.col("name")).alias("grp"), "ticker"))


def industry_groups(edges: DataFrame, min_members: int = 3) -> DataFrame:
    """Industries as groups: only ticker -> industry membership edges, each member once."""
    member = edges.where((F.col("rel") == S.REL_MEMBER)
                         & (N.node_kind(F.col("src")) == "T") & (N.node_kind(F.col("dst")) == "I"))
    pairs = member.select(F.concat(F.lit(S.INDUSTRY_GROUP_PREFIX), N.node_value(F.col("dst")))
                          .alias("grp"), N.node_value(F.col("src")).alias("ticker")).distinct()
    return keep_large(pairs, min_members)


def keep_large(members: DataFrame, min_members: int = 3) -> DataFrame:
    big = members.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") >= min_members)
    return members.join(big.select("grp"), "grp", "left_semi")


def union_groups(*member_sets: DataFrame, universe: DataFrame | None = None,
                 min_members: int = 3) -> DataFrame:
    """All groups, cut to the universe; the size rule is applied again after the cut."""
    out = member_sets[0]
    for m in member_sets[1:]:
        out = out.unionByName(m)
    out = out.distinct()
    if universe is None:
        return out
    return keep_large(out.join(universe.select("ticker"), "ticker", "left_semi"), min_members)


def inverse_membership(members: DataFrame) -> DataFrame:
    """ticker -> its groups. A ticker belongs to few groups, so the list stays short."""
    return members.groupBy("ticker").agg(F.sort_array(F.collect_set("grp")).alias("groups"))


def group_returns(rets: DataFrame, members: DataFrame, min_members: int = 3) -> DataFrame:
    """(grp, dt_idx, age, n_days, ret): equal-weight mean, NULL-free days only.

    A day counts when at least ``min_members`` members are observed.
    """
    joined = members.join(rets.where(F.col("ret").isNotNull()), "ticker")
    days = joined.groupBy("grp", "dt_idx", "age", "n_days").agg(
        F.avg("ret").alias("ret"), F.count("ret").alias("n_obs"))
    return days.where(F.col("n_obs") >= min_members)


def industry_returns(rets: DataFrame, members: DataFrame, caps: DataFrame,
                     min_members: int = 2) -> DataFrame:
    """(industry, dt_idx, n_days, ret, n_obs): cap-weighted, equal-weight without usable caps.

    A member without cap weighs nothing but counts as observed.
    """
    m = members.join(caps.select("ticker", "market_cap"), "ticker", "left").withColumn(
        "w", positive_or_zero(F.col("market_cap")))
    in_panel = rets.groupBy("ticker").agg(F.lit(1).alias("_p")).select("ticker")
    weights = (m.join(in_panel, "ticker", "left_semi").groupBy("industry")
               .agg(F.sum("w").alias("total_w"), F.count("*").alias("n_members"))
               .where(F.col("n_members") >= min_members))
    seen = rets.where(F.col("ret").isNotNull()).select("ticker", "dt_idx", "age", "n_days", "ret")
    days = (m.select("industry", "ticker", "w").join(seen, "ticker")
            .groupBy("industry", "dt_idx", "age", "n_days").agg(
                F.sum(F.col("w") * F.col("ret")).alias("num"), F.sum("w").alias("den"),
                F.avg("ret").alias("plain"), F.count("ret").alias("n_obs"))
            .where(F.col("n_obs") >= min_members))
    return days.join(weights.select("industry", "total_w"), "industry").select(
        "industry", "dt_idx", "age", "n_days", "n_obs",
        F.when(F.col("total_w") > 0, ratio(F.col("num"), F.col("den")))
        .otherwise(F.col("plain")).alias("ret"))
