"""Lookups for every ticker at once, over classes of tickers that the graph can't tell apart.

Tickers with the same industries (at the same confidence, from the same sources) and the same drivers
have the same neighbourhood but for themselves. Such a class is named by its smallest ticker, and what
holds for the class is looked up once, for that ticker. Results are rows per class and per target
(industry or driver) together with membership; pairs of tickers are never written, so the output
grows with memberships and exposures however crowded an industry is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.operators import graph as R


def classes(df: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """(ticker, class_id) of every ticker that is a member of an industry or exposed to a driver."""
    marks = R.memberships(df, min_confidence).select("ticker", F.to_json(F.struct(
        "industry", "confidence", "source")).alias("mark")).unionByName(
        R.exposed(df, min_confidence).select("ticker", F.col("driver").alias("mark")))
    same = F.sha2(F.to_json(F.sort_array(F.collect_set("mark"))), 256)
    signed = marks.groupBy("ticker").agg(same.alias("signature"))
    named = signed.groupBy("signature").agg(F.min("ticker").alias("class_id"))
    return signed.join(named, "signature").select("ticker", "class_id")


def representatives(cls: DataFrame) -> DataFrame:
    return cls.where(F.col("ticker") == F.col("class_id")).select("ticker")


def targets(df: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """(ticker, kind, target): the industries (I) and drivers (D) under which a ticker is found."""
    return R.members(df, min_confidence).select("ticker", F.lit("I").alias("kind"), F.col("industry").alias("target")).unionByName(
        R.exposed(df, min_confidence).select("ticker", F.lit("D").alias("kind"), F.col("driver").alias("target")).distinct())


def sizes(df: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """(industry, n_members)."""
    return R.members(df, min_confidence).groupBy("industry").agg(F.count("*").alias("n_members"))


def class_paths(df: DataFrame, cls: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Both directions of the two-hop lookup per class: (class_id, from_industry, industry, relation, ...).

    The members at the end of a path are those of ``industry``.
    """
    reps = representatives(cls)
    both = R.vertical(df, reps, S.REL_UPSTREAM, min_confidence).unionByName(
        R.vertical(df, reps, S.REL_DOWNSTREAM, min_confidence))
    return both.withColumnRenamed("ticker", "class_id")


def class_industries(df: DataFrame, cls: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """(class_id, industry, n_members): the peers of a class are the members of its industries."""
    own = R.members(df, min_confidence).join(representatives(cls), "ticker", "left_semi")
    return own.join(sizes(df, min_confidence), "industry").select(F.col("ticker").alias("class_id"), "industry", "n_members")


def class_drivers(df: DataFrame, cls: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """(class_id, driver, n_same, n_opposite): how many tickers move with and against a driver of the class."""
    ex = R.exposed(df, min_confidence)
    mine = ex.join(representatives(cls), "ticker", "left_semi").select(F.col("ticker").alias("class_id"), "driver").distinct()
    who = ex.select("ticker", "driver", (F.col("sign") >= 0).alias("same")).distinct()
    n = who.groupBy("driver").agg(F.count_if("same").alias("n_same"), F.count_if(~F.col("same")).alias("n_opposite"),
                                  F.countDistinct("ticker").alias("n"))
    return mine.join(n.where("n > 1").drop("n"), "driver").select("class_id", "driver", "n_same", "n_opposite")


def driver_shares(df: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """(ticker, driver, source, my_sign, my_weight, n_same, n_opposite) of every exposure that others share.

    The counts are of other tickers' exposures: totals of the driver without the ticker's own.
    """
    ex = R.exposed(df, min_confidence)
    count = lambda *keys: ex.groupBy(*keys).agg(
        F.count_if(F.col("sign") >= 0).alias("s"), F.count_if(F.col("sign") < 0).alias("o"), F.count("*").alias("n"))
    own = count("ticker", "driver").select("ticker", "driver", F.col("s").alias("own_s"), F.col("o").alias("own_o"), F.col("n").alias("own_n"))
    mine = ex.select("ticker", "driver", "source", F.col("sign").alias("my_sign"), F.col("weight").alias("my_weight")).distinct()
    both = mine.join(own, ["ticker", "driver"]).join(count("driver"), "driver")
    return both.where(F.col("n") > F.col("own_n")).select(
        "ticker", "driver", "source", "my_sign", "my_weight", (F.col("s") - F.col("own_s")).alias("n_same"),
        (F.col("o") - F.col("own_o")).alias("n_opposite"))


def co_exposures(df: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """``share`` rows as in ``driver_shares``, and a ``member`` row (driver, other, sign, weight, other_source) per exposure.

    The co-exposed of a ticker at a driver are the driver's members but for itself: no pair is lost, none is written.
    """
    members = exposed_members(df, min_confidence)
    return driver_shares(df, min_confidence).withColumn("part", F.lit("share")).unionByName(
        members.withColumn("part", F.lit("member")), allowMissingColumns=True)


def exposed_members(df: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    return R.exposed(df, min_confidence).select(
        "driver", F.col("ticker").alias("other"), "sign", "weight", F.col("source").alias("other_source"))


def routes(df: DataFrame, cls: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """(class_id, kind, target, prio, conf, via): the first label under which a class reaches a target.

    Upstream comes before downstream, then peers, then shared drivers; within one kind the more
    confident path (``conf`` is its negative) comes first, then the label by name.
    """
    paths = class_paths(df, cls, min_confidence)
    up = F.col("relation") == S.REL_UPSTREAM
    told = [paths.select("class_id", F.lit("I").alias("kind"), F.col("industry").alias("target"), F.when(up, 0).otherwise(1).alias("prio"),
                         (-F.col("confidence")).alias("conf"), F.concat("from_industry", F.lit("→"), "relation", F.lit("→"), "industry").alias("via"))]
    reps = targets(df, min_confidence).join(representatives(cls), "ticker", "left_semi").withColumnRenamed("ticker", "class_id")
    for kind, prio, via in (("I", 2, F.concat("target", F.lit("→" + S.PEER_LABEL))), ("D", 3, F.concat(F.lit(S.DRIVER_LABEL), "target"))):
        told.append(reps.where(F.col("kind") == kind).select("class_id", "kind", "target", F.lit(prio).alias("prio"),
                                                             F.lit(0.0).alias("conf"), via.alias("via")))
    best = reduce(DataFrame.unionByName, told).groupBy("class_id", "kind", "target").agg(
        F.min(F.struct("prio", "conf", "via")).alias("b"))
    return best.select("class_id", "kind", "target", "b.prio", "b.conf", "b.via")


def reach_of(routes: DataFrame, cls: DataFrame, targets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ticker, other, via) of the pairs asked about that are connected."""
    asked = pairs.select("ticker", "other").where(F.col("ticker") != F.col("other")).distinct().join(cls, "ticker")
    met = asked.join(targets.withColumnRenamed("ticker", "other"), "other").join(routes, ["class_id", "kind", "target"])
    return met.groupBy("ticker", "other").agg(F.min_by("via", F.struct("prio", "conf", "via")).alias("via"))


def first_reach(routes: DataFrame, cls: DataFrame, targets: DataFrame, order: DataFrame) -> DataFrame:
    """(ticker, via): for every ticker that one of ``order(ticker, pos)`` reaches, the first one's label.

    Two sources per target are enough: a ticker that would be first itself leaves the place to the
    second, and its first source is first, itself aside, at every target that it reaches.
    """
    two = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("pos", "ticker"))
    first = cls.join(order.select("ticker", "pos"), "ticker").withColumn("rn", two("class_id")).where("rn <= 2").drop("rn")
    sources = first.join(routes, "class_id").withColumn("rn", two("kind", "target")).where("rn <= 2")
    sources = sources.select(F.col("ticker").alias("source"), "pos", "kind", "target", "prio", "conf", "via")
    met = targets.join(sources, ["kind", "target"]).where(F.col("source") != F.col("ticker"))
    return met.groupBy("ticker").agg(F.min_by("via", F.struct("pos", "source", "prio", "conf", "via")).alias("via"))


def neighbourhood(df: DataFrame, cls: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """The neighbourhood of every class as typed rows: (class_id, part, via, ticker, sign, confidence, n).

    ``member`` rows name the tickers of the class. ``n`` counts the tickers found at ``via``, those of
    the class included: members of an industry, or exposures to a driver with the sign of the row.
    """
    rows = lambda d, part, via, ticker=None, sign=None, confidence=None, n=None: d.select(
        "class_id", F.lit(part).alias("part") if isinstance(part, str) else part.alias("part"), via.cast("string").alias("via"),
        (ticker if ticker is not None else F.lit(None)).cast("string").alias("ticker"), F.lit(sign).cast("int").alias("sign"),
        (confidence if confidence is not None else F.lit(None)).cast("double").alias("confidence"),
        (n if n is not None else F.lit(None)).cast("long").alias("n"))
    own = class_industries(df, cls, min_confidence)
    paths = class_paths(df, cls, min_confidence).join(sizes(df, min_confidence), "industry", "left")
    drivers = class_drivers(df, cls, min_confidence)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    part = F.when(F.col("relation") == S.REL_UPSTREAM, "upstream").otherwise("downstream")
    return reduce(DataFrame.unionByName, [
        rows(cls, "member", F.lit(None), F.col("ticker")),
        rows(own, "industry", F.col("industry"), n=F.col("n_members")),
        rows(paths, part, F.concat_ws(">", "from_industry", "industry"), confidence=F.col("confidence"), n=n("n_members")),
        rows(drivers, "driver", F.col("driver"), sign=1, n=F.col("n_same")),
        rows(drivers, "driver", F.col("driver"), sign=-1, n=F.col("n_opposite"))])
