"""Industry flow graph: supply direction, cycles, layers, levels, closure.

The graph has one node per industry of the vocabulary. Iterative jobs run whole rounds as joins and
aggregates, cut lineage each round in shared storage, and only ask the driver whether to go on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline import settings as S
from tideline.functions import nodes as N
from tideline.runtime import checkpointed


def _claims(edges: DataFrame) -> DataFrame:
    """Industry -> industry edges as (a, b, rel, who, product, attribution)."""
    both = (N.node_kind(F.col("src")) == "I") & (N.node_kind(F.col("dst")) == "I")
    return edges.where(both).select(
        N.node_value(F.col("src")).alias("a"), N.node_value(F.col("dst")).alias("b"), "rel",
        F.coalesce(F.nullif("origin", F.lit("")), F.nullif("source", F.lit("")), F.lit("?")).alias("who"),
        "product", "attribution")


def flow_edges(edges: DataFrame) -> DataFrame:
    """(supplier, consumer, n_origins, guessed): upstream relations turned into the flow of goods.

    A flow is a guess only when every statement of it is.
    """
    up = _claims(edges).where(F.col("rel") == S.REL_UPSTREAM)
    return up.groupBy(F.col("b").alias("supplier"), F.col("a").alias("consumer")).agg(
        F.countDistinct("who").alias("n_origins"),
        F.bool_and(F.col("attribution") == S.ATTRIBUTION_GUESSED).alias("guessed"))


def relation_origins(edges: DataFrame) -> DataFrame:
    """(industry, rel, other, n_origins) for both directions."""
    c = _claims(edges).where(F.col("rel").isin(S.REL_UPSTREAM, S.REL_DOWNSTREAM))
    return c.groupBy(F.col("a").alias("industry"), "rel", F.col("b").alias("other")).agg(
        F.countDistinct("who").alias("n_origins"))


def flow_labels(edges: DataFrame) -> DataFrame:
    """(supplier, consumer, label): what flows, as the statement that names goods most plainly.

    Company names in brackets go; texts naming the consumer come last, texts naming the supplier
    first, then the shortest, then the first by letter.
    """
    c = _claims(edges).where(F.col("rel").isin(S.REL_UPSTREAM, S.REL_DOWNSTREAM)
                             & (F.coalesce("product", F.lit("")) != ""))
    up = F.col("rel") == S.REL_UPSTREAM
    said = c.select(F.when(up, F.col("b")).otherwise(F.col("a")).alias("supplier"),
                    F.when(up, F.col("a")).otherwise(F.col("b")).alias("consumer"), "product").distinct()
    p = F.regexp_replace("product", r"[(（][^)）]*[)）]", "")
    p = F.regexp_replace(F.regexp_replace(p, r"(?U)\s*/\s*", " / "), r"(?U)\s+", " ")
    said = said.withColumn("p", F.regexp_replace(p, r"\A[ /·,]+|[ /·,]+\z", "")).where("p <> ''")
    names = lambda col: F.exists(F.filter(F.split(col, "[·・, ]"), lambda t: F.length(t) >= 2),
                                 lambda t: F.contains(F.col("p"), t))
    key = F.struct(names("consumer").alias("k1"), (~names("supplier")).alias("k2"), F.length("p").alias("k3"),
                   F.col("p").alias("label"))
    return said.groupBy("supplier", "consumer").agg(F.min(key).alias("k")).select(
        "supplier", "consumer", F.col("k.label").alias("label"))


def orphan_industries(members: DataFrame, flow: DataFrame) -> DataFrame:
    """Industries that have members but no place in the flow."""
    ends = flow.select(F.col("supplier").alias("industry")).unionByName(
        flow.select(F.col("consumer").alias("industry")))
    return members.select("industry").distinct().join(ends, "industry", "left_anti")


def break_cycles(flow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges kept, edges dropped) so that the kept ones have no cycle.

    Ends (nothing left to sell to, or to buy from) are peeled off, a whole frontier per round; when
    only cycles remain, the node that sells to most and buys from fewest is placed next and the edges
    that still lead into it are dropped.
    """
    all_edges = checkpointed(flow.select("supplier", "consumer").where("supplier <> consumer").distinct())
    live, dropped = all_edges, []
    while not live.isEmpty():
        deg = live.select(F.col("supplier").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
            live.select(F.col("consumer").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
        ).groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        # one row: is there an end to peel, and which node to place otherwise
        state = deg.agg(F.max((F.col("o") == 0) | (F.col("i") == 0)).alias("peel"),
                        F.min(F.struct((F.col("i") - F.col("o")).alias("k"), "node"))["node"].alias("pick"))
        gone = deg.join(F.broadcast(state)).where(F.when(
            F.col("peel"), (F.col("o") == 0) | (F.col("i") == 0)).otherwise(F.col("node") == F.col("pick"))
        ).select("node", (~F.col("peel")).alias("forced"))
        marked = (live.join(gone.select(F.col("node").alias("supplier"), F.lit(True).alias("s_gone")), "supplier", "left")
                  .join(gone.select(F.col("node").alias("consumer"), F.lit(True).alias("c_gone"),
                                    F.col("forced").alias("c_forced")), "consumer", "left"))
        marked = checkpointed(marked)
        dropped.append(marked.where("c_forced").select("supplier", "consumer"))
        live = marked.where("s_gone is null and c_gone is null").select("supplier", "consumer")
    if not dropped:
        return all_edges, all_edges
    out = checkpointed(reduce(DataFrame.unionByName, dropped))
    return all_edges.join(out, ["supplier", "consumer"], "left_anti"), out


def layers(flow: DataFrame) -> DataFrame:
    """(node, layer) over edges without cycles: the longest path from a source.

    Pure sources move up next to their nearest consumer, then the lowest layer becomes 0.
    """
    e = checkpointed(flow.select("supplier", "consumer").distinct())
    nodes = e.select(F.col("supplier").alias("node")).unionByName(e.select(F.col("consumer").alias("node"))).distinct()
    level = checkpointed(nodes.withColumn("layer", F.lit(0)))
    changed = level
    while not changed.isEmpty():
        push = e.join(changed, F.col("supplier") == F.col("node")).groupBy(F.col("consumer").alias("node")).agg(
            (F.max("layer") + 1).alias("pushed"))
        nxt = checkpointed(level.join(push, "node", "left").select(
            "node", F.greatest("layer", F.coalesce("pushed", F.lit(0))).alias("layer"),
            (F.coalesce("pushed", F.lit(0)) > F.col("layer")).alias("up")))
        level, changed = nxt.select("node", "layer"), nxt.where("up").select("node", "layer")
    fed = e.select(F.col("consumer").alias("node")).distinct().withColumn("fed", F.lit(True))
    near = e.join(level, F.col("consumer") == F.col("node")).groupBy(F.col("supplier").alias("node")).agg(
        (F.min("layer") - 1).alias("near"))
    placed = level.join(fed, "node", "left").join(near, "node", "left").select(
        "node", F.when(F.col("fed").isNull() & F.col("near").isNotNull(), F.col("near"))
        .otherwise(F.col("layer")).alias("layer"))
    low = placed.agg(F.min("layer").alias("low"))
    return placed.join(F.broadcast(low)).select("node", (F.col("layer") - F.col("low")).alias("layer"))


def closure(flow: DataFrame) -> DataFrame:
    """(node, below): everything that can be reached downstream, the node itself where it is on a cycle.

    A round joins the pairs it found last with all pairs, which doubles the length of the paths known,
    so rounds grow with the logarithm of the depth. What a round finds is written once and appended;
    earlier pairs are read, never written again.
    """
    fresh = checkpointed(flow.select(F.col("supplier").alias("node"), F.col("consumer").alias("below")).distinct())
    found = [fresh]
    while not fresh.isEmpty():
        known = reduce(DataFrame.unionByName, found)
        step = known.select(F.col("node").alias("below"), F.col("below").alias("next"))
        grown = fresh.join(step, "below").select("node", F.col("next").alias("below")).distinct()
        fresh = checkpointed(grown.join(known, ["node", "below"], "left_anti"))
        found.append(fresh)
    return reduce(DataFrame.unionByName, found)


def chain_levels(seeds: DataFrame, adjacency: DataFrame, caps: tuple[int, ...] = S.GraphSettings().chain_caps
                 ) -> DataFrame:
    """(seed, level, rank, node): the chain of each seed industry in one direction.

    ``adjacency(node, target, n_origins)``. A node appears once per seed; a level keeps its first
    ``caps[level]`` nodes by parent rank, then by number of origins, then by name.
    """
    front = seeds.select(F.col("industry").alias("seed"), F.col("industry").alias("node"), F.lit(1).alias("rank"))
    seen, out = front.select("seed", "node"), []
    for level, cap in enumerate(caps, start=1):
        nxt = (front.join(adjacency, "node").groupBy("seed", F.col("target").alias("node"))
               .agg(F.min(F.struct("rank", (-F.col("n_origins")).alias("n"))).alias("k"))
               .join(seen, ["seed", "node"], "left_anti"))
        w = Window.partitionBy("seed").orderBy("k.rank", "k.n", "node")
        front = checkpointed(nxt.withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap).select(
            "seed", "node", F.col("r").alias("rank")))
        seen = seen.unionByName(front.select("seed", "node"))
        out.append(front.select("seed", F.lit(level).alias("level"), "rank", "node"))
    return reduce(DataFrame.unionByName, out)
