"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only (operator 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import id_key, looked_up, packed, staged, text_key, word_count

#: Parts of the unit interval that ranks are counted in before the one part that holds the cut is sorted.
PARTS = 4096


def filled(rows: DataFrame, within: list[str], weight: Column, room: Column, amount: Column) -> Column:
    """Level at which min(room, level * weight) adds up to `amount` within each group.

    With rows in order of room / weight, each row proposes the level that would do if all rows before
    it were full and none after; the largest proposal is the level.
    """
    part = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))
    up = part.orderBy(room / weight, weight).rowsBetween(Window.unboundedPreceding, -1)
    on = part.orderBy(room / weight, weight).rowsBetween(0, Window.unboundedFollowing)
    proposal = (amount - F.coalesce(F.sum(room).over(up), F.lit(0))) / F.sum(weight).over(on)
    return proposal


def source_targets(totals: DataFrame, most: int = 3) -> DataFrame:
    """(source, words) -> with target: weights 1, 2, 3, repeating by code point of the source, null last.

    All words are shared by weight; a target stops at `most` times its source's words and the excess
    is shared again. The table has one row per source, so its windows take one small task.
    """
    every = Window.partitionBy(F.lit(1))
    rows = totals.withColumn("weight", (1 + F.pmod(F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(3))).cast("double"))
    rows = rows.withColumn("room", (most * F.col("words")).cast("double")).withColumn("all_words", F.sum("words").over(every).cast("double"))
    rows = rows.withColumn("level", filled(rows, [], F.col("weight"), F.col("room"), F.col("all_words")))
    return rows.select("source", F.col("words").alias("source_words"), F.least("room", F.max("level").over(every) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, most: int = 3, seed: int = 7, text: bool = False) -> DataFrame:
    """Copies of each document in the mix: doc_id, size, source_size, target, taken, copies.

    Within a source a document expects min(most, k * appeal) copies, where appeal is the number of
    digits of its size (4 at most) and k makes the expected words equal the source's target. The whole
    part is certain. For the rest, documents are ranked by random odds over inclusion odds, and taken
    in this order while their words fit into what the target leaves; the last place goes to the
    document whose size is nearest to the words still open. Random numbers come from doc_id and text.

    Only one of PARTS parts of the rank's range is ever sorted per source, so a source with a third of
    all rows does not gather in a task. Null and empty texts have size 0 and are never counted; null
    sources are one source; equal ranks go by doc_id and size; repeated rows are documents of their
    own. An empty table gives an empty table. `taken` is copies * size, `most` * size at most. With
    `text`, id_key and text_key of each row follow.
    """
    uniform = (F.conv(F.substring(F.md5(F.concat(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(f":{seed}:"), F.coalesce("text", F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    keys = {"id_key": id_key(F.col("doc_id")), "text_key": text_key(F.col("text"))} if text else {}
    sized = staged(
        docs.select("doc_id", *(c.alias(n) for n, c in keys.items()), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), uniform.alias("u"))
        .withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        .withColumn("appeal", F.least(F.lit(4), F.length(F.col("size").cast("string"))))
        .withColumn("row", F.monotonically_increasing_id()), "sizes")
    levels = sized.groupBy("key", "appeal").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    levels = staged(levels, "levels")
    targets = source_targets(levels.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("words")).select("key", "source", "words")
                             .drop("key"), most).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    share = levels.drop("source").join(targets.drop("source"), "key").where("words > 0")
    share = share.withColumn("k", filled(share, ["key"], F.col("appeal") * F.col("words").cast("double"), most * F.col("words").cast("double"), F.col("target")))
    share = share.withColumn("expected", F.round(F.least(F.lit(float(most)), F.max("k").over(Window.partitionBy("key")) * F.col("appeal")), 9))
    share = share.withColumn("sure", F.floor("expected")).withColumn("chance", F.col("expected") - F.col("sure"))
    share = share.withColumn("open", F.col("target") - F.sum(F.col("sure") * F.col("words")).over(Window.partitionBy("key")))
    share = staged(share.select("key", "appeal", "sure", "chance", "open"), "shares")
    targets = staged(targets.select("key", F.col("source_words").alias("source_size"), "target"), "targets")

    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (1 - F.col("chance")))
    ranked = (looked_up(sized, share, ["key", "appeal"])
              .withColumn("rank", F.when(F.col("chance") > 0, odds))
              .withColumn("part", F.floor(F.col("rank") / (1 + F.col("rank")) * PARTS)))
    counted = ranked.where("rank is not null").groupBy("key", "part").agg(F.sum("size").alias("words"), F.first("open").alias("open"))
    counted = counted.withColumn("upto", F.sum("words").over(Window.partitionBy("key").orderBy("part")))
    cut = (counted.where("upto > open").groupBy("key").agg(F.min("part").alias("cut_part"), F.min(F.col("upto")).alias("upto"))
           .join(counted.select("key", F.col("part").alias("cut_part"), F.col("words").alias("cut_words")), ["key", "cut_part"])
           .select("key", "cut_part", (F.col("upto") - F.col("cut_words")).alias("base")))
    placed = looked_up(ranked, staged(cut, "cuts"), ["key"])
    in_cut = placed.where("part = cut_part")
    order = Window.partitionBy("key").orderBy("rank", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    in_cut = in_cut.withColumn("hit", F.col("base") + F.sum("size").over(order) <= F.col("open"))
    clear = placed.where("not (part <=> cut_part) or part is null").withColumn("hit", F.col("rank").isNotNull() & (F.col("cut_part").isNull() | (F.col("part") < F.col("cut_part"))))
    picked = staged(clear.unionByName(in_cut).select("row", "doc_id", *keys, "key", "size", "sure", "rank", "open", "hit"), "picked")

    left = (picked.where("rank is not null").groupBy("key").agg((F.first("open") - F.sum(F.when(F.col("hit"), F.col("size")).otherwise(0))).alias("left")))
    left = staged(left, "left")
    near = (looked_up(picked.where("not hit and rank is not null and size > 0"), left, ["key"])
            .withColumn("off", F.abs(F.col("size") - F.col("left"))).where("off < left"))
    best = staged(near.groupBy("key").agg(F.min("off").alias("off")), "off")
    tied = looked_up(near.withColumnRenamed("off", "own_off"), best, ["key"]).where("own_off = off")
    first = staged(tied.groupBy("key").agg(F.min("rank").alias("best_rank")), "best")
    tied = looked_up(tied, first, ["key"]).where("rank = best_rank")
    last = staged(tied.groupBy("key").agg(F.min("row").alias("last_row")), "last")

    out = looked_up(looked_up(picked, last, ["key"]), targets, ["key"])
    more = F.col("hit").cast("long") + F.coalesce(F.col("row") == F.col("last_row"), F.lit(False)).cast("long")
    return out.select(
        "doc_id", "size", "source_size", "target", ((F.coalesce(F.col("sure"), F.lit(0)) + more) * F.col("size")).cast("long").alias("taken"),
        F.when(F.col("size") > 0, F.coalesce(F.col("sure"), F.lit(0)) + more).otherwise(0).cast("long").alias("copies"), *keys)


def mixed_documents(docs: DataFrame, most: int = 3, seed: int = 7) -> DataFrame:
    """The documents of the mix, with all their columns and `copies` (1 to `most`); those not taken are left out.

    Rows with the same doc_id and text share their copies: each gets the whole part of the mean, the
    first ones one more.
    """
    counts = mix(docs, most, seed, text=True).groupBy("id_key", "text_key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    counts = staged(counts.where("copies > 0"), "copies")
    joined = looked_up(packed(docs), counts, ["id_key", "text_key"], "inner", grows=True)
    names = [F.col(f"doc.`{c}`") for c in docs.columns if c.lower() != "copies"]
    single = joined.where("rows = 1").select(*names, "copies")
    order = Window.partitionBy("id_key", "text_key").orderBy(F.lit(1))
    shared = joined.where("rows > 1").withColumn("n", F.row_number().over(order))
    share = F.floor(F.col("copies") / F.col("rows")) + (F.col("n") <= F.pmod(F.col("copies"), F.col("rows"))).cast("long")
    return single.union(shared.withColumn("copies", share).where("copies > 0").select(*names, "copies"))
