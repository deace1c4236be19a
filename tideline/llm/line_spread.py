"""Line dedup by distinct-site spread, with DataFrame operations only (operator 10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import id_key, looked_up, packed, staged, text_key

#: A line on this many sites, in this many differing documents, is boilerplate.
MIN_SITES = 10
#: Relative error of the sketches: 128 registers each.
ERROR = 0.1


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _line_key(line: Column) -> Column:
    """64-bit key of a trimmed line; null for a blank one, which never counts."""
    bare = F.trim(line)
    return F.when(bare != "", F.xxhash64(bare))


def _two_longest(lines: Column) -> Column:
    """(first, second): the longest line that isn't blank, and the longest one that differs from it once trimmed."""
    kind = "struct<n:int,line:string>"
    sized = lambda x: F.struct(F.length(x).alias("n"), x.alias("line"))

    def with_line(two: Column, x: Column) -> Column:
        ahead = two["first"].isNull() | (sized(x) > two["first"])
        same = F.coalesce(F.trim(two["first"]["line"]) == F.trim(x), F.lit(False))
        then = F.struct(F.when(ahead, sized(x)).otherwise(two["first"]).cast(kind).alias("first"),
                        F.when(same, two["second"]).when(ahead, two["first"]).otherwise(F.greatest(two["second"], sized(x))).cast(kind).alias("second"))
        return F.when(F.trim(x) == "", two).otherwise(then)

    none = F.struct(F.lit(None).cast(kind).alias("first"), F.lit(None).cast(kind).alias("second"))
    return F.aggregate(lines, none, with_line)


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Keys of lines that spread over at least `min_sites` distinct sites (sources): one column, line.

    Copies of one document on many sites must not make all of its lines boilerplate, so a line must
    also meet at least `min_sites` distinct companions, where the companion of a line is the longest
    other line of its document (ties to the last by text; blank lines are none). Both numbers are
    HyperLogLog sketches per line that Spark merges, map-side first. A line is settled by the sketches when either is under a third of the threshold or both
    are four errors above it; every other line gets exact distinct counts.
    """
    rows = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), lines_of(F.col("text")).alias("lines"))
    # what holds for a whole document is worked out before its lines are exploded, not once per line
    rows = rows.select(F.xxhash64("site").alias("site"), "lines", _two_longest(F.col("lines")).alias("two"))
    first, second = F.col("two.first.line"), F.col("two.second.line")
    rows = rows.select("site", "lines", _line_key(first).alias("own"), F.xxhash64(first).alias("first"), F.when(second.isNotNull(), F.xxhash64(second)).alias("second"))
    rows = rows.select("site", "own", "first", "second", F.explode("lines").alias("raw")).withColumn("line", _line_key(F.col("raw"))).where("line is not null")
    # the longest line itself meets the longest other one
    rows = rows.select("site", F.when(F.col("line") == F.col("own"), F.col("second")).otherwise(F.col("first")).alias("companion"), "line")
    spread = rows.groupBy("line").agg(F.approx_count_distinct("site", ERROR).alias("sites"), F.approx_count_distinct("companion", ERROR).alias("companions"))
    low, high = min_sites / 3, min_sites * (1 + 4 * ERROR) + 1
    spread = staged(spread.where((F.col("sites") >= low) & (F.col("companions") >= low)), "spread")
    sure = (F.col("sites") > high) & (F.col("companions") > high)
    near = looked_up(rows, spread.where(~sure).select("line"), ["line"], "inner")
    exact = (near.groupBy("line").agg(F.count_distinct("site").alias("sites"), F.count_distinct("companion").alias("companions"))
             .where((F.col("sites") >= min_sites) & (F.col("companions") >= min_sites)))
    return staged(spread.where(sure).select("line").union(exact.select("line")), "boilerplate")


def removals(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(id_key, text_key, gone): positions of the boilerplate lines of each distinct document that has any."""
    keys = boilerplate(docs, min_sites)
    rows = docs.select(id_key(F.col("doc_id")).alias("id_key"), text_key(F.col("text")).alias("text_key"), lines_of(F.col("text")).alias("lines"))
    rows = rows.select("id_key", "text_key", F.posexplode("lines")).select("id_key", "text_key", "pos", _line_key(F.col("col")).alias("line"))
    found = looked_up(rows.where("line is not null"), keys, ["line"], "inner")
    return staged(found.groupBy("id_key", "text_key").agg(F.collect_set("pos").alias("gone")), "removals")


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, counts: bool = True) -> DataFrame:
    """All documents with their boilerplate lines removed: the input's columns and, with `counts`, n_lines and n_removed.

    Every occurrence of such a line goes; what is left keeps its order and line ends. n_chars, where
    there is one, is counted anew for changed texts. A null text stays null with no lines; an empty
    one has one blank line. Null sources are one site. A document that is nothing but boilerplate
    stays with an empty text. Repeated rows are cleaned alike. Other columns pass through, but for a
    caller's n_lines and n_removed, which `counts` replaces. Lines are told apart after spaces (U+0020) at both ends.
    """
    joined = looked_up(packed(docs), removals(docs, min_sites), ["id_key", "text_key"], grows=True)
    own = F.col("doc.text")
    kept = F.array_join(F.filter(lines_of(own), lambda _, i: ~F.array_contains(F.col("gone"), i)), "\n")
    joined = joined.select("doc", F.when(F.col("gone").isNull(), own).otherwise(kept).alias("text"),
                           F.greatest(F.coalesce(F.size(lines_of(own)), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"),
                           F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"))
    added = ("n_lines", "n_removed") if counts else ()
    new = {c: F.col(c) for c in ("text", *added)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("doc.n_chars"))
    whole = [new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns]
    return joined.select(*whole, *(c for c in added if c not in docs.columns))
