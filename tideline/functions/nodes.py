"""Node ids of the relation graph: T:<ticker>, I:<industry>, D:<driver>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ticker_node(col: Column) -> Column:
    return F.concat(F.lit("T:"), col)


def industry_node(col: Column) -> Column:
    return F.concat(F.lit("I:"), col)


def driver_node(col: Column) -> Column:
    return F.concat(F.lit("D:"), col)


def node_kind(col: Column) -> Column:
    """Kind letter; a node without a known prefix is a ticker."""
    return F.when(col.rlike("^[TID]:"), F.substring(col, 1, 1)).otherwise(F.lit("T"))


def node_value(col: Column) -> Column:
    return F.when(col.rlike("^[TID]:"), F.substring(col, 3, 2147483647)).otherwise(col)
