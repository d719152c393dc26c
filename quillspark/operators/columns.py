"""Column names that don't clash, and ranks without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores after it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _share(df: DataFrame, order: str) -> Column:
    """Where in its range an order lies, from 0 to 1: a share itself, or the beginning of a hexadecimal hash."""
    if dict(df.dtypes)[order] == "double":
        return F.col(order)
    return F.conv(F.substring(order, 1, 12), 16, 10).cast("double") / float(1 << 48)


def ranked(rows: DataFrame, by: list[str], order: Column, id_: str) -> tuple[DataFrame, str, str]:
    """(rows with two more columns, name of the rank from 1 in the group by, name of the group's size).

    order: a hash or a share of one that spreads evenly; equal ones go by id_. Each group is cut into
    as many ranges of order as the root of its size, so neither a range nor their list is long.
    """
    o, g, n, part, start, r = fresh(rows, "order", "group", "size", "part", "start", "rank")
    rows = rows.withColumn(o, order).withColumn(g, F.to_json(F.struct(*by)) if by else F.lit(""))
    sizes = rows.groupBy(g).agg(F.count("*").alias(n))
    cells = F.ceil(F.sqrt(n))
    rows = rows.join(sizes, g).withColumn(part, F.least(cells - 1, F.floor(_share(rows, o) * cells)).cast("long"))
    each = rows.groupBy(g, part).agg(F.count("*").alias("own"))
    before = Window.partitionBy(g).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select(g, part, F.coalesce(F.sum("own").over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(g, part).orderBy(o, id_)
    out = rows.withColumn(r, F.row_number().over(within)).join(starts, [g, part]).withColumn(r, F.col(r) + F.col(start))
    return out.drop(g, part, start, o), r, n
