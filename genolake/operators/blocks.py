"""Order-dependent work along a coordinate without a task for each chromosome: an ordered pass over blocks of positions.

Windows run inside blocks, once, and what they find is written with the rows.  A
row for each block sums the block up; what lies before and after it is worked out
over those rows alone and joined back.  So a source is read and moved once, however
long its chain of windows is, and no task depends on the size of a chromosome.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..sources import stored

BLOCK = "_block"
WIDTH = 1 << 20
Columns = Mapping[str, Column]


def blocked(df: DataFrame, pos: str = "pos", width: float = WIDTH) -> DataFrame:
    return df.withColumn(BLOCK, F.floor(F.col(pos) / width).cast("long"))


def passed(df: DataFrame, by: Sequence[str], local: Sequence[Columns], summary: Columns, carry: Callable[[WindowSpec, WindowSpec], Sequence[Columns]], *, pos: str = "pos", width: float = WIDTH) -> DataFrame:
    """The rows with ``local`` columns and those of ``carry``.

    local: windows inside blocks (``inside``), each step from those before.
    summary: aggregates of a block's rows.  carry: given the windows of all earlier
    and of all later blocks, columns from the summaries, each step from those before.
    Rows without a position or a key have no place in the order and are left out.
    """
    out = stored.dealt(blocked(df, pos, width), *by, BLOCK)
    for columns in local:
        out = out.withColumns(columns)
    rows = stored.written(out, "blocks")
    each = rows.groupBy(*by, BLOCK).agg(*[c.alias(name) for name, c in summary.items()])
    order, names = Window.partitionBy(*by).orderBy(BLOCK), []
    for columns in carry(order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)):
        each = each.withColumns(columns)
        names += [c for c in columns if c not in names]
    return rows.join(each.select(*by, BLOCK, *names), [*by, BLOCK])


def inside(by: Sequence[str], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*by, BLOCK).orderBy(*order)


def last(column: str | Column) -> Column:
    return F.last(column, ignorenulls=True)


def first(column: str | Column) -> Column:
    return F.first(column, ignorenulls=True)
