"""Running sums over counts without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Neighbouring values that one window adds up.
BLOCK = 4096


def running(df: DataFrame, at: str, sums: dict[str, str], by: list[str] | None = None, block: int | None = None) -> DataFrame:
    """``df`` (one row for each by..., at) with the sums of columns over all rows of the group whose ``at`` is no greater, and
    with ``<name>_all``, the sum over the group: ``sums`` maps names of results to columns.  ``at`` is an integer of 0 or more.

    Rows are added up in blocks of BLOCK neighbouring values; only the blocks' totals are added up group by group.  Where
    the values are counts of n rows, there are at most 2 sqrt(n / BLOCK) blocks (of those beyond t there are at most n / t), some
    300,000 for 10^14 rows; so also a single group is no large task.  Other values need a ``block`` that leaves few enough.
    """
    by = by or []
    parts = df.withColumn("__b", F.floor(F.col(at) / (block or BLOCK)))
    totals = parts.groupBy(*by, "__b").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by, "__b", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in sums], *[F.sum(f"__{n}").over(group).alias(f"{n}_all") for n in sums])
    within = Window.partitionBy(*by, "__b").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.select("*", *[F.sum(c).over(within).alias(f"__in_{n}") for n, c in sums.items()])
    out = local.join(carried, [*by, "__b"])
    return out.select(*df.columns, *[(F.col(f"__in_{n}") + F.col(f"__before_{n}")).alias(n) for n in sums], *[f"{n}_all" for n in sums])
