"""Running values over ordered groups of any size.

A group normally is one window, which is right for groups that are bounded by nature, such as the nodes of a page. Groups
that may be large are cut: the rows are stored, dealt out by ranges of key and order, and every part of a group that lies in
one range is a window of its own. One small row per group and range carries the state onward and is joined back. Ranges have
about as many rows each whatever the keys and orders are, so no task gets a whole large group; nothing is counted or gathered
to find such groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrecords.operators.storage import checkpoint_dir

_CUT = "_cut"
_RANGE = "_range"
BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, Window.currentRow)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    large: bool = False,
    major: Sequence[Column] = (),
) -> DataFrame:
    """Add running columns per group.

    ``sums``: sum over all earlier rows, as a long. ``lasts``: latest non-null value up to and including the row.
    ``major`` columns come before ``order`` in the ordering. ``large``: groups may be of any size.
    """
    sums = {k: v.cast("long") for k, v in (sums or {}).items()}
    lasts = dict(lasts or {})
    if not sums and not lasts:
        return df
    if not large:
        # the window would build all its inputs before the shuffle; shuffled first, every text travels once
        w = Window.partitionBy(*keys).orderBy(*major, order)
        return df.repartition(*keys).withColumns(_over(w, sums, lasts))

    spark = df.sparkSession
    checkpoint_dir(spark)
    majors = {f"_major{i}": m for i, m in enumerate(major)}
    # stored once before and once after the dealing: finding the ranges reads the rows, and both uses must see the same ones
    rows = df.withColumns(majors).checkpoint() if majors else df.checkpoint()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *keys, *majors, order).withColumn(_RANGE, F.spark_partition_id()).checkpoint()
    # one struct as the key of a part, so that null keys form a group too
    rows = rows.withColumn(_CUT, F.struct(*keys, *majors, _RANGE)).drop(*majors, _RANGE)
    local = rows.repartition(_CUT).withColumns(
        {f"_local_{k}": v for k, v in _over(Window.partitionBy(_CUT).orderBy(order), sums, lasts).items()}
    )

    # state at the end of every part: combined map-side, one row per part
    totals = [F.sum(v).alias(k) for k, v in sums.items()]
    ends = [F.max_by(v, F.when(v.isNotNull(), F.col(order))).alias(k) for k, v in lasts.items()]
    state = rows.groupBy(_CUT).agg(*totals, *ends)
    by_part = Window.partitionBy(*[f"{_CUT}.{k}" for k in keys]).orderBy(*[f"{_CUT}.{m}" for m in majors], f"{_CUT}.{_RANGE}")
    carried = state.select(
        F.col(_CUT).alias("_of"),
        *[F.sum(k).over(by_part.rowsBetween(*BEFORE)).alias(f"_carry_{k}") for k in sums],
        *[F.last(k, ignorenulls=True).over(by_part.rowsBetween(*BEFORE)).alias(f"_carry_{k}") for k in lasts],
    )
    zero = F.lit(0).cast("long")
    out = local.join(carried, F.col(_CUT) == F.col("_of"), "left").withColumns(
        {k: F.coalesce(F.col(f"_carry_{k}"), zero) + F.col(f"_local_{k}") for k in sums}
        | {k: F.coalesce(f"_local_{k}", f"_carry_{k}") for k in lasts}
    )
    names = [*sums, *lasts]
    return out.drop(_CUT, "_of", *[f"_local_{k}" for k in names], *[f"_carry_{k}" for k in names])


def _over(w, sums: Mapping[str, Column], lasts: Mapping[str, Column]) -> dict[str, Column]:
    zero = F.lit(0).cast("long")
    return {k: F.coalesce(F.sum(v).over(w.rowsBetween(*BEFORE)), zero) for k, v in sums.items()} | {
        k: F.last(v, ignorenulls=True).over(w.rowsBetween(*UP_TO)) for k, v in lasts.items()
    }

