"""Walk a session-batch in arrival order until two attributes are both known.

Every non-empty value overwrites the one before it; the walk stops after the row at which both
are set. So the attribute seen second takes its first value, and the one seen first takes its
last value up to that row. If one never arrives, the other keeps its last value.

A group may hold a third of all rows, so nothing here gathers or sorts a group. One pass of plain
aggregates settles nearly every group. The rest (the first attribute changed its value before
the second one arrived) need "the last value before row n": ``late_values`` joins the rows with the
one row that describes their group, salted so that a hot group spreads over ``SALTS`` join keys, and
keeps a maximum. The order column may be of any type that can be compared; nothing is counted off.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Join keys that the rows of one undecided group are spread over.
SALTS = 32


def keyed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with whole keys. The joins further on imply this for their side; stated for both, the
    two sides have the same plan below the aggregates."""
    return rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def scan_aggregates(
    left: str, right: str, order: str = "ord", n_codes: int | None = None
) -> list[Column]:
    """Aggregates that describe the walk.

    With ``n_codes`` the values are integers below it. Then the aggregates stay hash aggregates,
    and the first row of each code tells which codes occur before the stop row.
    """
    out = []
    for name, other in ((left, right), (right, left)):
        own = F.when(F.col(name).isNotNull(), F.col(order))
        others = F.when(F.col(other).isNotNull(), F.col(order))
        out += [
            F.min(own).alias(f"{name}_start"),
            F.min_by(name, own).alias(f"{name}_first"),
            F.max_by(name, own).alias(f"{name}_last"),
            F.min_by(name, others).alias(f"{name}_at_stop"),
        ]
        if n_codes is None:
            out += [F.min(name).alias(f"{name}_low"), F.max(name).alias(f"{name}_high")]
        else:
            out += [
                F.min(F.when(F.col(name) == code, F.col(order))).alias(f"{name}_code_{code}")
                for code in range(n_codes)
            ]
    return out


def _never_changes(name: str, other: str, n_codes: int | None) -> Column:
    """Whether an attribute seen first keeps its first value up to the stop row."""
    if n_codes is None:
        return F.col(f"{name}_low") == F.col(f"{name}_high")
    stop = F.col(f"{other}_start")
    early = [
        F.coalesce(F.col(f"{name}_code_{code}") < stop, F.lit(False)).cast("int")
        for code in range(n_codes)
    ]
    return sum(early[1:], early[0]) == 1


def _is_open(name: str, other: str, n_codes: int | None) -> Column:
    """Whether the plain aggregates leave this attribute undecided."""
    return (
        (F.col(f"{name}_start") < F.col(f"{other}_start"))
        & F.col(f"{name}_at_stop").isNull()
        & ~_never_changes(name, other, n_codes)
    )


def resolve(name: str, other: str, late: str, n_codes: int | None = None) -> Column:
    """Final value of one attribute from the aggregates and the late values."""
    both = F.col(f"{name}_start").isNotNull() & F.col(f"{other}_start").isNotNull()
    return (
        F.when(~both, F.col(f"{name}_last"))
        .when(F.col(f"{name}_start") >= F.col(f"{other}_start"), F.col(f"{name}_first"))
        .when(F.col(f"{name}_at_stop").isNotNull(), F.col(f"{name}_at_stop"))
        .when(_never_changes(name, other, n_codes), F.col(f"{name}_first"))
        .otherwise(F.col(late))
    )


def late_values(
    rows: DataFrame,
    stats: DataFrame,
    left: str,
    right: str,
    keys: Sequence[str],
    order: str = "ord",
    salts: int = SALTS,
    n_codes: int | None = None,
) -> DataFrame:
    """For undecided groups: the last value of the first-seen attribute before the stop row.

    ``stats`` are the ``scan_aggregates`` of ``keyed`` rows. Each undecided group is repeated once
    per salt; whether that side is shipped is Spark's decision by its size.
    """
    stop = F.greatest(f"{left}_start", f"{right}_start")
    open_groups = stats.where(_is_open(left, right, n_codes) | _is_open(right, left, n_codes)).select(
        *keys, stop.alias("stop"), F.explode(F.array(*map(F.lit, range(salts)))).alias("salt")
    )
    # Before the stop row only one of the two attributes has values, so rows with both lie beyond it
    # and need not be joined.
    valued = rows.where(F.col(left).isNotNull() != F.col(right).isNotNull()).select(
        *keys,
        order,
        F.pmod(F.xxhash64(order), F.lit(salts)).cast("int").alias("salt"),
        F.coalesce(left, right).alias("value"),
    )
    return (
        valued.join(open_groups, [*keys, "salt"])
        .where(F.col(order) < F.col("stop"))
        .groupBy(*keys)
        .agg(F.max_by("value", order).alias("late_value"))
    )


def scan(
    rows: DataFrame,
    left: str,
    right: str,
    keys: Sequence[str],
    order: str = "ord",
    n_codes: int | None = None,
) -> DataFrame:
    """Both attributes per group; null where never seen."""
    rows = keyed(rows, keys)
    stats = rows.groupBy(*keys).agg(*scan_aggregates(left, right, order, n_codes))
    late = late_values(rows, stats, left, right, keys, order, n_codes=n_codes)
    return stats.join(late, list(keys), "left").select(
        *keys,
        resolve(left, right, "late_value", n_codes).alias(left),
        resolve(right, left, "late_value", n_codes).alias(right),
    )
