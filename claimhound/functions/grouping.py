"""Grouped aggregation, top-k and ranking shapes that hold up under skew."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BEFORE = (Window.unboundedPreceding, -1)


def aggregate(
    df: DataFrame,
    by: Sequence[str],
    measures: dict[str, Column],
    distinct: dict[str, str] | None = None,
) -> DataFrame:
    """Group ``df`` into few groups and count distinct columns beside many other measures.

    COUNT(DISTINCT) among sums makes Spark carry the buffer of every sum in a
    shuffle row per distinct value, and several distincts also multiply the
    input. Here each distinct count reads only its own columns and shuffles
    bare (group, value) pairs, first by pair, so that one huge group is spread
    over all tasks; the sums combine map-side. The per-group results are then
    stacked and folded to one row, which also keeps NULL groups together.

    With many groups of few rows, or a single small measure, Spark's own
    ``count_distinct`` shuffles less; those analyses use it directly.
    """
    by = list(by)
    base = df.groupBy(*by).agg(*[m.alias(name) for name, m in measures.items()])
    if not distinct:
        return base
    counts = [
        df.select(*by, column)
        .distinct()
        .groupBy(*by)
        .agg(F.count(column).alias(name))
        for name, column in distinct.items()
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), counts, base)
    first, *others = measures
    names = [first, *distinct, *others]
    return stacked.groupBy(*by).agg(*[F.max(c).alias(c) for c in names])


def move_after(df: DataFrame, anchor: str, *names: str) -> DataFrame:
    """Reorder columns so that ``names`` follow ``anchor``."""
    rest = [c for c in df.columns if c not in names]
    at = rest.index(anchor) + 1
    return df.select(*rest[:at], *names, *rest[at:])


def would_broadcast(df: DataFrame) -> bool:
    """Whether this session broadcasts ``df`` in a join, by its known size and threshold."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return size <= int(limit)


def prune_before_top(
    rows: DataFrame, facts: DataFrame, key: str, score: Column, n: int, gain: int = 0
) -> DataFrame:
    """Drop rows that cannot be among the first n once joined to ``facts``.

    For a facts table too large to broadcast, so that a top-k join does not
    shuffle every row. The join may only add between 0 and ``gain`` to a row's
    score. Rows are counted by key and own score, combined before the shuffle,
    and those counts meet ``facts``. Summed from the top over the n best of them,
    the score at which they reach n rows is a floor that every row of the result
    reaches with ``gain`` added. If all counts together hold fewer than n rows,
    all are in the result and none is dropped. Exact either way.
    """
    counts = rows.groupBy(F.col(key), score.alias("_score")).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.join(facts.select(key), key).orderBy(F.desc("_score")).limit(n)
    so_far = F.sum("_n").over(Window.orderBy(F.desc("_score")))  # over at most n rows
    reached = best.select("_score", so_far.alias("_so_far")).filter(F.col("_so_far") >= n)
    floor = reached.agg(F.max("_score").alias("floor")).scalar()
    return rows.filter(floor.isNull() | (score + gain >= floor))


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on group keys under which NULL matches NULL, as it does in GROUP BY.

    The right keys are renamed first: both sides may descend from one table,
    and their key columns would otherwise be the same attribute.
    """
    renamed = right.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    matched = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    )
    return left.join(renamed, matched, how).drop(*[f"_key_{k}" for k in keys])


def rows_of_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` in the given groups.

    ``groups`` must come out of a ``limit(n)`` with a small n: that is the size
    bound which makes broadcasting it safe, so ``df`` is filtered in place.
    """
    return join_groups(df, F.broadcast(groups.select(*keys)), keys, "left_semi")


def number_rows(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """ROW_NUMBER over the few rows left by a ``limit``; never for a whole table."""
    return df.select(F.row_number().over(Window.orderBy(*order)).alias(name), "*")


def desc(*names: str) -> list[Column]:
    return [F.col(n).desc() for n in names]


def asc(*names: str) -> list[Column]:
    return [F.col(n).asc() for n in names]


def with_rank(df: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """RANK() OVER (ORDER BY first DESC, second DESC) without one task seeing every row.

    A row's rank is one more than the number of rows with a higher ``first``,
    plus those with the same ``first`` and a higher ``second``. Both counts come
    from a histogram whose size depends on the rounding of the two columns and
    not on the rows: a rate in percent with two decimals has 10,001 values.
    """
    cells = df.groupBy(first, second).agg(F.count(F.lit(1)).alias("_n"))
    higher_first = (
        cells.groupBy(first)
        .agg(F.sum("_n").alias("_n_first"))
        .select(
            F.col(first).alias("_first"),
            F.coalesce(
                F.sum("_n_first").over(Window.orderBy(F.col(first).desc()).rowsBetween(*_BEFORE)),
                F.lit(0),
            ).alias("_above"),
        )
    )
    within = cells.select(
        F.col(first).alias("_f"),
        F.col(second).alias("_s"),
        F.coalesce(
            F.sum("_n").over(
                Window.partitionBy(first).orderBy(F.col(second).desc()).rowsBetween(*_BEFORE)
            ),
            F.lit(0),
        ).alias("_beside"),
    )
    ranks = within.join(higher_first, F.col("_f").eqNullSafe(F.col("_first"))).select(
        "_f", "_s", (F.col("_above") + F.col("_beside") + 1).alias(name)
    )
    matched = F.col(first).eqNullSafe(F.col("_f")) & F.col(second).eqNullSafe(F.col("_s"))
    return df.join(ranks, matched).drop("_f", "_s")
