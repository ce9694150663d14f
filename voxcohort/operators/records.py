"""Records: keys, precedence, completeness and rules, over plain tables.

Winners are picked by a maximum or minimum of a struct, which combines before the shuffle and never gathers a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class MissingRows(ValueError):
    """Rows that a mandatory lookup did not find."""


def first_of(df: DataFrame, keys: list[str], order: list[Column], largest: bool = False) -> DataFrame:
    """One row for each key: the first by `order`, or the last."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max if largest else F.min
    best = df.groupBy(*keys).agg(pick(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("row"))).alias("best"))
    return best.select(*keys, *[F.col(f"best.row.{c}").alias(c) for c in rest])


def required(df: DataFrame, lookup: DataFrame, on: list[str], strict: bool = True) -> DataFrame:
    """Inner join in which every row must find its match."""
    if strict and (missing := df.join(lookup, on, "left_anti").select(*on).distinct().limit(5).collect()):
        raise MissingRows(f"no match for {missing}")
    return df.join(lookup, on)


def merged(manifest: DataFrame, updates: DataFrame, on: list[str]) -> DataFrame:
    """The manifest with the columns of `updates`, which replace its own of the same name. A row without an update, or with
    more than one, raises."""
    if twice := updates.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect():
        raise ValueError(f"more than one update for {twice}")
    return required(manifest.drop(*[c for c in updates.columns if c not in on]), updates, on)


class StaleRecords(ValueError):
    """Records of another version that this run would not replace."""


def stale(records: DataFrame, version: str, replaced: list[str], complete: Column | None = None, version_column: str = "pipeline_version", group: str = "dataset") -> DataFrame:
    """Complete records of another version (or none), but for groups that are replaced as a whole."""
    other = ~F.col(version_column).eqNullSafe(F.lit(version)) & ~F.coalesce(F.col(group).isin(*replaced), F.lit(False))
    return records.where(other if complete is None else complete & other)


def refuse_stale(records: DataFrame, *args, shown: int = 5, **kw) -> DataFrame:
    """The records, if none is stale."""
    old = stale(records, *args, **kw)
    if found := old.limit(shown).collect():
        raise StaleRecords(f"{old.count()} records of another version, such as {found}")
    return records


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; changes win over the base."""
    both = base.withColumn("__rank", F.lit(1)).unionByName(changes.withColumn("__rank", F.lit(0)), allowMissingColumns=True)
    return first_of(both, keys, [F.col("__rank")]).drop("__rank")


def first_per_group(df: DataFrame, n: int, keys: list[str], order: list[Column]) -> DataFrame:
    """The first `n` rows of each group; Spark keeps n rows a task before the shuffle."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__n") <= n).drop("__n")


def reasons(*rules: tuple[Column, Column | str]) -> Column:
    """Array of the texts of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t) if isinstance(t, str) else t) for c, t in rules]))


def exact_groups(df: DataFrame, keys: list[str], column: str, wanted: tuple[str, ...], *conditions: Column) -> DataFrame:
    """Keys whose distinct values of `column` are exactly `wanted`, and for which the aggregate conditions hold."""
    same = F.array_sort(F.collect_set(column)) == F.array(*map(F.lit, sorted(wanted)))
    flags = [c.alias(f"__c{i}") for i, c in enumerate((same, *conditions))]
    return df.groupBy(*keys).agg(*flags).where(reduce(lambda a, b: a & b, [F.col(f"__c{i}") for i in range(len(flags))])).select(*keys)


def natural_order(name: str) -> list[Column]:
    """Digits first, by number, then other texts."""
    number = F.try_to_number(F.col(name), F.lit("999999999999999999"))
    return [number.isNull(), number, F.col(name)]
