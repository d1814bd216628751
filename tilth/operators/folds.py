"""Expanding walk-forward folds and the purge before each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold_bounds(n: int, folds: int = 5, min_train: int | None = None) -> list[tuple[int, int]]:
    """(start, stop) of each test fold: the rows after ``min_train`` (half of all) in contiguous parts, ends rounded half to even."""
    first = n // 2 if min_train is None else min_train
    rest = n - first
    if folds < 1 or rest < folds or first < 1:
        raise ValueError(f"{rest} rows after {first} can't make {folds} folds")
    ends = [first + round(k * rest / folds) for k in range(folds + 1)]
    return list(zip(ends[:-1], ends[1:], strict=True))


def with_folds(grid: DataFrame, folds: int = 5, key: str = "device") -> DataFrame:
    """The grid (numbered by ``i``) with each row's test fold, -1 in the first half, and ``n``, its key's length."""
    n = F.count("*").over(Window.partitionBy(key))
    half = F.floor(F.col("n") / 2)
    ends = [half + F.bround(k * (F.col("n") - half) / F.lit(float(folds)), 0).cast("long") for k in range(folds)]
    fold = sum((F.when(F.col("i") >= e, 1).otherwise(0) for e in ends), F.lit(-1))
    return grid.withColumn("n", n).withColumn("fold", fold.cast("int"))


def fold_start(fold: Column, n: Column, folds: int = 5) -> Column:
    half = F.floor(n / 2)
    return half + F.bround(fold * (n - half) / F.lit(float(folds)), 0).cast("long")


def purged_train(rows: DataFrame, h: int, folds: int = 5, key: str = "device") -> DataFrame:
    """Training rows of every fold: ``rows`` of with_folds() repeated under ``for_fold``, without the h - 1 newest, whose
    targets overlap the forecast's lead."""
    wide = rows.withColumn("for_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return wide.where(F.col("i") < fold_start(F.col("for_fold"), F.col("n"), folds) - (h - 1))
