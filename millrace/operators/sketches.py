"""Mergeable sketches of a column: distinct counts and quantiles, one a file, merged by collection.

A sketch has a fixed size whatever it has seen, and the sketch of two sets together is made of theirs. So a file's
sketches are written when the file is, and a collection's counts come from its files' without reading their rows; a file
that is replaced replaces its own. Bounds are three standard errors of the sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the distinct sketch's registers, and the size parameter of the quantile sketch.
REGISTERS, K = 12, 200
#: Relative standard error of the distinct sketch; rank error of the quantile sketch with a confidence of 99 %.
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (REGISTERS / 2), 0.0133


def of_files(rows: DataFrame, keys: list[str], distinct: Column, value: Column) -> DataFrame:
    """The keys with the sketches of every file: `distinct_sketch`, `value_sketch`, and the rows."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(distinct, REGISTERS).alias("distinct_sketch"), F.kll_sketch_agg_double(value.cast("double"), K).alias("value_sketch"), F.count("*").alias("rows"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of collections from those of their files."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch").alias("value_sketch"), F.sum("rows").alias("rows"))


def replaced(sketches: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The stored sketches with those of files that have been written again."""
    return sketches.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def distinct_bounds(sketch: Column) -> tuple[Column, Column]:
    n = F.hll_sketch_estimate(sketch)
    return F.floor(n * (1 - 3 * DISTINCT_ERROR)), F.ceil(n * (1 + 3 * DISTINCT_ERROR))


def quantile_bounds(sketch: Column, rank: float) -> tuple[Column, Column]:
    """Values between which the quantile of a rank lies."""
    at = lambda r: F.kll_sketch_get_quantile_double(sketch, F.lit(min(1.0, max(0.0, r))))
    return at(rank - RANK_ERROR), at(rank + RANK_ERROR)
