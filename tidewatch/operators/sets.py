"""Set operations on whole tables and their names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_days(dfs: list[DataFrame]) -> DataFrame:
    """All tables, by name; columns that differ are an error."""
    return reduce(DataFrame.unionByName, dfs)


def class_vocabulary(train: DataFrame, test: DataFrame, y: str) -> DataFrame:
    """(class, idx): distinct classes of both tables, numbered in order from 0. One row for each class is sorted in one array."""
    each = train.select(F.col(y).alias("class")).union(test.select(y)).where("class is not null").distinct()
    return each.agg(F.sort_array(F.collect_list("class")).alias("c")).select(F.posexplode("c").alias("idx", "class")).select("class", "idx")


def shared_features(a: DataFrame, b: DataFrame) -> list[str]:
    """Names of both tables, in the first one's order."""
    return [c for c in a.columns if c in set(b.columns)]
