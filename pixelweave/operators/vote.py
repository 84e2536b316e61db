"""Voting over overlapping predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vote_counts(px: DataFrame, keys: tuple = ("scene", "r", "c")) -> DataFrame:
    """(keys, cls, n): votes by pixel and class, summed before the shuffle."""
    return px.groupBy(*keys, "cls").agg(F.count("*").alias("n"))


def best_class(n: str = "n", cls: str = "cls") -> Column:
    """The class of the most votes; of equals the lowest."""
    return F.max_by(F.col(cls), F.struct(F.col(n), -F.col(cls)))


def plurality(votes: DataFrame, keys: tuple = ("scene", "r", "c")) -> DataFrame:
    """(keys, cls, n): the winner of vote_counts(); pixels without votes have no row."""
    return votes.groupBy(*keys).agg(best_class().alias("cls"), F.max("n").alias("n"))


def merge_first(px: DataFrame, order: str, value: str = "cls", keys: tuple = ("r", "c")) -> DataFrame:
    """The value of the first layer that has one at a pixel."""
    return px.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias(value))
