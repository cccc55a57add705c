"""Rows added one after the other to a table with several unique keys, without a loop over rows.

``first_come``: a row is refused if a row accepted before it shares one of its keys (insert or ignore).  Which rows are accepted depends on
the order of all rows that hang together by keys, yet not on rows that share none: a row that is the first of those left in every one of its
keys is accepted, its neighbours are refused, and the rest goes into the next round.  ``last_come``: a row takes the place of those before it
that share one of its keys (insert or replace); it stays if no later row shares any.

First rows of a key come from partial aggregates, so a key with very many rows costs no more than others.  Keys must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..intermediate import written


def _one_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[str], least: bool) -> DataFrame:
    """One row of each combination of keys, the first or last by order and then by its other values: rows with equal keys share their fate, or the last replaces the others."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    pick = F.min if least else F.max
    one = rows.groupBy(*keys).agg(pick(F.struct(*order, *rest)).alias("__row")) if len(keys) < len(rows.columns) else rows.distinct()
    return one.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in rows.columns])


def _place(keys: Sequence[str], order: Sequence[str]) -> Column:
    """A row's place in the order, total: rows that tie follow their keys."""
    return F.struct(*order, *keys)


def _ahead(rows: DataFrame, keys: Sequence[str], least: bool) -> DataFrame:
    """place of the rows that come first (or last) in every one of their keys."""
    pick = F.min if least else F.max
    first, *others = [rows.groupBy(k).agg(pick("place").alias("place")).select("place") for k in keys]
    for o in others:
        first = first.join(o, "place", "left_semi")
    return first


def first_come(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The rows that are accepted when all are added in their order; as many rounds as rows depend on each other in a chain."""
    order = [c for c in order if c not in keys]
    rows = written(_one_of_each(rows, keys, order, True))
    left = rows.select(*keys, _place(keys, order).alias("place"))
    accepted: DataFrame | None = None
    while not left.isEmpty():
        won = written(_ahead(left, keys, True).select(*[F.col(f"place.{k}").alias(k) for k in keys]))
        accepted = won if accepted is None else accepted.unionByName(won)
        for k in keys:
            left = left.join(won.select(k), k, "left_anti")
        left = written(left.select(*keys, "place"))
    return rows.limit(0) if accepted is None else rows.join(accepted, list(keys), "left_semi").select(*rows.columns)


def last_come(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The rows that are left when all are added in their order and each removes those before it that share a key: one round."""
    order = [c for c in order if c not in keys]
    rows = written(_one_of_each(rows, keys, order, False))
    stay = _ahead(rows.select(*keys, _place(keys, order).alias("place")), keys, False).select(*[F.col(f"place.{k}").alias(k) for k in keys])
    return rows.join(stay, list(keys), "left_semi").select(*rows.columns)
