"""Several grains from one scan: a shared aggregate over grouping sets.

A statistic starts from *cells*: observations grouped by a few keys, its grain.  Statistics of different grains
share one pass: every observation is expanded once per grain (Spark's grouping sets) and all grains are combined in
one partial and one final hash aggregate.  What is derived from the text fields of an observation is
projected before it is expanded, so it is computed once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grain:
    """Cells of one statistic: ``keys`` and ``aggs`` over row columns; ``rows`` defines the row columns they use.

    A row with a null among ``required`` keys is not in the grain.
    """

    name: str
    keys: tuple[str, ...]
    aggs: Mapping[str, Column]
    rows: Mapping[str, Column]
    required: tuple[str, ...] = ()

    def cells(self, obs: DataFrame, by: Sequence[str]) -> DataFrame:
        """by, keys and aggs of this grain alone, from rows that are all in it.

        The caller filters them by the columns they are made from; a test of the keys themselves would compute these twice.
        """
        rows = obs.select("*", *[c.alias(n) for n, c in self.rows.items()]) if self.rows else obs
        return rows.groupBy(*by, *self.keys).agg(*[c.alias(n) for n, c in self.aggs.items()])


def _sets(by: Sequence[str], grains: Sequence[Grain]) -> tuple[list[str], list[tuple[str, ...]]]:
    keys = list(dict.fromkeys(k for g in grains for k in g.keys))
    return [*by, *keys], list(dict.fromkeys((*by, *g.keys) for g in grains))


def _set_id(columns: Sequence[str], members: Sequence[str]) -> int:
    """Spark's grouping_id: a 1 for each column that is not in the set, the first column the highest bit."""
    return int("".join("0" if c in members else "1" for c in columns) or "0", 2)


def shared_cells(obs: DataFrame, by: Sequence[str], grains: Sequence[Grain]) -> DataFrame:
    """The cells of all grains as one table: the keys of all, ``_set`` (which grouping set) and ``<grain>__<agg>``.

    Row columns of the same name must mean the same in every grain.
    """
    rows: dict[str, Column] = {}
    for g in grains:
        rows.update(g.rows)
    columns, sets = _sets(by, grains)
    aggs = [c.alias(f"{g.name}__{n}") for g in grains for n, c in g.aggs.items()]
    projected = obs.select("*", *[c.alias(n) for n, c in rows.items()])
    return projected.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]) \
        .agg(F.grouping_id().alias("_set"), *aggs)


def cells_of(table: DataFrame, by: Sequence[str], grains: Sequence[Grain], grain: Grain) -> DataFrame:
    """The cells of one grain from :func:`shared_cells`, as ``grain.cells`` gives them."""
    columns, _ = _sets(by, grains)
    rows = table.filter(F.col("_set") == _set_id(columns, (*by, *grain.keys)))
    if grain.required:
        rows = rows.dropna(subset=list(grain.required))
    return rows.select(*by, *grain.keys, *[F.col(f"{grain.name}__{n}").alias(n) for n in grain.aggs])
