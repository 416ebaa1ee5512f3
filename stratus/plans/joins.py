"""Constant arrays and grid completion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def _sql_literal(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return repr(v) + "D"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(values: Sequence, dtype=None):
    """A constant array column built from one SQL expression (one JVM call
    instead of one per element); cast to ``dtype`` elements when given."""
    col = F.expr("array(" + ", ".join(_sql_literal(v) for v in values) + ")")
    return col.cast(ArrayType(dtype)) if dtype is not None else col


def densify(df: DataFrame, by: Sequence[str], grid: Mapping[str, Sequence],
            values: dict[str, object]) -> DataFrame:
    """Complete every ``by`` group to the full grid (the cartesian product of
    the ``grid`` value lists, e.g. 12 months x 3 categories), filling absent
    cells with the given defaults.

    ``df`` holds at most one row per (by, grid) cell; rows whose grid columns
    are null only mark that the group exists.  The cells of a group are
    gathered into a map (bounded by the grid size, never by the data size) and
    the grid is generated with one ``explode`` per dimension -- one small
    shuffle on ``by`` and no join.
    """
    names = list(grid)
    key_types = {g: df.schema[g].dataType for g in names}
    present = None
    for g in names:
        term = F.col(g).isNotNull()
        present = term if present is None else (present & term)
    key = F.struct(*[F.col(g) for g in names])
    val = F.struct(*[F.col(v) for v in values])
    cells = df.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.when(present, F.struct(key.alias("k"), val.alias("v"))))).alias("_cells"))
    spine = cells
    for g in names:
        spine = spine.select(*spine.columns, F.explode(literal_array(grid[g], key_types[g])).alias(g))
    found = F.try_element_at(F.col("_cells"), F.struct(*[F.col(g) for g in names]))
    out = [F.col(b) for b in by] + [F.col(g) for g in names]
    for v, default in values.items():
        dtype = df.schema[v].dataType
        out.append(F.coalesce(found.getField(v), F.lit(default).cast(dtype)).alias(v))
    return spine.select(*out)
