"""Web-Mercator map tile addressing for stations.

Only the addressable part is built: which tile holds a station and at which
pixel offset, the nearest tile of an incomplete set, and the 3 x 3 neighbourhood of tiles around it.  Image loading
and stitching are outside the engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratus.functions import columns as C
from stratus.functions import constants as K


def tile_address(airports: DataFrame, zoom: int = K.TILE_ZOOM) -> DataFrame:
    """Tile x/y (truncated fractional tile position) and pixel offset
    inside that tile, per airport with known coordinates."""
    known = airports.filter(F.col("LAT").isNotNull() & F.col("LONG").isNotNull())
    frac = known.select("ICAO", "LAT", "LONG",
                        C.tile_fraction_x("LONG", zoom).alias("x_frac"),
                        C.tile_fraction_y("LAT", zoom).alias("y_frac"))
    px = float(K.TILE_SIZE_PX)
    return frac.select(
        "ICAO", F.lit(zoom).alias("zoom"), "x_frac", "y_frac",
        F.col("x_frac").cast("int").alias("x_tile"),
        F.col("y_frac").cast("int").alias("y_tile"),
        ((F.col("x_frac") - F.col("x_frac").cast("int")) * F.lit(px)).cast("int").alias("x_offset"),
        ((F.col("y_frac") - F.col("y_frac").cast("int")) * F.lit(px)).cast("int").alias("y_offset"))


def nearest_key(rows: DataFrame, available: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, key, nearest): for every distinct key of ``rows`` the nearest available one of its group, the smaller of two as near.

    Both sides are laid out in the order of their keys; the neighbours are the last available key before and the
    first one after.  What is ordered are distinct tile coordinates, at most 2**zoom per group on either side, not the rows.
    Keys of groups without anything available have a null.
    """
    by = list(by)
    both = rows.select(*by, F.col(key).alias("_at"), F.lit(None).cast("int").alias("_have")).distinct() \
        .unionByName(available.select(*by, F.col(key).alias("_at"), F.col(key).cast("int").alias("_have")).distinct())
    order = Window.partitionBy(*by).orderBy("_at")
    below = F.last("_have", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.first("_have", ignorenulls=True).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    found = both.withColumn("_below", below).withColumn("_above", above).filter("_have is null")
    closer = F.when(F.col("_below").isNull() | (F.col("_above") - F.col("_at") < F.col("_at") - F.col("_below")), F.col("_above")).otherwise(F.col("_below"))
    return found.select(*by, F.col("_at").alias(key), closer.alias("nearest"))


def nearest_tile(airports: DataFrame, tiles: DataFrame, zoom: int = K.TILE_ZOOM) -> DataFrame:
    """D14 on an incomplete tile set (x, y): per airport the nearest column that has tiles, then the nearest tile in it.

    Returns ICAO, zoom, x_tile, y_tile (its own tile) and tile_x, tile_y (the one to use; null if there are no tiles).
    """
    own = tile_address(airports, zoom).select("ICAO", "zoom", "x_tile", "y_tile")
    have = tiles.select(F.col("x").cast("int").alias("x_tile"), F.col("y").cast("int").alias("y_tile")).dropna().distinct()
    columns = nearest_key(own, have, "x_tile").withColumnRenamed("nearest", "tile_x")
    placed = own.join(columns, "x_tile")
    lookup = placed.select(F.col("tile_x").alias("x_tile"), "y_tile")
    inside = nearest_key(lookup, have, "y_tile", ["x_tile"]).withColumnsRenamed({"x_tile": "tile_x", "nearest": "tile_y"})
    return placed.join(inside.dropna(subset=["tile_x"]), ["tile_x", "y_tile"], "left").select("ICAO", "zoom", "x_tile", "y_tile", "tile_x", "tile_y")


def tile_neighbourhood(airports: DataFrame, zoom: int = K.TILE_ZOOM, tiles: DataFrame | None = None) -> DataFrame:
    """The 3 x 3 tiles around each station's tile (grid column/row 0..2).

    With ``tiles`` (x, y), around the nearest available tile, and ``available`` tells which of the nine exist.
    """
    if tiles is None:
        centre = tile_address(airports, zoom).select("ICAO", "zoom", F.col("x_tile").alias("_x"), F.col("y_tile").alias("_y"))
    else:
        centre = nearest_tile(airports, tiles, zoom).select("ICAO", "zoom", F.col("tile_x").alias("_x"), F.col("tile_y").alias("_y")).dropna()
    offsets = F.array(*[F.struct(F.lit(i).alias("col"), F.lit(j).alias("row"))
                        for i in range(3) for j in range(3)])
    cells = centre.select("ICAO", "zoom", "_x", "_y", F.explode(offsets).alias("_o"))
    out = cells.select("ICAO", "zoom", F.col("_o.col").alias("grid_col"), F.col("_o.row").alias("grid_row"),
                       (F.col("_x") + F.col("_o.col") - F.lit(1)).alias("tile_x"),
                       (F.col("_y") + F.col("_o.row") - F.lit(1)).alias("tile_y"))
    if tiles is None:
        return out
    have = tiles.select(F.col("x").cast("int").alias("tile_x"), F.col("y").cast("int").alias("tile_y"), F.lit(True).alias("available")).distinct()
    return out.join(have, ["tile_x", "tile_y"], "left").fillna(False, ["available"]).select(*out.columns, "available")
