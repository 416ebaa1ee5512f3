"""Time zones from coordinates: points in polygons, joined through a grid.

A zone is given by rings: closed lines of vertices, numbered by part and ring.  A part's rings are counted together by the even-odd
rule, so a ring inside another one is a hole, and a zone may have several parts.

A point meets the parts whose bounding box touches its grid cell (an equi-join on the cell), and then only those edges
of such a part that cross the point's band of latitudes (an equi-join on part and band).  A horizontal ray to the east
crosses an odd number of them if the point is inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of a ring table; vertices in order of ``seq``, the last one joined to the first.
RING_COLUMNS = ["zone", "part", "ring", "seq", "lon", "lat"]


def _cell(c: str, size: float):
    return F.floor(F.col(c) / F.lit(size)).cast("int")


def ring_edges(rings: DataFrame) -> DataFrame:
    """(zone, part, lon0, lat0, lon1, lat1) of every edge that is not horizontal, its lower end first.

    The order makes an edge that two zones share the same numbers for both, whichever way round they give it.
    """
    known = rings.dropna(subset=["zone", "lon", "lat"])
    at = F.array_sort(F.collect_list(F.struct("seq", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))))
    lines = known.groupBy("zone", "part", "ring").agg(at.alias("v"))
    ends = lines.select("zone", "part", F.explode(F.expr("transform(v, (a, i) -> struct(a, v[(i + 1) % size(v)] as b))")).alias("e"))
    ordered = ends.select("zone", "part", F.struct("e.a.lat", "e.a.lon").alias("a"), F.struct("e.b.lat", "e.b.lon").alias("b")) \
        .select("zone", "part", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    return ordered.filter("low.lat < high.lat").select("zone", "part", F.col("low.lon").alias("lon0"), F.col("low.lat").alias("lat0"),
                                                       F.col("high.lon").alias("lon1"), F.col("high.lat").alias("lat1"))


def zone_by_polygon(points: DataFrame, rings: DataFrame, key: str = "ICAO", lat: str = "LAT", lon: str = "LONG", cell: float = 1.0) -> DataFrame:
    """(key, zone) of every distinct point that lies in a zone; where zones overlap, the first by name.

    A point on a border belongs to the part east of it, on a horizontal one to the part north of it, so of two zones that share a border
    exactly one has it.  Points without coordinates and points outside all zones have no row.  ``cell`` is the
    grid's size in degrees; the result does not depend on it.  Rings that cross the date line have to be given as two parts.
    """
    edges = ring_edges(rings)
    boxes = edges.groupBy("zone", "part").agg(F.min(F.least("lon0", "lon1")).alias("west"), F.max(F.greatest("lon0", "lon1")).alias("east"),
                                              F.min("lat0").alias("south"), F.max("lat1").alias("north"))
    cells = boxes.withColumn("cx", F.explode(F.sequence(_cell("west", cell), _cell("east", cell)))) \
        .withColumn("cy", F.explode(F.sequence(_cell("south", cell), _cell("north", cell))))
    at = points.select(F.col(key).alias("key"), F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x")).dropna().distinct() \
        .withColumn("cx", _cell("x", cell)).withColumn("cy", _cell("y", cell))
    near = at.join(cells, ["cx", "cy"]).filter("x between west and east and y between south and north").select("key", "x", "y", "zone", "part", "cy")
    bands = edges.withColumn("cy", F.explode(F.sequence(_cell("lat0", cell), _cell("lat1", cell))))
    crossing = (F.col("lat0") <= F.col("y")) & (F.col("y") < F.col("lat1")) \
        & (F.col("lon0") + (F.col("y") - F.col("lat0")) * (F.col("lon1") - F.col("lon0")) / (F.col("lat1") - F.col("lat0")) > F.col("x"))
    inside = near.join(bands, ["zone", "part", "cy"]).filter(crossing).groupBy("key", "x", "y", "zone", "part").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1")
    return inside.groupBy(F.col("key").alias(key)).agg(F.min("zone").alias("zone"))


def with_polygon_zone(airports: DataFrame, rings: DataFrame, cell: float = 1.0) -> DataFrame:
    """``airports`` with ``tz`` filled from the polygons where it is null; a zone given in the dimension stays."""
    zones = zone_by_polygon(airports.filter("tz is null"), rings, cell=cell).withColumnsRenamed({"ICAO": "_zone_icao", "zone": "_zone"})
    out = airports.join(zones, airports["ICAO"] == zones["_zone_icao"], "left")
    return out.withColumn("tz", F.coalesce("tz", "_zone")).drop("_zone", "_zone_icao")
