"""Smoothed polar frequency contours.

A group's observations are binned by direction (36 x 10 degrees) and speed
(1 unit bins on [0, n], last bin closed), turned into percentages, smoothed,
and cut at up to six geometric levels; each level yields a radius per
direction.  Everything is expressed as aggregates over bounded cell sets:

* C1 histogram: partial+final aggregate -> at most 36 * n cells per group.
* C2 smoothing: three passes of a (1, 2, 1)/4 filter along direction
  (circular) and along speed (edge replicated) equal one 7-tap binomial
  filter (1, 6, 15, 20, 15, 6, 1)/64 per axis with mirrored speed indices.
  A group's histogram becomes one row with 36 arrays of n sums, and both passes
  are higher-order functions on them; integer weights keep the sums exact.
* C3 levels: computed once per group, on the row that holds its field.
* C4 boundary: per level and direction the upper edge of the highest bin at
  or above the level, then one circular (1, 2, 1)/4 pass, on the same row.

After the histogram there are two exchanges, on the group keys and on the
figure keys, and rows are exploded only into the long result.  A group is
bounded by its fixed-size grid.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratus.functions import columns as C
from stratus.functions import constants as K
from stratus.operators.current import rain_days, smoke_observations, smoke_rows, with_obs_day, with_rain_day
from stratus.plans.grains import Grain

# 3 passes of (1, 2, 1) -> binomial taps for offsets -3..3, sum 64 per axis.
_TAPS = [1, 6, 15, 20, 15, 6, 1]
_TAP_NORM = 64 * 64


def speed_bin_raw(speed: str | Column = "WND_SPD") -> Column:
    """Unclipped 1-unit speed bin of a non-negative-clipped speed."""
    s = F.col(speed) if isinstance(speed, str) else speed
    return F.floor(F.greatest(s, F.lit(0.0))).cast("long")


def finite(name: str) -> Column:
    """Known and neither NaN nor infinite."""
    return F.coalesce(F.abs(F.col(name)) < F.lit(float("inf")), F.lit(False))


def direction_bin(direction: str | Column = "WND_DIR") -> Column:
    d = F.col(direction) if isinstance(direction, str) else direction
    return F.least(F.floor(F.pmod(d, F.lit(360.0)) / F.lit(K.CONTOUR_DIR_STEP)),
                   F.lit(K.CONTOUR_DIR_BINS - 1)).cast("int")


def display_radius(speed: Column) -> Column:
    """C5 / axis maximum: max(10, ceil(speed * 1.1 / 5) * 5)."""
    return F.greatest(F.lit(K.CONTOUR_MIN_RADIUS),
                      (F.ceil(speed * F.lit(K.CONTOUR_HEADROOM) / F.lit(K.CONTOUR_RADIUS_STEP))
                       * F.lit(K.CONTOUR_RADIUS_STEP)).cast("double"))


def polar_histogram(rows: DataFrame, keys: Sequence[str], n_bins: Column | float) -> DataFrame:
    """Counts per (keys, speed bin, direction bin).

    Rows without a finite direction and speed are left out.  ``n_bins`` (number of
    speed bins = maximum speed, 3 at least) may be a constant or a column of ``rows``.
    Output: keys, n, sbin, dbin, cnt.
    """
    if not isinstance(n_bins, Column) and n_bins < 3:
        raise ValueError("a contour needs at least 3 speed bins")
    n = n_bins if isinstance(n_bins, Column) else F.lit(float(n_bins))
    n = n.cast("long")
    sbin = F.least(speed_bin_raw("WND_SPD"), n - F.lit(1))
    return rows.filter(finite("WND_DIR") & finite("WND_SPD")).groupBy(*keys, n.alias("n"), sbin.alias("sbin"), direction_bin("WND_DIR").alias("dbin")) \
        .agg(F.count(F.lit(1)).alias("cnt"))


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, computed once a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _seven(item: str) -> str:
    """SQL for the weighted sum of the seven neighbours; ``item`` is the j-th of them."""
    return " + ".join(f"{w} * {item.format(j=j)}" for j, w in enumerate(_TAPS))


def _speed_pass() -> str:
    """SQL: a direction's cells (an array of (sbin, cnt)) as n smoothed sums; each end of the speed axis is its own mirror."""
    dense = "transform(sequence(0, n - 1), s -> coalesce(try_element_at(m, s), 0L))"
    padded = "concat(reverse(slice(d, 1, 3)), d, reverse(slice(d, n - 2, 3)))"
    return _let("m", "map_from_entries(cells)", _let("d", dense, _let("p", padded, f"transform(sequence(0, n - 1), s -> {_seven('p[s + {j}]')})")))


def _direction_pass() -> str:
    """SQL: the speed sums of the directions that have any (an array of (dbin, sums)) as smoothed 36 x n sums around the circle."""
    last = K.CONTOUR_DIR_BINS - 1
    dense = f"transform(sequence(0, {last}), i -> coalesce(try_element_at(m, i), array_repeat(0L, n)))"
    padded = f"concat(slice(d, {last - 1}, 3), d, slice(d, 1, 3))"
    return _let("m", "map_from_entries(directions)", _let("d", dense, _let("p", padded, (
        f"transform(sequence(0, {last}), i -> transform(sequence(0, n - 1), s -> {_seven('p[i + {j}][s]')}))"))))


def smoothed_grids(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group with its smoothed field: keys, n, grid, peak.

    ``grid`` is 36 arrays of n relative frequencies (%), ``peak`` the largest of them.  The filter is separable: seven taps along the speeds of each
    direction, then along the directions, on whole numbers, divided once.  It conserves mass, so the group's total is 4096 times
    its count.  There is one exchange, on the keys, with an explicit partition count: the histogram is small
    but the smoothing is not, and size-based coalescing would put it into a handful of tasks.  A group holds at most 36 x n cells, so a hot
    station cannot overload a task.
    """
    keys = list(keys)
    parts = int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    hist = hist.repartition(parts, *keys).withColumn("n", F.col("n").cast("int"))
    cells = F.collect_list(F.struct(F.col("sbin").cast("int"), F.col("cnt").cast("long")))
    speeds = hist.groupBy(*keys, "n", "dbin").agg(cells.alias("cells"), F.sum("cnt").alias("total")) \
        .select(*keys, "n", "total", F.struct("dbin", F.expr(_speed_pass()).alias("sums")).alias("direction"))
    fields = speeds.groupBy(*keys, "n").agg(F.collect_list("direction").alias("directions"), F.sum("total").alias("total")) \
        .select(*keys, "n", F.expr(_let("w", f"cast({_TAP_NORM} * total as double)",
                                        f"transform({_direction_pass()}, r -> transform(r, x -> cast(x as double) * 100D / w))")).alias("grid"))
    return fields.withColumn("peak", F.expr("array_max(transform(grid, r -> array_max(r)))"))


def smooth_polar(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """C2 in long form: keys, n, sbin, dbin, value, peak of every cell that is not zero."""
    keys = list(keys)
    rows = smoothed_grids(hist, keys).select(*keys, F.col("n").cast("long").alias("n"), "peak", F.posexplode("grid").alias("dbin", "_row"))
    cells = rows.select(*keys, "n", "peak", "dbin", F.posexplode("_row").alias("sbin", "value"))
    return cells.filter("value > 0").select(*keys, "n", F.col("sbin").cast("long").alias("sbin"), "dbin", "value", "peak")


def raw_levels(peak: Column) -> list[Column]:
    """The six unrounded geometric levels of a group with this peak.

    low = max(0.06, 0.08 * peak), high = max(low, 0.92 * peak); the inner
    four use the same arithmetic as a log-spaced sequence (10 ** (i * step +
    log10(low))) with exact end points.
    """
    low = F.greatest(F.lit(K.CONTOUR_CUTOFF_PCT), peak * F.lit(K.CONTOUR_LOW_FRACTION))
    high = F.greatest(low, peak * F.lit(K.CONTOUR_HIGH_FRACTION))
    steps = K.CONTOUR_LEVELS - 1
    step = (F.log10(high) - F.log10(low)) / F.lit(float(steps))
    return [low] + [F.pow(F.lit(10.0), F.lit(float(i)) * step + F.log10(low)) for i in range(1, steps)] + [high]


def contour_levels(peak: Column) -> Column:
    """The group's distinct levels, ascending: the six raw levels of
    :func:`raw_levels`, each rounded to 3 decimals on the exact binary value
    (:func:`stratus.functions.columns.round_binary`), de-duplicated.

    The rounding runs inside ``transform`` on the array of raw levels, so
    each raw level is computed once per row and the rounding expression only
    refers to the lambda variable.
    """
    rounded = F.transform(F.array(*raw_levels(peak)), lambda x: C.round_binary(x, 3))
    return F.array_sort(F.array_distinct(rounded))


def contour_lines(grids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """C3 + C4 on the rows of :func:`smoothed_grids`: keys, lines, reach.

    ``lines`` has one (level_idx, level, radius of the 36 directions) per kept level, ``reach`` is the largest radius.  Groups whose peak is below the
    cut-off are skipped.  ``level_idx`` is the place in the group's level list, numbered before empty levels are dropped.
    """
    keys = list(keys)
    last, bins = K.CONTOUR_DIR_BINS - 1, K.CONTOUR_DIR_BINS
    rows = grids.filter(F.col("peak") >= F.lit(K.CONTOUR_CUTOFF_PCT)).select(*keys, "n", "grid", contour_levels(F.col("peak")).alias("levels"))
    # Per level and direction the upper edge of the highest bin at or above the level, then one circular (1, 2, 1) / 4.
    edges = "transform(grid, r -> aggregate(sequence(0, n - 1), 0, (e, s) -> if(r[s] >= v, s + 1, e)))"
    radius = f"transform(sequence(0, {last}), i -> cast(e[(i + {last}) % {bins}] + 2 * e[i] + e[(i + 1) % {bins}] as double) / 4D)"
    lines = f"transform(levels, (v, k) -> named_struct('level_idx', k, 'level', v, 'radius', {_let('e', edges, radius)}))"
    out = rows.select(*keys, F.expr(lines).alias("lines")) \
        .select(*keys, F.expr("filter(lines, x -> array_max(x.radius) > 0)").alias("lines"))
    return out.withColumn("reach", F.expr("array_max(transform(lines, x -> array_max(x.radius)))"))


def contour_rows(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of :func:`contour_lines` in long form: columns, level_idx, level, dir_center, radius (36 rows per kept level)."""
    levels = lines.select(*columns, F.inline("lines"))
    cells = levels.select(*columns, "level_idx", "level", F.posexplode("radius").alias("_d", "radius"))
    centre = F.col("_d") * F.lit(K.CONTOUR_DIR_STEP) + F.lit(K.CONTOUR_DIR_STEP / 2)
    return cells.select(*columns, "level_idx", "level", centre.alias("dir_center"), "radius")


def polar_contours(hist: DataFrame, keys: Sequence[str], figure_keys: Sequence[str]) -> DataFrame:
    """C2-C5 on a C1 histogram; the axis maximum of a figure comes from its largest kept radius."""
    lines = contour_lines(smoothed_grids(hist, keys), keys)
    biggest = F.max("reach").over(Window.partitionBy(*figure_keys))
    out = contour_rows(lines.withColumn("display_max_speed", display_radius(biggest)), [*keys, "display_max_speed"])
    return out.select(*keys, "level_idx", "level", "dir_center", "radius", "display_max_speed")


def wind_contours(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY,
                  max_speed: float = K.SMOKE_CONTOUR_MAX_SPEED) -> DataFrame:
    """C1-C5 over all observations of each group with a fixed maximum speed."""
    by = list(by)
    rows = obs.filter(F.col("WND_DIR").isNotNull() & F.col("WND_SPD").isNotNull())
    return polar_contours(polar_histogram(rows, by, max_speed), by, by)


def smoke_wind_grain() -> Grain:
    """The C1 histogram of C7 as a grain over all observations."""
    known = finite("WND_DIR") & finite("WND_SPD")
    top = F.lit(int(K.SMOKE_CONTOUR_MAX_SPEED) - 1).cast("long")
    return Grain("smoke_wind", ("phenomenon", "sbin", "dbin"), {"cnt": F.count(F.lit(1))}, {
        **smoke_rows(), "sbin": F.when(known, F.least(speed_bin_raw("WND_SPD"), top)), "dbin": F.when(known, direction_bin("WND_DIR"))},
        ("phenomenon", "sbin", "dbin"))


def smoke_wind_from_cells(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    hist = cells.filter(F.col("phenomenon").isin(*K.SMOKE_CONTOUR_ORDER)).withColumn("n", F.lit(int(K.SMOKE_CONTOUR_MAX_SPEED)).cast("long"))
    return polar_contours(hist, [*by, "phenomenon"], list(by))


def smoke_wind_contours(obs: DataFrame, by: Sequence[str] = K.DEFAULT_BY) -> DataFrame:
    """Contours per smoke/dust code (exclusive codes), maximum speed 40."""
    rows = smoke_observations(obs).filter(finite("WND_DIR") & finite("WND_SPD"))
    grain = smoke_wind_grain()
    return smoke_wind_from_cells(replace(grain, rows={n: c for n, c in grain.rows.items() if n != "phenomenon"}).cells(rows, by), by)


def fog_low_cloud_flags() -> list[tuple[str, Column]]:
    """(label, flag) of the fog / layered low-cloud categories, in layer order.

    Needs the columns of :func:`stratus.functions.columns.with_cloud_columns`.
    """
    flags = [(label, C.layered_ceiling_flag(lo, hi)) for label, lo, hi in K.LOW_CLOUD_LAYERS]
    flags.append((K.FOG_LAYER_LABEL, C.phenom_mask(K.FOG_TOKENS)))
    return flags


def fog_wind_grain() -> Grain:
    """Observations in a fog / low-cloud category on the grid of raw bins of (group, split), one count per category.

    Needs the columns of :func:`stratus.functions.columns.with_cloud_columns` and ``is_rain_day``.
    """
    usable = finite("WND_DIR") & finite("WND_SPD")
    flags = [usable & flag for _, flag in fog_low_cloud_flags()]
    any_flag = flags[0]
    for flag in flags[1:]:
        any_flag = any_flag | flag
    return Grain("fog_wind", ("is_rain_day", "sbin_raw", "dbin"), {
        **{f"cnt{i}": F.count_if(F.col(f"_cat{i}")) for i in range(len(flags))}, "max_spd": F.max("WND_SPD")}, {
        **{f"_cat{i}": flag for i, flag in enumerate(flags)},
        "sbin_raw": F.when(any_flag, speed_bin_raw("WND_SPD")), "dbin": F.when(any_flag, direction_bin("WND_DIR"))},
        ("is_rain_day", "sbin_raw", "dbin"))


def fog_wind_from_cells(raw: DataFrame, by: Sequence[str]) -> DataFrame:
    split_by = [*by, "is_rain_day"]
    labels = [label for label, _ in fog_low_cloud_flags()]
    counts = [f"cnt{i}" for i in range(len(labels))]
    fig_max = F.max("max_spd").over(Window.partitionBy(*split_by))
    raw = raw.withColumn("n", display_radius(fig_max).cast("long"))
    grid = raw.groupBy(*split_by, "n", F.least(F.col("sbin_raw"), F.col("n") - F.lit(1)).alias("sbin"), "dbin") \
        .agg(*[F.sum(c).alias(c) for c in counts])
    per_cat = F.explode(F.array(*[F.struct(F.lit(label).alias("category"), F.col(c).alias("cnt")) for label, c in zip(labels, counts)]))
    hist = grid.select(*split_by, "n", "sbin", "dbin", per_cat.alias("_c")) \
        .select(*split_by, "_c.category", "n", "sbin", "dbin", "_c.cnt").filter(F.col("cnt") > 0)
    return polar_contours(hist, [*split_by, "category"], split_by)


def fog_low_cloud_wind_contours(obs: DataFrame, airports: DataFrame | None = None,
                                by: Sequence[str] = K.DEFAULT_BY, days: DataFrame | None = None) -> DataFrame:
    """Contours per fog / low-cloud category, separately for rain days and
    other days (A7 split).

    A row may be in several categories.  The maximum speed is shared by all
    categories of a (group, split): max(10, ceil(max speed * 1.1 / 5) * 5)
    over rows with any category and a known direction and speed.

    The rain days come as bitmaps (:func:`stratus.operators.current.rain_days`, computed now unless
    given).  Observations in a category are then reduced straight to the grid of raw bins of (group, split), one
    count per category (no per-row explode), and only the grid is unpivoted.
    """
    by = list(by)
    days = rain_days(obs, airports, by) if days is None else days
    grain = fog_wind_grain()
    rows = C.with_cloud_columns(obs).select("*", *[c.alias(n) for n, c in grain.rows.items()]).filter("sbin_raw is not null")
    rows = with_rain_day(with_obs_day(rows, airports, by), days, by)
    return fog_wind_from_cells(replace(grain, rows={}).cells(rows, by), by)
