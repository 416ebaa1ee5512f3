"""Fixed values of the climatology statistics.

Everything in the "fixed values" block below must equal what the dashboard
users already see (labels, token vocabularies, thresholds); changing one
changes results.  They are stated once here and imported everywhere else.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as written)
# ---------------------------------------------------------------------------

MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Observation columns carrying present-weather codes.
DSC_FIELDS = ["PRST_WX_DSC_1", "PRST_WX_DSC_2"]
PHENOM_FIELDS = ["PRST_WX_PHENOM_1", "PRST_WX_PHENOM_2"]
WX_FIELDS = ["PRST_WX_DSC_1", "PRST_WX_PHENOM_1", "PRST_WX_DSC_2", "PRST_WX_PHENOM_2"]
CLOUD_AMOUNT_FIELDS = ["CEIL_CLD_AMT_1", "CEIL_CLD_AMT_2"]
CLOUD_HEIGHT_FIELDS = ["CEIL_CLD_HT_1", "CEIL_CLD_HT_2"]

# Token vocabularies (substring tests on upper-cased, space-joined fields).
RAIN_DAY_TOKENS = ["RA", "DZ", "SH", "TS"]
THUNDER_TOKENS = ["TS"]
PRECIP_TOKENS = ["RA", "DZ", "SN", "GS", "GR", "PL", "SH", "TS"]
FOG_TOKENS = ["FG"]
CEILING_AMOUNTS = ["BKN", "OVC"]
SMOKE_TOKENS = ["FU", "DU", "SA", "VA"]
SMOKE_CONTOUR_ORDER = ["DU", "FU", "SA", "VA"]

# Legacy-generation vocabularies.
LEGACY_RAIN_TS_TOKENS = ["RA", "TS"]
LEGACY_RAIN_ONLY_TOKENS = ["RA", "SH", "DZ"]
LEGACY_FOG_TOKENS = ["FG"]
LEGACY_FOG_PAGE_TOKENS = ["FG", "BR"]
LEGACY_SMOKE_TOKENS = ["FU", "DU", "SA", "HZ", "VA"]

# Wind speed bands: upper bounds (exclusive) and labels; last label open-ended.
MPS_TO_KT = 1.943844
SPEED_BAND_EDGES = [1.0, 5.0, 10.0, 15.0, 22.0]
SPEED_BAND_LABELS = ["0-1 kt", "1-5 kt", "5-10 kt", "10-15 kt", "15-22 kt", "22+ kt"]

# Gale thresholds in m/s (34 kt mean wind, 41 kt gust), strict.
GALE_SPEED_MPS = 17.49
GALE_GUST_MPS = 21.09
GALE_CATEGORIES = ["No wx", "SHRA", "TS"]

# Visibility thresholds in km (cumulative) and their labels.
VSBY_THRESHOLDS = [3.0, 5.0, 7.0, 9.0]
VSBY_LABELS = ["<3 km", "<5 km", "<7 km", "<9 km"]

# Exclusive ceiling height bands (feet): upper bounds and labels; the last
# label takes everything at or above 1500 ft.
CEILING_BAND_EDGES = [500.0, 1000.0, 1500.0]
CEILING_BAND_LABELS = ["below 500ft", "below 1000ft", "below 1500ft", "below 2000ft"]

# Cumulative ceiling thresholds (feet) and labels.
CEILING_CUMULATIVE = [("below 2000ft", 2000.0), ("below 1500ft", 1500.0),
                      ("below 1000ft", 1000.0), ("below 500ft", 500.0)]

# Layered low-cloud categories for the wind contours: label, lower, upper (feet);
# lower None means no lower limit.  Then fog.
LOW_CLOUD_LAYERS = [
    ("Low cloud 2000-1500ft", 1500.0, 2000.0),
    ("Low cloud 1500-1000ft", 1000.0, 1500.0),
    ("Low cloud 1000-500ft", 500.0, 1000.0),
    ("Low cloud <500ft", None, 500.0),
]
FOG_LAYER_LABEL = "Fog"

# Polar frequency contours.
CONTOUR_DIR_STEP = 10.0
CONTOUR_DIR_BINS = 36
CONTOUR_CUTOFF_PCT = 0.06
CONTOUR_LOW_FRACTION = 0.08
CONTOUR_HIGH_FRACTION = 0.92
CONTOUR_LEVELS = 6
CONTOUR_SMOOTH_PASSES = 3
CONTOUR_MIN_RADIUS = 10.0
CONTOUR_HEADROOM = 1.1
CONTOUR_RADIUS_STEP = 5.0
SMOKE_CONTOUR_MAX_SPEED = 40.0

# Local climatological day: observations are assigned to the day that starts
# at 09:00 local time.
OBS_DAY_SHIFT_HOURS = 9

# Default selection ranges (current generation) and the preferred airport.
DEFAULT_AIRPORT = "YMML"
DEFAULT_YEAR_RANGE = (2000, 2025)
DEFAULT_MONTH_RANGE = ("Jan", "Dec")
DEFAULT_HOUR_RANGE = (0, 23)
DEFAULT_SECTION = "overview"
LEGACY_DEFAULT_YEAR_RANGE = (2015, 2024)

# Map tiles.
TILE_ZOOM = 9
TILE_SIZE_PX = 256

# ---------------------------------------------------------------------------
# Derived helpers (not fixed values)
# ---------------------------------------------------------------------------

MONTH_TO_NUM = {name: i + 1 for i, name in enumerate(MONTH_NAMES)}
DEFAULT_BY = ("TARGET_ICAO",)
