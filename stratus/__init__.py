"""stratus: long-term surface weather-observation statistics on Spark.

Every operator takes a DataFrame of observations and returns a lazy
DataFrame computed for all stations at once.
"""

__version__ = "0.1.0"
