"""orrery: analytics on irregular time series, orbit tables and small images, built on Spark DataFrames."""

__version__ = "0.1.0"
