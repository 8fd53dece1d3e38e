"""stratoframe: a Spark-first dataset engine for gridded, tabular and trajectory time series."""

__version__ = "0.1.0"
