"""epiwatch: weekly health-demand surveillance on Spark DataFrames."""

__version__ = "0.1.0"
