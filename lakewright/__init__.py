"""lakewright: mixed-effects analytics and relational diagnostics on Spark DataFrames."""

__version__ = "0.1.0"
