"""Declarative data pipelines and text-record operators on Spark DataFrames."""

__version__ = "0.1.0"
