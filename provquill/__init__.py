"""provquill: provenance analytics over media evidence, expressed as Spark DataFrames."""

__version__ = "0.1.0"
