"""sluice: a declarative pipeline engine that compiles a pipe-style text into Spark DataFrames."""

__version__ = "0.1.0"
