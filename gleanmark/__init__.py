"""Analytics over archives of captured web pages, expressed with Spark DataFrames."""

__version__ = "0.1.0"
