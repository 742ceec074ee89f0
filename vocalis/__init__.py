"""Analytics over large collections of short texts, written for Spark.

Every step takes DataFrames and returns a DataFrame; nothing is tied to one
corpus.  See README.md for the map of operators.
"""
