"""Training-data operators: thirteen corpus operators that run on Spark DataFrames.

Nothing outside this subpackage imports it.
"""
