"""Training-data operators: text and media preparation on Spark DataFrames.

Nothing else in the library imports this subpackage.
"""
