"""Operators of a training-data pipeline over whole document tables.

Nothing else in the library imports this subpackage. Every operator takes DataFrames and returns a
DataFrame; per-document work runs in Arrow batches, everything that joins or counts over the corpus is
a Spark shuffle. Intermediate tables go to the folder named by `spark.checkpoint.dir`.
"""
