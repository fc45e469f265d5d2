"""Audits of score columns as Spark DataFrame operations.

Every operator takes DataFrames and column names and returns a DataFrame; nothing here runs
a model.  See ``README.md`` for the map from operators to modules.
"""
